"""Control tables of a platform: experiments, variants, user assignments, results.

All are append-only Parquet tables of the session catalog. An experiment row is changed
by appending its newer version, so no job ever overwrites what another one reads and a
failed job leaves the table as it was.

Every append is a batch in a folder of its own, written there and then added to the catalog
in one call, so jobs that append at once do not meet in a common output folder and readers
see a batch whole or not at all. Two jobs may still insert the same key at once; which of the
rows counts is decided on reading (``first_rows``), the same for every reader.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.schemas import EXPERIMENT_RESULTS, EXPERIMENTS, USER_ASSIGNMENTS, VARIANTS

# Names of the platform's tables (fixed values).
_TABLES = {
    "experiments": (EXPERIMENTS, None),
    "variants": (VARIANTS, None),
    "user_assignments": (USER_ASSIGNMENTS, "experiment_id"),
    "experiment_results": (EXPERIMENT_RESULTS, None),
}
#: Partition column that names the append a row came with.
_BATCH = "batch"


def absent_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``, one per key.

    Of several new rows of a key the least one stays, so the choice does not depend on the
    order of rows. Two jobs that insert at once both find a key absent; ``first_rows`` settles
    that on reading.
    """
    rest = [c for c in new.columns if c not in keys]
    chosen = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")) if rest else new.distinct()
    chosen = chosen.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in new.columns])
    return chosen.join(existing.select(*keys), list(keys), "left_anti")


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``order``, then the least row."""
    rest = [*order, *[c for c in rows.columns if c not in (*keys, *order, _BATCH)]]
    first = F.min(F.struct(*rest))
    return rows.groupBy(*keys).agg(first.alias("_row")).select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns if c != _BATCH]
    )


def newest_versions(rows: DataFrame) -> DataFrame:
    """Current row per experiment: the last version appended."""
    rest = [c for c in rows.columns if c not in ("experiment_id", "updated_at", _BATCH)]
    newest = F.max(F.struct("updated_at", *rest))  # of one time the greatest row
    return rows.groupBy("experiment_id").agg(newest.alias("_row")).select(
        *["experiment_id" if c == "experiment_id" else F.col("_row")[c].alias(c)
          for c in rows.columns if c not in ("updated_at", _BATCH)]
    )


def newest_results(results: DataFrame) -> DataFrame:
    """Newest row per experiment, variant and metric of the append-only result table."""
    keys = ["experiment_id", "variant_id", "metric_name"]
    rest = [c for c in results.columns if c not in (*keys, "computed_at", "value", _BATCH)]
    newest = F.max(F.struct("computed_at", "value", *rest))
    return results.groupBy(*keys).agg(newest.alias("_row")).select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in results.columns if c != _BATCH]
    )


def stopped(experiments: DataFrame, experiment_id: str) -> DataFrame:
    """Experiments with one of them stopped now."""
    hit = F.col("experiment_id") == experiment_id
    return experiments.withColumn(
        "end_date", F.when(hit, F.current_timestamp()).otherwise(F.col("end_date"))
    ).withColumn("status", F.when(hit, F.lit("stopped")).otherwise(F.col("status")))


def resolve_variants(
    assignments: DataFrame, variants: DataFrame, experiment_id: str | None = None
) -> DataFrame:
    """Assignments with variant names instead of ids, of one experiment or all."""
    if experiment_id is not None:
        assignments = assignments.filter(F.col("experiment_id") == experiment_id)
        variants = variants.filter(F.col("experiment_id") == experiment_id)
    names = variants.select("variant_id", F.col("name").alias("variant"))
    return assignments.join(names, "variant_id").select("user_id", "experiment_id", "variant")


class ControlTables:
    """The four tables in one catalog database, optionally at a given location."""

    def __init__(self, spark: SparkSession, database: str = "default", location: str | None = None):
        self.spark = spark
        self.database = database
        self.location = location.rstrip("/") if location else None

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def create(self) -> None:
        """Create what does not exist yet."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}`")
        for table, (schema, partition) in _TABLES.items():
            kept = [f for f in schema.fields if f.name != partition]
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
            parts = ", ".join(f"{c} string" for c in (_BATCH, partition) if c)
            place = f"LOCATION '{self.location}/{table}'" if self.location else ""
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({columns}, {parts}) "
                f"USING parquet PARTITIONED BY ({', '.join(c for c in (_BATCH, partition) if c)}) {place}"
            )
            if self.location and self._has_folder(table):
                self.spark.sql(f"MSCK REPAIR TABLE {self._name(table)}")

    def _has_folder(self, table: str) -> bool:
        """False before the first append, when there are no partitions to discover."""
        try:
            self.spark.read.schema(_TABLES[table][0]).parquet(f"{self.location}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def _folder(self, table: str) -> str:
        if self.location:
            return f"{self.location}/{table}"
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self._name(table)}")
        return described.filter("col_name = 'Location'").first().data_type

    def _append(self, table: str, rows: DataFrame) -> None:
        """Write a batch into its own folder, then show it to readers in one catalog call."""
        schema, partition = _TABLES[table]
        known = set(rows.columns)
        rows = rows.select(
            *[
                (F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema.fields
            ]
        )
        batch = uuid.uuid4().hex
        path = f"{self._folder(table)}/{_BATCH}={batch}"
        writer = rows.write.partitionBy(partition) if partition else rows.write
        writer.parquet(path)
        spec = [f"{_BATCH} = '{batch}'"]
        if partition:
            values = [r[0] for r in self.spark.read.schema(schema).parquet(path).select(partition).distinct().collect()]
            spec = [f"{spec[0]}, {partition} = '{v}'" for v in sorted(values)]
        if spec:
            added = " ".join(f"PARTITION ({s})" for s in spec)
            self.spark.sql(f"ALTER TABLE {self._name(table)} ADD {added}")

    # Experiments and variants -------------------------------------------------------

    def experiments(self) -> DataFrame:
        return newest_versions(self.read("experiments"))

    def experiment(self, experiment_id: str):
        """The current row of one experiment; raises when there is none."""
        row = self.experiments().filter(F.col("experiment_id") == experiment_id).first()
        if row is None:
            raise LookupError(f"Experiment {experiment_id!r} not found")
        return row

    def add_experiments(self, rows: DataFrame) -> None:
        """Insert experiments that are not there yet; repeating it changes nothing."""
        fresh = absent_rows(rows, self.read("experiments"), ["experiment_id"])
        self._append("experiments", fresh.withColumn("updated_at", F.current_timestamp()))

    def variants(self) -> DataFrame:
        return first_rows(self.read("variants"), ["variant_id"])

    def add_variants(self, rows: DataFrame) -> None:
        self._append("variants", absent_rows(rows, self.read("variants"), ["variant_id"]))

    def stop(self, experiment_id: str) -> None:
        self.experiment(experiment_id)
        rows = self.experiments().filter(F.col("experiment_id") == experiment_id)
        self._append(
            "experiments",
            stopped(rows, experiment_id).withColumn("updated_at", F.current_timestamp()),
        )

    # Assignments --------------------------------------------------------------------

    def add_assignments(self, rows: DataFrame, experiment_ids: Sequence[str] | None = None) -> None:
        """Append (user_id, experiment_id, variant_id) of users not assigned yet.

        The first assignment of a user to an experiment wins. When the caller names the
        experiments in ``rows``, only their partitions are compared with.
        """
        existing = self.read("user_assignments")
        if experiment_ids is not None:
            existing = existing.filter(F.col("experiment_id").isin(*experiment_ids))
        fresh = absent_rows(rows, existing, ["user_id", "experiment_id"])
        self._append(
            "user_assignments",
            fresh.withColumn("assigned_at", F.current_timestamp()).hint(
                "rebalance", "experiment_id"
            ),
        )

    def user_assignments(self) -> DataFrame:
        """One row per user and experiment: the first one assigned."""
        return first_rows(self.read("user_assignments"), ["user_id", "experiment_id"], ["assigned_at"])

    def assignments(self, experiment_id: str | None = None) -> DataFrame:
        return resolve_variants(self.user_assignments(), self.variants(), experiment_id)

    # Results ------------------------------------------------------------------------

    def add_results(self, rows: DataFrame) -> None:
        """Append result rows by variant name, stamped with the time of the run."""
        ids = self.variants().select(
            "experiment_id", F.col("name").alias("variant"), "variant_id"
        )
        stamped = rows.join(ids, ["experiment_id", "variant"], "left").withColumn(
            "variant_id", F.coalesce("variant_id", "variant")
        )
        self._append(
            "experiment_results", stamped.withColumn("computed_at", F.current_timestamp())
        )

    def latest_results(self, experiment_id: str) -> DataFrame:
        """Newest stored rows of one experiment; raises before its first analysis."""
        self.experiment(experiment_id)
        rows = self.read("experiment_results").filter(F.col("experiment_id") == experiment_id)
        if rows.isEmpty():
            raise LookupError(f"No results found for experiment {experiment_id!r}")
        return newest_results(rows)
