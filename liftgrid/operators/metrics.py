"""Per-variant metrics: everything reduces to sufficient statistics per arm."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftgrid.operators.assignment import Experiment, assign_all_users

METRICS = ("conversion_rate", "revenue_per_user", "add_to_cart_rate")
ARM = ("experiment_id", "variant")
MEASURES = ("n_purchases", "revenue", "n_carts")
#: What rates are made of; over a long log everybody has some, so rates need a window.
RATES = ("n_purchases", "n_carts")


def window_predicate(start: dt.datetime | None, end: dt.datetime | None) -> Column:
    """Half-open [start, end) on the event time, repeated on the date for pruning."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("date") >= F.lit(start.date())) & (F.col("event_time") >= F.lit(start))
    if end is not None:
        keep = keep & (F.col("date") <= F.lit(end.date())) & (F.col("event_time") < F.lit(end))
    return keep


def _outcomes(events: DataFrame, counted: Column) -> DataFrame:
    purchase = counted & (F.col("event_type") == "purchase")
    return events.groupBy("user_id").agg(
        F.count_if(purchase).alias("n_purchases"),
        F.coalesce(F.sum(F.when(purchase, F.col("price"))), F.lit(0.0)).alias("revenue"),
        F.count_if(counted & (F.col("event_type") == "cart")).alias("n_carts"),
    )


def user_outcomes(
    events: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> DataFrame:
    """Purchases, revenue and carts of users who have any in the window.

    Both filters are plain comparisons on stored columns and reach the scan.
    """
    acting = events.filter(
        F.col("event_type").isin("purchase", "cart") & window_predicate(start, end)
    )
    return _outcomes(acting, F.lit(True))


def all_user_outcomes(
    events: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> DataFrame:
    """The same for every user of the log, zero without any; one scan, one shuffle.

    With ``assign_all_users`` on top, log to arm statistics needs no join.
    """
    return _outcomes(events, window_predicate(start, end))


def assigned_outcomes(
    events: DataFrame, experiments: Sequence[Experiment], windowed: Sequence[str] = MEASURES
) -> DataFrame:
    """Every enrolled user of the log with its outcomes in each experiment's own dates.

    The starts and ends of all experiments cut time into slots; the log is read once into
    sums per user and slot, and an experiment adds up its slots. Measures that are not
    ``windowed`` count the whole log. The cuts travel in the plan as literals.
    """
    cuts = sorted({t for e in experiments for t in (e.start, e.end) if t is not None})
    time = F.col("event_time")
    begun = F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= time) if cuts else F.array()
    slot = F.when(time.isNotNull(), F.size(begun)).otherwise(-1)
    purchase = F.col("event_type") == "purchase"
    cells = events.groupBy("user_id", slot.alias("slot")).agg(
        F.count_if(purchase).alias("n_purchases"),
        F.coalesce(F.sum(F.when(purchase, F.col("price"))), F.lit(0.0)).alias("revenue"),
        F.count_if(F.col("event_type") == "cart").alias("n_carts"),
    )
    users = cells.groupBy("user_id").agg(F.collect_list(F.struct("slot", *MEASURES)).alias("_slots"))

    def reach(e: Experiment) -> tuple[int, int]:
        """Slots from .. to - 1; -1 holds events without a time, which only a whole log counts."""
        after = cuts.index(e.start) + 1 if e.start is not None else 0 if e.end is not None else -1
        return after, cuts.index(e.end) + 1 if e.end is not None else len(cuts) + 1

    spans = {e.experiment_id: reach(e) for e in experiments}
    span = F.create_map(*[
        part for i, (a, b) in spans.items()
        for part in (F.lit(i), F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")))
    ])[F.col("experiment_id")]

    def total(name: str) -> Column:
        inside = F.col("_slots")
        if name in windowed:
            inside = F.filter(inside, lambda s: (s["slot"] >= F.col("_span.from")) & (s["slot"] < F.col("_span.to")))
        zero = F.lit(0.0) if name == "revenue" else F.lit(0).cast("bigint")
        return F.aggregate(inside, zero, lambda sum_, s: sum_ + s[name]).alias(name)

    return assign_all_users(users, experiments).withColumn("_span", span).select(
        "user_id", *ARM, *map(total, MEASURES)
    )


def attach_outcomes(assignments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes of every assigned user; users without any get zeros."""
    return assignments.join(outcomes, "user_id", "left").fillna(
        0, ["n_purchases", "revenue", "n_carts"]
    )


def arm_stats(outcomes: DataFrame, by: Sequence[str] = ARM) -> DataFrame:
    """Sufficient statistics of all metrics per arm, in one aggregation.

    ``by`` may add segment columns. The map side combines to one row per arm and task, so
    an arm with most of the users costs no more than a small one.
    """
    stats = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count_if(F.col("n_purchases") > 0).alias("n_converters"),
        F.count_if(F.col("n_carts") > 0).alias("n_carted"),
        F.avg("revenue").alias("mean_revenue"),
        F.var_samp("revenue").alias("var_revenue"),
    )
    return stats.withColumns(
        {
            "conversion_rate": F.try_divide(F.col("n_converters"), F.col("n_users")),
            "std_revenue": F.coalesce(F.sqrt("var_revenue"), F.lit(0.0)),
            "add_to_cart_rate": F.try_divide(F.col("n_carted"), F.col("n_users")),
        }
    )


def compute_all_metrics(
    events: DataFrame,
    assignments: DataFrame,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """Arm statistics of every experiment in ``assignments``."""
    return arm_stats(attach_outcomes(assignments, user_outcomes(events, start, end)))


def conversion_rate(stats: DataFrame) -> DataFrame:
    return stats.select(*ARM, "n_users", "n_converters", "conversion_rate")


def revenue_per_user(stats: DataFrame) -> DataFrame:
    return stats.select(*ARM, "n_users", "mean_revenue", "std_revenue")


def add_to_cart_rate(stats: DataFrame) -> DataFrame:
    return stats.select(*ARM, "n_users", "n_carted", "add_to_cart_rate")


def variant_cards(stats: DataFrame) -> DataFrame:
    return stats.select(*ARM, "n_users", "conversion_rate", "mean_revenue", "add_to_cart_rate")


def control_of(stats: DataFrame, by: Sequence[str] = ("experiment_id",)) -> Column:
    """Control arm of each experiment: flagged, else named control, else first by name."""
    group = Window.partitionBy(*by)
    choices = [
        F.max(F.when(F.col("variant") == "control", F.col("variant"))).over(group),
        F.min("variant").over(group),
    ]
    if "is_control" in stats.columns:
        choices.insert(0, F.min(F.when(F.col("is_control"), F.col("variant"))).over(group))
    return F.coalesce(*choices)


def pair_with_control(stats: DataFrame, by: Sequence[str] = ("experiment_id",)) -> DataFrame:
    """One row per treatment arm with the control arm's statistics beside its own.

    Window aggregates instead of a self-join: the arms are computed once.
    """
    group = Window.partitionBy(*by)
    measures = [
        c for c in stats.columns if c not in (*by, "variant", "is_control")
    ]
    control_row = F.when(F.col("variant") == F.col("control"), F.struct(*measures))
    return (
        stats.withColumn("control", control_of(stats, by))
        .withColumn("control_arm", F.max(control_row).over(group))
        .filter(F.col("variant") != F.col("control"))
        .select(
            *by, "control", "variant",
            *[F.col("control_arm")[c].alias(f"control_{c}") for c in measures],
            *[F.col(c).alias(f"treatment_{c}") for c in measures],
        )
    )


def daily_conversion(
    events: DataFrame,
    assignments: DataFrame,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """Share of the day's active users who bought that day, per experiment and variant.

    This definition is ours; the novelty check only needs one rate per day.
    """
    days = user_days(events, start, end)
    return daily_rates(days.join(assignments.select("user_id", *ARM), "user_id"))


def user_days(
    events: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> DataFrame:
    """Active days of each user, and whether the user bought on them.

    With ``assign_all_users`` on top, the log is read once and nothing is joined.
    """
    return (
        events.filter(F.col("date").isNotNull() & window_predicate(start, end))
        .groupBy("user_id", "date")
        .agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"))
    )


def daily_rates(assigned_days: DataFrame) -> DataFrame:
    """Rates per experiment, variant and day of assigned ``user_days``."""
    return (
        assigned_days.groupBy(*ARM, "date")
        .agg(
            F.count(F.lit(1)).alias("n_active"),
            F.sum("bought").alias("n_purchasers"),
            F.avg("bought").alias("conversion_rate"),
        )
    )
