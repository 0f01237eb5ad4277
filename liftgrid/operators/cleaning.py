"""Raw events to clean events: type coercion, row filters, calendar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.schemas import CLEAN_EVENTS

# Event types an analysis knows (fixed values).
VALID_EVENT_TYPES = ("view", "cart", "purchase", "remove_from_cart")


def _has_keys() -> Column:
    present = [
        F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in ("user_id", "product_id")
    ]
    return present[0] & present[1]


def clean_events(raw: DataFrame) -> DataFrame:
    """Drop rows without user, product or a known event type; coerce the rest.

    An unreadable time stays as NULL (with NULL date and hour), an unreadable price
    becomes 0.0. Row filters come first so they reach the scan. Works unchanged on a
    stream.
    """
    kept = raw.filter(_has_keys() & F.col("event_type").isin(*VALID_EVENT_TYPES))
    for column in ("category_id", "category_code", "brand"):
        if column not in raw.columns:
            kept = kept.withColumn(column, F.lit(None).cast("string"))
    price = F.col("price").try_cast("double")
    return (
        kept.withColumn("event_time", F.col("event_time").try_cast("timestamp"))
        .withColumns(
            {
                "date": F.to_date("event_time"),
                "hour_of_day": F.hour("event_time"),
                "price": F.coalesce(F.nanvl(price, F.lit(0.0)), F.lit(0.0)),
                "user_id": F.col("user_id").cast("string"),
                "product_id": F.col("product_id").cast("string"),
            }
        )
        .select(*CLEAN_EVENTS.names)
    )


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Rows by fate: kept, or the first rule that drops them."""
    fate = (
        F.when(~F.coalesce(_has_keys(), F.lit(False)), "missing_key")
        .when(
            ~F.coalesce(F.col("event_type").isin(*VALID_EVENT_TYPES), F.lit(False)),
            "invalid_event_type",
        )
        .otherwise("kept")
    )
    return raw.groupBy(fate.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
