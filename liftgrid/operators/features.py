"""Clean events to one feature row per user."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the feature table (fixed values).
FEATURE_COLUMNS = (
    "user_id", "total_sessions", "total_views", "total_carts", "total_purchases",
    "total_revenue", "avg_session_length", "days_active", "first_seen", "last_seen",
    "favorite_category", "avg_price_viewed",
)


def before(events: DataFrame, as_of: dt.date | None) -> DataFrame:
    """Events strictly before a day, for features that must not see the experiment."""
    return events if as_of is None else events.filter(F.col("date") < F.lit(as_of))


def favorite_category(events: DataFrame) -> DataFrame:
    """Most viewed category per user; ties go to the alphabetically first."""
    counts = (
        events.filter(
            (F.col("event_type") == "view")
            & F.col("category_code").isNotNull()
            & (F.col("category_code") != "")
        )
        .groupBy("user_id", "category_code")
        .agg(F.count(F.lit(1)).alias("n_views"))
    )
    first = F.min(F.struct((-F.col("n_views")).alias("n"), "category_code"))
    return (
        counts.groupBy("user_id")
        .agg(first.alias("first"))
        .select(
            "user_id", F.col("first.category_code").alias("favorite_category"),
            (-F.col("first.n")).alias("n_views"),
        )
    )


# grouping_id of (user_id, user_session, date, liked): a bit is set where a column is left out.
_BY_SESSION, _BY_DAY, _BY_CATEGORY = 0b0011, 0b0101, 0b0110


def _cells(events: DataFrame) -> DataFrame:
    """One row per user and session, user and day, user and viewed category, from one scan.

    The three groupings share an aggregate and a shuffle. Each is finer than the user, so a
    hot user is spread over the cluster, the map side combines, and distinct counts of
    sessions and days become counts of rows. A bitmap of days would need no rows of its own
    but takes 4 KB per user and session; a row per day takes a few bytes.
    """
    view = F.col("event_type") == "view"
    purchase = F.col("event_type") == "purchase"
    liked = F.when(view & (F.col("category_code") != ""), F.col("category_code"))
    columns = ["user_id", "user_session", "date", "liked"]
    return events.select(
        *columns[:3], liked.alias("liked"), "event_type", "price", "event_time"
    ).groupingSets(
        [["user_id", c] for c in columns[1:]], *columns
    ).agg(
        F.grouping_id().alias("grouping"),
        F.count(F.lit(1)).cast("double").alias("n"),
        F.count_if(view).alias("views"),
        F.count_if(F.col("event_type") == "cart").alias("carts"),
        F.count_if(purchase).alias("purchases"),
        F.sum(F.when(purchase, F.col("price"))).alias("revenue"),
        F.sum(F.when(view, F.col("price"))).alias("viewed_price"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
    )


def user_features(events: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """All per-user features: one scan, one shuffle of cells, one of users, no join.

    ``avg_session_length`` averages over sessions; the ``_event_weighted`` column
    averages over events, so long sessions count more. Events without a session form
    one group for the lengths but are no session in ``total_sessions``.
    """
    session = F.col("grouping") == _BY_SESSION
    day = (F.col("grouping") == _BY_DAY) & F.col("date").isNotNull()
    category = (F.col("grouping") == _BY_CATEGORY) & F.col("liked").isNotNull()
    of_sessions = lambda value: F.when(session, value)
    total = lambda name: F.sum(of_sessions(F.col(name)))
    favorite = F.min(F.when(category, F.struct((-F.col("views")).alias("n"), F.col("liked").alias("category"))))
    return (
        _cells(before(events, as_of))
        .groupBy("user_id")
        .agg(
            F.count(of_sessions(F.col("user_session"))).alias("total_sessions"),
            total("views").alias("total_views"),
            total("carts").alias("total_carts"),
            total("purchases").alias("total_purchases"),
            F.coalesce(total("revenue"), F.lit(0.0)).alias("total_revenue"),
            F.avg(of_sessions(F.col("n"))).alias("avg_session_length"),
            (F.sum(of_sessions(F.col("n") * F.col("n"))) / total("n")).alias("avg_session_length_event_weighted"),
            F.count_if(day).alias("days_active"),
            F.min(of_sessions(F.col("first_seen"))).alias("first_seen"),
            F.max(of_sessions(F.col("last_seen"))).alias("last_seen"),
            favorite["category"].alias("favorite_category"),
            F.coalesce(F.try_divide(total("viewed_price"), total("views")), F.lit(0.0)).alias("avg_price_viewed"),
        )
        .select(*FEATURE_COLUMNS, "avg_session_length_event_weighted")
    )
