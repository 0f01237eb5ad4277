import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from liftgrid.operators.features import FEATURE_COLUMNS, favorite_category, user_features

SCHEMA = (
    "user_id string, user_session string, event_type string, price double, "
    "category_code string, event_time timestamp, date date"
)


def events(spark, rows):
    out = []
    for user, session, kind, price, category, day in rows:
        date = dt.date(2020, 1, day) if day else None
        time = dt.datetime(2020, 1, day, 12) if day else None
        out.append((user, session, kind, price, category, time, date))
    return spark.createDataFrame(out, SCHEMA)


def by_user(df):
    return {r.user_id: r for r in df.collect()}


def brute_force(rows, as_of=None):
    users = defaultdict(list)
    for row in rows:
        if as_of is None or (row[5] and row[5] < as_of):
            users[row[0]].append(row)
    result = {}
    for user, log in users.items():
        sessions = Counter(r[1] for r in log)
        views = [r for r in log if r[2] == "view"]
        liked = Counter(r[4] for r in views if r[4])
        result[user] = {
            "total_sessions": len([s for s in sessions if s is not None]),
            "total_views": len(views),
            "total_carts": sum(r[2] == "cart" for r in log),
            "total_purchases": sum(r[2] == "purchase" for r in log),
            "total_revenue": sum(r[3] for r in log if r[2] == "purchase"),
            "avg_session_length": len(log) / len(sessions),
            "avg_session_length_event_weighted": sum(n * n for n in sessions.values()) / len(log),
            "days_active": len({r[5] for r in log if r[5]}),
            "favorite_category": min(liked, key=lambda c: (-liked[c], c)) if liked else None,
            "avg_price_viewed": sum(r[3] for r in views) / len(views) if views else 0.0,
        }
    return result


@pytest.fixture(scope="module")
def log():
    """A third of all rows belong to one user, most of them outside any session."""
    rng = random.Random(7)
    kinds = ["view", "view", "view", "cart", "purchase", "remove_from_cart"]
    rows = []
    for i in range(6000):
        hot = i % 3 == 0
        user = "hot" if hot else f"u{rng.randrange(60)}"
        session = None if hot and rng.random() < 0.9 else f"{user}-{rng.randrange(8)}"
        rows.append(
            (user, session, rng.choice(kinds), round(rng.random() * 50, 2),
             rng.choice(["a", "b", "", None, "c"]), rng.choice([None, *range(1, 29)]))
        )
    return rows


@pytest.mark.parametrize("partitions", ["1", "8"])
@pytest.mark.parametrize("as_of", [None, 15])
def test_features_match_brute_force(spark, log, partitions, as_of):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        cutoff = dt.date(2020, 1, as_of) if as_of else None
        got = by_user(user_features(events(spark, log), cutoff))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = brute_force(log, as_of)
    assert set(got) == set(expected)
    for user, row in expected.items():
        for column, value in row.items():
            assert got[user][column] == (
                pytest.approx(value) if isinstance(value, float) else value
            ), (user, column)


def test_contract_and_fixture_users(spark):
    rows = [
        ("u1", "s1", "view", 299.99, "phones", 1), ("u1", "s1", "cart", 299.99, "phones", 1),
        ("u1", "s1", "purchase", 299.99, "phones", 1),
        ("u2", "s2", "view", 10.0, "shoes", 1), ("u2", "s3", "view", 20.0, "bags", 2),
        ("u3", "s4", "purchase", 999.0, "tv", 1), ("u4", "s5", "view", 5.0, None, 1),
    ]
    features = user_features(events(spark, rows))
    assert features.columns[:12] == list(FEATURE_COLUMNS)
    got = by_user(features)
    assert got["u1"].total_revenue == 299.99 and got["u1"].avg_session_length == 3.0
    assert got["u2"].total_sessions == 2 and got["u2"].favorite_category == "bags"
    assert got["u2"].avg_price_viewed == 15.0 and got["u2"].days_active == 2
    assert got["u3"].avg_price_viewed == 0.0 and got["u3"].favorite_category is None
    assert got["u4"].total_revenue == 0.0 and got["u4"].favorite_category is None
    assert got["u1"].first_seen == dt.datetime(2020, 1, 1, 12)


def test_favorite_category_has_one_row_per_viewing_user(spark, log):
    got = favorite_category(events(spark, log))
    assert got.count() == got.select("user_id").distinct().count()


def test_users_without_dates_are_kept(spark):
    got = by_user(user_features(events(spark, [("u", None, "view", 1.0, "a", None)])))
    assert got["u"].days_active == 0 and got["u"].total_sessions == 0
    assert got["u"].avg_session_length == 1.0 and got["u"].first_seen is None
