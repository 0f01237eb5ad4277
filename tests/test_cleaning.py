import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from liftgrid.operators.cleaning import clean_events, cleaning_report
from liftgrid.schemas import CLEAN_EVENTS
from liftgrid.sources.events import file_layouts, read_events, read_raw_events, register_events, write_events

HEADER = (
    "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session"
)


def write_csv(path, *lines, header=HEADER):
    path.write_text("\n".join([header, *lines]) + "\n")


def test_only_rows_with_keys_and_known_type_survive(spark, tmp_path):
    write_csv(
        tmp_path / "a.csv",
        "2020-01-01 10:00:00 UTC,view,p1,1,cat,b,1.5,,s1",
        "2020-01-01 10:00:00 UTC,view,,1,cat,b,1.5,u1,s1",
        "2020-01-01 10:00:00 UTC,view,p1,1,cat,b,1.5,u1,s1",
        "2020-01-01 10:00:00 UTC,INVALID_TYPE,p1,1,cat,b,1.5,u1,s1",
    )
    raw = read_raw_events(spark, str(tmp_path))
    rows = clean_events(raw).collect()
    assert len(rows) == 1
    assert rows[0].date == dt.date(2020, 1, 1) and rows[0].hour_of_day == 10
    report = {r.reason: r.n_rows for r in cleaning_report(raw).collect()}
    assert report == {"missing_key": 2, "kept": 1, "invalid_event_type": 1}


def test_unreadable_cells_are_coerced_not_dropped(spark, tmp_path):
    write_csv(
        tmp_path / "a.csv",
        "garbage,purchase,p1,1,,,abc,u1,s1",
        "2020-01-01 23:59:59 UTC,purchase,p1,1,NA,b,nan,u2,",
        '2020-01-01 00:00:00 UTC,view,p1,1,"a ""quoted"", code",b,,u3,s',
        "2020-01-01 00:00:00 UTC,view,p1,1,c,b,2,NULL,s",
    )
    rows = {r.user_id: r for r in clean_events(read_raw_events(spark, str(tmp_path))).collect()}
    assert set(rows) == {"u1", "u2", "u3"}
    assert rows["u1"].event_time is None and rows["u1"].date is None and rows["u1"].price == 0.0
    assert rows["u1"].hour_of_day is None
    assert rows["u2"].price == 0.0 and rows["u2"].category_code is None
    assert rows["u2"].user_session is None and rows["u2"].hour_of_day == 23
    assert rows["u3"].category_code == 'a "quoted", code' and rows["u3"].price == 0.0


def test_all_files_of_a_directory_are_read(spark, tmp_path):
    write_csv(tmp_path / "2020-01.csv", "2020-01-01 10:00:00 UTC,view,p1,1,c,b,1,u1,s1")
    write_csv(tmp_path / "2020-02.csv", "2020-02-01 10:00:00 UTC,view,p1,1,c,b,1,u2,s1")
    (tmp_path / "notes.txt").write_text("ignored")
    assert clean_events(read_raw_events(spark, str(tmp_path))).count() == 2


def test_missing_files_and_columns_fail(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_raw_events(spark, str(tmp_path))
    bad = tmp_path / "bad"
    bad.mkdir()
    write_csv(bad / "a.csv", "x,y", header="event_time,user_id")
    with pytest.raises(ValueError, match="lack columns"):
        read_raw_events(spark, str(bad))


def test_files_of_different_headers_are_read_by_name(spark, tmp_path):
    folder = tmp_path / "some files"
    folder.mkdir()
    write_csv(folder / "a.csv", "2020-01-01 10:00:00 UTC,view,p1,1,c,b,1,u1,s1")
    write_csv(
        folder / "b%20.csv", "view,2020-01-02 10:00:00 UTC,p1,1,c,b,1,u2,s1",
        header=HEADER.replace("event_time,event_type", "event_type,event_time"),
    )
    write_csv(
        folder / "c.csv", "u3,2020-01-03 10:00:00 UTC,cart,p1,2.5,s1", "u4,2020-01-03 10:00:00 UTC,cart,p1,2.5,s1",
        header="user_id,event_time,event_type,product_id,price,user_session",
    )
    (folder / "empty.csv").write_text("")
    write_csv(folder / "d.csv", "2020-01-04 10:00:00 UTC,view,p1,1,c,b,1,u5,s1")
    layouts = file_layouts(spark, f"{folder}/*.csv")
    assert sorted(len(paths) for _, paths in layouts) == [1, 1, 2]
    rows = {r.user_id: r for r in clean_events(read_raw_events(spark, str(folder))).collect()}
    assert set(rows) == {"u1", "u2", "u3", "u4", "u5"}
    assert [rows[f"u{k}"].date.day for k in range(1, 6)] == [1, 2, 3, 3, 4]
    assert rows["u3"].event_type == "cart" and rows["u3"].price == 2.5 and rows["u3"].brand is None
    assert rows["u2"].event_type == "view" and rows["u2"].brand == "b"


def test_event_table_round_trip_prunes_dates(spark, tmp_path):
    write_csv(
        tmp_path / "a.csv",
        "2020-01-01 10:00:00 UTC,view,p1,1,c,b,1,u1,s1",
        "2020-01-02 10:00:00 UTC,cart,p1,1,c,b,1,u1,s1",
        "broken,cart,p1,1,c,b,1,u2,s1",
    )
    path = str(tmp_path / "events")
    write_events(clean_events(read_raw_events(spark, str(tmp_path))), path)
    stored = read_events(spark, path)
    assert stored.schema == CLEAN_EVENTS and stored.count() == 3
    day = stored.filter(F.col("date") == dt.date(2020, 1, 2))
    assert day.count() == 1
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().toString()
    assert read_events(spark, path, ["user_id"]).columns == ["user_id"]
    register_events(stored, "stored_events")
    assert spark.sql("SELECT count(*) AS n FROM stored_events").first().n == 3


def test_missing_event_table_reads_empty(spark, tmp_path):
    events = read_events(spark, str(tmp_path / "nothing"))
    assert events.schema == CLEAN_EVENTS and events.count() == 0
