"""Streams give what the same job gives on a table, and drop late rows."""

import datetime as dt
import os
import random

import pytest

from tallymark.sources import writers
from tallymark.streaming import provenance, rates

SCHEMA = "user_id int, ts timestamp_ntz"


def at(minute, second=0, hour=0):
    return dt.datetime(2024, 1, 1, hour, minute, second)


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, folder):
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    query = rates.stream_to_parquet(rates.rate_breaches(stream, "1 minute", 2), str(tmp_path / "out"),
                                    str(tmp_path / "state"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted((r["user_id"], r["window_start"], r["request_count"]) for r in rows)


def test_stream_equals_batch_and_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = [(1, at(0, s)) for s in (1, 2, 3)] + [(2, at(0, 5))] * 2 + [(1, at(5, s)) for s in range(4)]
    write(spark, folder, rows + [(9, at(0, hour=3))])
    batch = sorted((r["user_id"], r["window_start"], r["request_count"]) for r in
                   rates.rate_breaches(spark.read.parquet(folder), "1 minute", 2).collect())
    assert run(spark, tmp_path, folder) == batch == [(1, at(0), 3), (1, at(5), 4)]
    # Far behind the watermark: these would be a breach, but their window is closed.
    write(spark, folder, [(2, at(0, 7))] * 5 + [(9, at(30, hour=3))])
    assert run(spark, tmp_path, folder) == batch


def test_named_limits(spark):
    df = spark.createDataFrame([(1, at(0, s)) for s in range(11)], SCHEMA)
    assert rates.named_breaches(df, "upload_burst").count() == 1
    assert rates.named_breaches(df, "chat_burst").count() == 0


LIMITS = {"burst": ("1 minute", 2), "sharp_burst": ("1 minute", 3), "hourly": ("1 hour", 4), "daily": ("1 day", 8)}


def every_limit(spark, tmp_path, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = rates.stream_to_parquet(rates.all_breaches(stream, LIMITS), str(tmp_path / "all"), str(tmp_path / "kept"))
    query.awaitTermination()
    return found(spark.read.parquet(str(tmp_path / "all"))), query


def found(df):
    return sorted(((r["limit_name"], r["user_id"] or 0, r["window_start"], r["window_end"], r["request_count"])
                   for r in df.collect()), key=str)


def test_all_limits_from_one_pass(spark, tmp_path):
    folder, rng = str(tmp_path / "events"), random.Random(5)
    for hour in range(0, 48, 6):  # in order of time, one file after the other
        start = dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)
        rows = [(rng.choice([1, 2, None]), start + dt.timedelta(seconds=rng.choice([rng.randrange(300), rng.randrange(21_600)])))
                for _ in range(25)]
        spark.createDataFrame(rows + [(3, None)], SCHEMA).coalesce(1).write.parquet(f"{folder}/{hour:02d}")
    folder += "/*"
    batch = found(rates.all_breaches(spark.read.parquet(folder), LIMITS))
    assert {b[0] for b in batch} == set(LIMITS)
    for name, (window, most) in LIMITS.items():
        one = rates.rate_breaches(spark.read.parquet(folder), window, most)
        assert found(one.selectExpr(f"'{name}' AS limit_name", "*")) == [b for b in batch if b[0] == name]

    last = spark.read.parquet(folder).selectExpr("max(ts)").first()[0] - dt.timedelta(minutes=10)
    got, query = every_limit(spark, tmp_path, folder)
    assert got == [b for b in batch if b[3] <= last]
    states = query.lastProgress["stateOperators"]
    assert len(states) == 2, "one count of the shortest windows, one state of the longer ones"
    # Late rows change no window, of whatever length; the rest closes as time goes on.
    late = [(1, dt.datetime(2024, 1, 1, 0, 1))] * 9
    spark.createDataFrame(late + [(4, dt.datetime(2024, 1, 9))], SCHEMA).coalesce(1).write.parquet(folder[:-1] + "99")
    assert every_limit(spark, tmp_path, folder)[0] == batch


def test_limits_need_windows_that_nest(spark):
    df = spark.createDataFrame([(1, at(0))], SCHEMA)
    with pytest.raises(ValueError, match="multiples"):
        rates.all_breaches(df, {"a": ("2 minutes", 1), "b": ("5 minutes", 1)})
    assert rates.all_breaches(df.limit(0)).count() == 0


def test_daily_outcomes_stay_current(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))

    def add(day, success):
        writers.log_query(spark, log, "c", "u", "q", None, success, execution_time=0.5,
                          timestamp=dt.datetime(2024, 1, day, 9))

    for day, success in ((1, True), (1, False), (2, True)):
        add(day, success)
    provenance.maintain_daily_outcomes(spark, log, out, state).awaitTermination()
    add(2, True)
    provenance.maintain_daily_outcomes(spark, log, out, state).awaitTermination()
    got = {(r["day"].day, r["success"]): r["query_count"]
           for r in provenance.current_daily_outcomes(spark, out).collect()}
    batch = {(r["day"].day, r["success"]): r["query_count"]
             for r in provenance.daily_outcomes(writers.read_provenance(spark, log)).collect()}
    assert got == batch == {(1, True): 1, (1, False): 1, (2, True): 2}


def test_compaction_bounds_the_folder_and_replays_change_nothing(spark, tmp_path):
    out, want = str(tmp_path / "out"), {}

    def batch(n):
        day, rows = dt.date(2024, 1, 1) + dt.timedelta(days=n // 3), [(n // 3, True), (n // 3, False)]
        return spark.createDataFrame([(day, s, n + 1, float(n)) for _, s in rows[:1 + n % 2]],
                                     provenance.NEWEST).coalesce(1)

    def current():
        rows = provenance.current_daily_outcomes(spark, out).collect()
        assert len({(r["day"], r["success"]) for r in rows}) == len(rows)
        return {(r["day"], r["success"]): (r["query_count"], r["total_seconds"]) for r in rows}

    assert current() == {}
    before = None
    for n in range(50):
        if n == 30:  # a reader that planned before two batches and no compaction since
            before = provenance.current_daily_outcomes(spark, out)
            planned = dict(want)
        provenance.keep_batch(batch(n), n, out, compact_every=5)
        want.update({(r["day"], r["success"]): (r["query_count"], r["total_seconds"]) for r in batch(n).collect()})
        names = os.listdir(out)
        assert sum(x.startswith("batch=") for x in names) <= 10 and sum(x.startswith("base=") for x in names) <= 2
        if n == 34:  # one compaction later its files are still there
            assert {(r["day"], r["success"]): (r["query_count"], r["total_seconds"]) for r in before.collect()} == planned
        if n in (3, 4, 5, 44, 49):
            assert current() == want
            provenance.keep_batch(batch(n), n, out, compact_every=5)  # the batch again
            assert current() == want
    with pytest.raises(ValueError, match="another checkpoint"):
        provenance.keep_batch(batch(0), 0, out, compact_every=5)
    assert current() == want


def test_a_base_without_its_pointer_is_not_read(spark, tmp_path):
    out = str(tmp_path / "out")
    row = spark.createDataFrame([(dt.date(2024, 1, 1), True, 3, 1.0)], provenance.NEWEST)
    provenance.keep_batch(row, 0, out, compact_every=5)
    row.selectExpr("day", "success", "query_count + 90 AS query_count", "total_seconds", "9L AS batch").write.parquet(
        f"{out}/base=9")
    assert [r["query_count"] for r in provenance.current_daily_outcomes(spark, out).collect()] == [3]
