"""Merged states against exact profiles, and the store that profiles only new files."""

import pytest
from pyspark.sql import functions as F

from tallymark.operators import profile as P
from tallymark.operators import profile_states as S
from tallymark.workloads import registry, views as V


def table(spark):
    return spark.range(20_000).select(
        (F.col("id") % 5_003).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("x"),
        F.concat(F.lit("t"), F.col("id") % 40).alias("t"), (F.col("id") % 2 == 0).alias("b"),
        F.timestamp_millis(F.col("id") * 1000).cast("timestamp_ntz").alias("at"),
        F.when(F.col("id") < 0, 1.0).alias("none"))


EXACT = ("null_count", "null_percentage", "min", "max", "min_length", "max_length", "avg_length", "min_time",
         "max_time", "range_days", "true_count", "false_count")


def test_halves_merge_into_the_whole(spark):
    df = table(spark)
    halves = S.states(df.where("k % 3 = 0"), "t", F.lit("a")).unionByName(
        S.states(df.where("k % 3 <> 0"), "t", F.lit("b")))
    merged = {r["column_name"]: r for r in S.profile(S.merge(halves)).collect()}
    whole = {r["column_name"]: r for r in S.profile(S.merge(S.states(df, "t"))).collect()}
    assert set(merged) == set(df.columns)
    exact = {r["column_name"]: r["unique_count"] for r in P.profile_nulls(df).collect()}
    numbers = {r["column_name"]: r for r in P.profile_numeric(df).collect()}
    for c in df.columns:
        assert [merged[c][f] for f in EXACT] == [whole[c][f] for f in EXACT], c
        for got in (merged[c], whole[c]):
            assert abs(got["unique_count"] - exact[c]) <= S.DISTINCT_ERROR * exact[c] + 1, c
            if c in ("k", "x"):
                span = numbers[c]["max"] - numbers[c]["min"]
                assert abs(got["median"] - numbers[c]["median"]) <= 2 * S.RANK_ERROR * span
                assert got["mean"] == pytest.approx(numbers[c]["mean"])
                assert got["std"] == pytest.approx(numbers[c]["std"])
    assert merged["none"]["median"] is None and merged["none"]["unique_count"] == 0


def test_empty_table(spark):
    rows = S.profile(S.merge(S.states(table(spark).limit(0), "t", F.lit("p")))).collect()
    assert rows == []


def test_only_changed_files_are_profiled(spark, sf_dir, tmp_path):
    """Over all tables: a second run profiles none; a new file alone is added, a removed one leaves."""
    tables = {t: f"{sf_dir}/{t}.parquet" for t in V.TABLES}
    store = str(tmp_path / "store")
    assert S.refresh(spark, tables, store) == 14
    assert S.refresh(spark, tables, store) == 0
    profiled = S.stored_profile(spark, tables, store)
    assert profiled.select("table_name").distinct().count() == 14
    rows = spark.read.parquet(tables["orders"]).count()
    got = profiled.filter("table_name = 'orders' AND column_name = 'o_orderkey'").first()
    assert got["null_count"] == 0 and abs(got["unique_count"] - rows) <= S.DISTINCT_ERROR * rows

    own = {"mine": str(tmp_path / "mine")}
    spark.range(10).write.parquet(own["mine"])
    first = S.refresh(spark, own, store)
    spark.range(10, 30).coalesce(1).write.mode("append").parquet(own["mine"])
    assert S.refresh(spark, own, store) == 1 and first >= 1
    both = S.stored_profile(spark, own, store).first()
    assert (both["min"], both["max"], both["mean"]) == (0.0, 29.0, 14.5)


@pytest.mark.parametrize("candidates, tracked", [(100, 10_000), (6, 64), (20, 128)])
def test_frequent_pieces_equal_full_counts(spark, candidates, tracked):
    """Skewed, flat and short columns; small counters force the full count of some."""
    df = spark.range(6_000).select(
        F.when(F.col("id") % 3 == 0, "hot one").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("skewed"),
        F.concat(F.col("id").cast("string"), F.lit("-"), F.col("id") % 7).alias("flat"),
        F.when(F.col("id") % 4 > 0, F.substring(F.lit("abcd"), (F.col("id") % 3 + 1).cast("int"), F.lit(2))).alias("short"))
    got = sorted(map(tuple, P.top_pieces(df, 5, candidates, tracked).collect()))
    counts = P._counted(df, df.columns, None).collect()
    want = []
    for column in df.columns:
        for kind in P.PIECE_KINDS:
            mine = sorted((-r["n"], r["piece"]) for r in counts if (r["column_name"], r["kind"]) == (column, kind))
            want += [(column, kind, piece, -n, i + 1) for i, (n, piece) in enumerate(mine[:5])]
    assert got == sorted(want)


def test_frequent_pieces_do_not_shuffle_every_value(spark):
    """Where the bound holds, the exact count shuffles candidates alone."""
    df = spark.range(30_000).select(F.concat(F.lit("p"), F.col("id") % 6, F.lit("x"), F.when(
        F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id"))).alias("c"))
    listed = P.frequent_candidates(df, ["c"], 100, 10_000)
    assert listed.count() <= 300
    held = P._counted(df, ["c"], listed.select("column_name", "kind", "hash"))
    assert held.where("kind = 'value'").count() <= 100
    top = [r["n"] for r in P.top_pieces(df).where("kind = 'value'").orderBy("position").collect()]
    assert top == [5_000, 5_000, 5_000, 1, 1]


def test_merged_profile_counts_only_what_it_compares(spark, sf_dir, monkeypatch):
    """The unique visit ids are not counted, and both of its tables are made in small tasks."""
    counted, staged = [], []
    nulls, stage = registry.P.profile_nulls, registry.stage_table
    monkeypatch.setattr(registry.P, "profile_nulls", lambda df: counted.append(df.columns) or nulls(df))
    monkeypatch.setattr(registry, "stage_table", lambda df, label, small_tasks=False: staged.append(
        (label, small_tasks)) or stage(df, label, small_tasks))
    rows = registry.QUERIES["merged_profile"](spark, sf_dir).collect()
    assert {r["column_name"] for r in rows} == {"charge", "balance", "unit", "total_payment"} == set(counted[0])
    assert staged == [("profiled", True), ("merged_profile", True)]
