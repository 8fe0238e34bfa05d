"""Profiles, exact medians and running totals against plain Python."""

import datetime as dt
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark.operators import profile as P
from tallymark.operators.quantiles import exact_medians
from tallymark.sources import writers
from tallymark.operators.running import Running, running_totals


@pytest.mark.parametrize("limit, bins", [(10 ** 6, 64), (50, 16), (1, 4), (3, 3)])
def test_medians_by_brackets(spark, limit, bins):
    rng = random.Random(limit * 31 + bins)
    columns = {
        "wide": [rng.uniform(-1e12, 1e12) for _ in range(999)] + [None],
        "skewed": [rng.choice([1.0, 1.0, 1.0, 2.0, 1e15]) for _ in range(1000)],
        "even": [float(i) for i in range(1000)],
        "constant": [7.0] * 1000,
        "gap": [0.0] * 500 + [10.0] * 500,
        "tiny": [rng.gauss(0, 1e-9) for _ in range(1000)],
        "nothing": [None] * 1000,
        "nan": [float("nan")] * 999 + [4.0],
    }
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    got = {r["column_name"]: r["median"] for r in
           exact_medians(df, list(columns), limit=limit, bins=bins).collect()}
    assert got.pop("nothing") is None and got.pop("nan") == 4.0
    for name, value in got.items():
        want = statistics.median(v for v in columns[name] if v is not None)
        assert value == pytest.approx(want, rel=1e-12, abs=1e-300), name


def test_running_totals_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randint(0, 9))
            for i in range(500)] + [(500, None, 4), (501, None, 5)]
    df = spark.createDataFrame(rows, "seq int, k string, v int").withColumn("half", F.col("seq") % 2)
    got = running_totals(df, ["seq"], F.floor(F.col("seq") / 17),
                         Running(["k"], {"total": F.col("v"), "nth": F.lit(1)}),
                         Running(["half"], {"by_half": F.col("v")})).collect()
    sums, counts, halves, want = {}, {}, {}, {}
    for seq, k, v in rows:
        sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1
        halves[seq % 2] = halves.get(seq % 2, 0) + v
        want[seq] = (sums[k], counts[k], halves[seq % 2])
    assert {r["seq"]: (r["total"], r["nth"], r["by_half"]) for r in got} == want


def test_full_profile(spark):
    rows = [(1, 2.0, "ab", dt.datetime(2024, 1, 1), True), (2, float("nan"), None, None, False),
            (None, 4.0, "abcd", dt.datetime(2024, 1, 3, 1), None)]
    df = spark.createDataFrame(
        rows, "patient_id int, amount double, status string, created timestamp_ntz, active boolean")
    got = {r["column_name"]: r for r in P.full_profile(df, "t").collect()}
    assert got["amount"]["null_count"] == 1 and got["amount"]["median"] == 3.0
    assert got["patient_id"]["semantic_hints"] == ["identifier"]
    assert got["status"]["min_length"] == 2 and got["status"]["avg_length"] == 3.0
    assert got["created"]["range_days"] == 2
    assert (got["active"]["true_count"], got["active"]["false_count"]) == (1, 1)
    assert got["status"]["sample_values"] == ["ab", "abcd"]
    assert got["active"]["data_category"] == "boolean"
    listed = writers.profile_catalog(P.full_profile(df, "t")).first()
    assert (listed["column_count"], listed["columns"]) == (5, sorted(df.columns))


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert {r["null_percentage"] for r in P.profile_nulls(df).collect()} == {None}
    assert P.profile_table(df).first()["null_percentage"] is None
    assert P.profile_numeric(df).first()["median"] is None


def test_narrowing_edges(spark):
    rows = [(-128, -129, 32767, -2147483648, 2147483648), (127, 0, 0, 2147483647, 0)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long, e long")
    got = {r["column_name"]: r["narrow_type"] for r in P.narrow_types(df).collect()}
    assert got == {"a": "byte", "b": "short", "c": "short", "d": "int", "e": "long"}
    assert [t for _, t in P.narrow(df).dtypes] == ["tinyint", "smallint", "smallint", "int", "bigint"]


def test_low_cardinality(spark):
    df = spark.createDataFrame([("x", str(i)) for i in range(10)], "same string, all string")
    got = {r["column_name"]: r["is_low_cardinality"] for r in P.low_cardinality(df).collect()}
    assert got == {"same": True, "all": False}


def test_patterns_and_pieces(spark):
    values = ["a@b.co", "2024-01-05 10:00", "1/2/24", "12345", "Start: 01/01/1995", "ab", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = P.column_patterns(df).first()
    assert (got["contains_digits"], got["contains_letters"], got["is_email"], got["is_date_like"],
            got["is_numeric_string"]) == (4, 3, 1, 2, 1)
    pieces = P.top_pieces(spark.createDataFrame([("abc",), ("abd",), ("abc",), ("ab",)], "v string"))
    rows = [(r["kind"], r["piece"], r["n"]) for r in pieces.orderBy("kind", "position").collect()]
    assert rows == [("prefix", "abc", 2), ("prefix", "abd", 1), ("suffix", "abc", 2),
                    ("suffix", "abd", 1), ("value", "abc", 2), ("value", "ab", 1), ("value", "abd", 1)]


def test_approximate_modes(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) AS s")
    assert {r["unique_count"] for r in P.profile_nulls(df, exact=False).collect()} >= {7}
    assert P.profile_numeric(df, exact=False).first()["median"] == pytest.approx(499.5, abs=2)


def test_samples_are_the_smallest_distinct_values(spark):
    rows = [("NA",), ("CA",), ("GA",), ("PA",), ("VA",), ("CA",), (None,)]
    got = P.sample_values(spark.createDataFrame(rows, "state string")).orderBy("position").collect()
    assert [r["value"] for r in got] == ["CA", "GA", "NA", "PA", "VA"]


def test_distinct_keys_are_exact_for_every_kind_and_width(spark):
    """Wide and narrow decimals, scales, signs, zeros of doubles, NaN, dates and texts, against DISTINCT."""
    cents = [0, 1, -1, 10, 100, 12345, -99999, 2**62, 2**63 - 1]
    rows = [(Decimal(c).scaleb(-2), Decimal(c * 10**k).scaleb(-8), Decimal(c * 10**k), c, c % 5, float(c) * (-1) ** k, str(c))
            for c in cents for k in (0, 1, 12)]
    rows += [(None,) * 7, (None,) * 7, (None, None, None, None, None, float("nan"), "")]
    df = spark.createDataFrame(rows, "narrow decimal(21,2), scaled decimal(38,8), whole decimal(38,0), big bigint, "
                                     "small int, double double, text string")
    df = df.withColumn("fits", F.expr("try_cast(narrow AS decimal(12,2))")).withColumn("day", F.expr("date_add(DATE'2001-01-01', small)"))
    found = {r["column_name"]: (r["unique_count"], r["null_count"]) for r in P.profile_nulls(df).collect()}
    for name in df.columns:
        c = F.when(~F.isnan("double"), F.col("double")) if name == "double" else F.col(name)
        want = df.agg(F.count_distinct(c), F.count_if(c.isNull())).first()
        assert found[name] == tuple(want), name


def test_keys_of_numbers_are_their_values(spark):
    """Not a hash, which would not pack: wide decimals too while they fit a long."""
    df = spark.sql("SELECT CAST(12.34 AS decimal(21,2)) AS d, 7 AS i")
    keys = {r["position"]: (r["a"], r["b"]) for r in P._key_counts(df, df.columns).collect()}
    assert keys == {"0": (1234, 0), "1": (7, 0)}
