"""Column and table profiles in long form, one row per column.

All plain statistics of a table come from one aggregation over one scan; the
wide one-row result is then turned into rows. Distinct counts and frequent
values share one grouping by column and value.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import exprs as X
from tallymark.operators.quantiles import exact_medians
from tallymark.session import stage_table

SAMPLE_SIZE = 5
TOP_K = 5
PIECE_LENGTH = 3
PIECE_KINDS = ("value", "prefix", "suffix")
CARDINALITY_SHARE = 0.5
CARDINALITY_LIMIT = 1000

# Tag -> parts of a column name that earn it.
SEMANTIC_TAGS = {
    "identifier": ("id", "_id", "key", "code"),
    "name": ("name", "title", "label"),
    "temporal": ("date", "time", "timestamp", "created", "updated"),
    "financial": ("price", "cost", "revenue", "amount", "salary", "fee"),
    "quantity": ("quantity", "count", "qty", "num", "total"),
    "contact_info": ("email", "phone", "address", "contact"),
    "status": ("status", "state", "flag", "active"),
    "category": ("category", "type", "class", "group"),
    "percentage": ("percent", "rate", "ratio"),
}

# What counts as a text pattern; our own definitions.
PATTERNS = {
    "contains_digits": "[0-9]",
    "contains_letters": "[A-Za-z]",
    "contains_special": r"[^A-Za-z0-9\s]",
    "is_email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "is_date_like": r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})",
    "is_numeric_string": "^[0-9]+$",
}

# Ranges of the narrow integer types.
INTEGER_RANGES = (("byte", -128, 127), ("short", -32768, 32767),
                  ("int", -2147483648, 2147483647))


def category(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.StringType):
        return "text"
    return "other"


def columns_of(df: DataFrame, *categories: str) -> list[str]:
    return [f.name for f in df.schema.fields if category(f.dataType) in categories]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _number(df: DataFrame, name: str) -> Column:
    """Numeric column with NaN as null."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(_c(name)), _c(name))
    return _c(name)


def _present(df: DataFrame, name: str) -> Column:
    return _number(df, name) if category(df.schema[name].dataType) == "numeric" else _c(name)


def _per_column(df: DataFrame, names: Sequence[str], stats) -> DataFrame:
    """``stats(name)`` maps output names to aggregates; one output row per column."""
    if not names:
        raise ValueError("no column of the asked kind")
    aggregates, structs = [], []
    for i, name in enumerate(names):
        fields = [F.lit(name).alias("column_name")]
        for stat, c in stats(name).items():
            aggregates.append(c.alias(f"s{i}_{stat}"))
            fields.append(F.col(f"s{i}_{stat}").alias(stat))
        structs.append(F.struct(*fields))
    return df.agg(*aggregates).select(F.inline(F.array(*structs)))


# --- column statistics ------------------------------------------------------------


def _as_text(df: DataFrame, name: str) -> Column:
    """Value as text, equal for equal values: the zeros of doubles are one."""
    present = _present(df, name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        present = present + F.lit(0.0)
    return present.cast("string")


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, value, n): how often each value occurs, nulls included.

    Counts are combined per task, so a value holding most of a column is one
    row per task in the shuffle.
    """
    text = df.select(*[_as_text(df, c).alias(c) for c in names])
    return (text.unpivot([], [_c(c) for c in names], "column_name", "value")
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def canonical(df: DataFrame, name: str) -> Column:
    """The value in a form that hashes alike for equal values: one zero of doubles, maps as text."""
    kind, present = df.schema[name].dataType, _present(df, name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return present + F.lit(0.0)
    return present if isinstance(kind, T.AtomicType) else present.cast("string")


def _key(df: DataFrame, name: str) -> Column:
    """Two longs that tell the values of a column apart; null for nulls.

    Whole numbers and decimals that fit a long are their own key, which packs into a
    third of a hash. Other values have two 64-bit hashes, made in place in their own
    kind; two such values count as one only if all 128 bits agree.
    """
    kind, value = df.schema[name].dataType, canonical(df, name)
    key = F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))
    whole = None
    if isinstance(kind, T.IntegralType):
        whole = value.cast("bigint")
    # Exact while the product keeps its scale: its digits are those of both and one more.
    elif isinstance(kind, T.DecimalType) and kind.precision + kind.scale + 2 <= 38:
        whole = (value * F.lit(Decimal(10 ** kind.scale))).try_cast("bigint")
    if whole is not None:
        key = F.when(whole.isNotNull(), F.struct(whole.alias("a"), F.lit(0).cast("bigint").alias("b"))).otherwise(key)
    return F.when(value.isNotNull(), key)


def _key_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(position, a, b, n): how often each value of the ``position``-th name occurs, by its key."""
    places = [str(i) for i in range(len(names))]
    wide = df.select(*[_key(df, c).alias(i) for i, c in zip(places, names)])
    return (wide.unpivot([], [_c(i) for i in places], "position", "value")
            .groupBy("position", F.col("value.a").alias("a"), F.col("value.b").alias("b"))
            .agg(F.count(F.lit(1)).alias("n")))


def profile_nulls(df: DataFrame, exact: bool = True) -> DataFrame:
    """Null count and percentage, and distinct values, of every column.

    Distinct values are counted by keys of two longs by default, which costs one
    shuffle of them; otherwise by a sketch within one plain aggregation.
    """
    if exact:
        counted = _key_counts(df, df.columns).groupBy("position").agg(
            F.sum("n").alias("_rows"), F.count("a").alias("unique_count"),
            F.sum(F.when(F.col("a").isNull(), F.col("n"))).alias("_nulls"))
        listed = df.sparkSession.createDataFrame(
            [(str(i), c) for i, c in enumerate(df.columns)], "position string, column_name string")
        # A row per column; the keys are counted in small tasks.
        stats = listed.join(stage_table(counted, "distinct", small_tasks=True), "position", "left")
    else:
        stats = _per_column(df, df.columns, lambda c: {
            "_rows": F.count(F.lit(1)), "_nulls": F.count(F.lit(1)) - F.count(_present(df, c)),
            "unique_count": F.approx_count_distinct(_present(df, c))})
    nulls = F.coalesce("_nulls", F.lit(0))
    return stats.select(
        "column_name", nulls.alias("null_count"),
        F.try_divide(X.to_double(nulls) * 100.0, F.col("_rows")).alias("null_percentage"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"))


def profile_numeric(df: DataFrame, exact: bool = True) -> DataFrame:
    """Min, max, mean, median and sample deviation of numeric columns."""
    names = columns_of(df, "numeric")

    def stats(name):
        x = _number(df, name).cast("double")
        out = {"min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.stddev_samp(x)}
        if not exact:
            out["median"] = F.percentile_approx(x, 0.5, 10000)
        return out

    plain = _per_column(df, names, stats)
    if exact:
        plain = plain.join(exact_medians(df, names), "column_name")
    return plain.select("column_name", "min", "max", "mean", "median", "std")


def profile_text(df: DataFrame) -> DataFrame:
    """Length of text columns; nulls have none."""

    def stats(name):
        size = F.length(_c(name))
        return {"min_length": F.min(size), "max_length": F.max(size), "avg_length": F.avg(size)}

    return _per_column(df, columns_of(df, "text"), stats)


def profile_datetime(df: DataFrame) -> DataFrame:
    def stats(name):
        ts = _c(name).cast("timestamp_ntz")
        return {"min": F.min(ts), "max": F.max(ts),
                "range_days": X.elapsed_days(F.min(ts), F.max(ts))}

    return _per_column(df, columns_of(df, "datetime"), stats)


def profile_boolean(df: DataFrame) -> DataFrame:
    return _per_column(df, columns_of(df, "boolean"), lambda name: {
        "true_count": X.count_where(_c(name)), "false_count": X.count_where(~_c(name))})


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, columns and null cells of the table; percentages are null if empty."""
    cells = F.lit(0)
    for name in df.columns:
        cells = cells + F.count(F.lit(1)) - F.count(_present(df, name))
    width = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("total_rows"), cells.alias("null_cells")).select(
        "total_rows", F.lit(width).cast("bigint").alias("total_columns"), "null_cells",
        F.try_divide(X.to_double(F.col("null_cells")) * 100.0, F.col("total_rows") * width)
        .alias("null_percentage"))


def sample_values(df: DataFrame, names: Sequence[str] | None = None,
                  n: int = SAMPLE_SIZE) -> DataFrame:
    """The ``n`` smallest distinct non-null values of each column, as text.

    Values are made distinct in every task first, and ranking keeps ``n`` rows
    per column and task before it shuffles (``WindowGroupLimit``).
    """
    names = list(names or df.columns)
    text = df.select(*[_present(df, c).cast("string").alias(c) for c in names])
    values = (text.unpivot([], [_c(c) for c in names], "column_name", "value")
              .filter(F.col("value").isNotNull()).distinct())
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    return (values.withColumn("position", rank).filter(F.col("position") <= n)
            .select("column_name", "position", "value"))


def semantic_hints(name: Column) -> Column:
    """Tags a column name earns, as an array; ``unknown`` if none."""
    lower = F.lower(name)
    tags = [F.when(lower.rlike("|".join(words)), F.lit(tag)) for tag, words in SEMANTIC_TAGS.items()]
    hits = F.array_compact(F.array(*tags))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("unknown")))


def full_profile(df: DataFrame, table_name: str, exact: bool = True) -> DataFrame:
    """Everything known about each column of a table, one row per column.

    Statistics that do not apply to a column's kind are null.
    """
    out = profile_nulls(df, exact)
    dtypes, kinds = dict(df.dtypes), {f.name: category(f.dataType) for f in df.schema.fields}
    name = F.col("column_name")
    pairs = [F.lit(x) for c in df.columns for x in (c, dtypes[c])]
    classes = [F.lit(x) for c in df.columns for x in (c, kinds[c])]
    out = out.select(F.lit(table_name).alias("table_name"), name,
                     F.create_map(*pairs)[name].alias("dtype"),
                     F.create_map(*classes)[name].alias("data_category"),
                     "null_count", "null_percentage", "unique_count",
                     semantic_hints(name).alias("semantic_hints"))
    if columns_of(df, "numeric"):
        out = out.join(profile_numeric(df, exact), "column_name", "left")
    if columns_of(df, "text"):
        out = out.join(profile_text(df), "column_name", "left")
    if columns_of(df, "datetime"):
        dates = profile_datetime(df).select(
            "column_name", F.col("min").alias("min_time"), F.col("max").alias("max_time"),
            "range_days")
        out = out.join(dates, "column_name", "left")
    if columns_of(df, "boolean"):
        out = out.join(profile_boolean(df), "column_name", "left")
    samples = sample_values(df).groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))),
                    lambda s: s["value"]).alias("sample_values"))
    return out.join(samples, "column_name", "left")


# --- types and cardinality --------------------------------------------------------------


def narrow_types(df: DataFrame) -> DataFrame:
    """Smallest integer type holding each long column: byte, short, int or long."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    spans = _per_column(df, names, lambda c: {"min_value": F.min(_c(c)), "max_value": F.max(_c(c))})
    chosen = F.lit("long")
    for kind, lo, hi in reversed(INTEGER_RANGES):
        fits = (F.col("min_value") >= lo) & (F.col("max_value") <= hi)
        chosen = F.when(fits, kind).otherwise(chosen)
    return spans.withColumn("narrow_type", chosen)


def narrow(df: DataFrame) -> DataFrame:
    """Cast long columns to the types ``narrow_types`` chooses.

    A schema is fixed before a plan is, so this runs one min/max aggregation.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    if not names:
        return df
    chosen = {r["column_name"]: r["narrow_type"] for r in narrow_types(df).collect()}
    return df.withColumns({c: _c(c).cast(kind) for c, kind in chosen.items() if kind != "long"})


def low_cardinality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Whether each text column repeats few values."""
    names = columns_of(df, "text")
    if exact:
        counts = value_counts(df, names).groupBy("column_name").agg(
            F.count("value").alias("unique_count"), F.sum("n").alias("total_rows"))
    else:
        counts = _per_column(df, names, lambda c: {
            "unique_count": F.approx_count_distinct(_c(c)), "total_rows": F.count(F.lit(1))})
    share = F.try_divide(X.to_double(F.col("unique_count")), F.col("total_rows"))
    return counts.withColumn("is_low_cardinality", F.coalesce(
        (share < CARDINALITY_SHARE) & (F.col("unique_count") < CARDINALITY_LIMIT), F.lit(False)))


# --- text patterns ---------------------------------------------------------------------


def column_patterns(df: DataFrame) -> DataFrame:
    """How many values of each text column show each pattern, and their mean length."""

    def stats(name):
        out = {pattern: X.count_where(_c(name).rlike(regex)) for pattern, regex in PATTERNS.items()}
        return {**out, "avg_length": F.avg(F.length(_c(name)))}

    return _per_column(df, columns_of(df, "text"), stats)


def _pieces(df: DataFrame, name: str) -> dict[str, Column]:
    value = _as_text(df, name)
    long_enough = F.length(value) >= PIECE_LENGTH
    return {"value": value, "prefix": F.when(long_enough, F.left(value, F.lit(PIECE_LENGTH))),
            "suffix": F.when(long_enough, F.right(value, F.lit(PIECE_LENGTH)))}


def frequent_candidates(df: DataFrame, names: Sequence[str], candidates: int, tracked: int) -> DataFrame:
    """(column_name, kind, hash, most): pieces that may be frequent, one aggregation over one scan.

    Every task keeps at most ``tracked`` counters per column and kind, whatever
    the number of distinct values. ``most`` bounds how often any piece that is not
    listed can occur: a counter is never too low, and a piece without one occurs
    at most 3.5 rows in ``tracked``.
    """
    aggregates, structs = [F.count(F.lit(1)).alias("_rows")], []
    for i, name in enumerate(names):
        for kind, piece in _pieces(df, name).items():
            key = f"_{i}_{kind}"
            aggregates.append(F.call_function("approx_top_k", F.when(piece.isNotNull(), F.xxhash64(piece)),
                                              F.lit(candidates), F.lit(tracked)).alias(key))
            lowest = F.when(F.size(key) >= candidates, F.array_min(F.transform(key, lambda e: e["count"])))
            dropped = F.ceil(F.col("_rows") * F.lit(3.5) / F.lit(tracked))
            structs.append(F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("kind"),
                                    F.transform(key, lambda e: e["item"]).alias("hashes"),
                                    F.greatest(F.coalesce(lowest, F.lit(0)), dropped).alias("most")))
    found = df.agg(*aggregates).select(F.inline(F.array(*structs)))
    return found.select("column_name", "kind", "most", F.explode("hashes").alias("hash"))


def _counted(df: DataFrame, names: Sequence[str], wanted: DataFrame | None) -> DataFrame:
    """(column_name, kind, piece, n) of all pieces, or of those whose hashes are ``wanted``."""
    structs = [F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("kind"), piece.alias("piece"))
               for name in names for kind, piece in _pieces(df, name).items()]
    pieces = df.select(F.inline(F.array(*structs))).filter(F.col("piece").isNotNull())
    if wanted is not None:
        # At most ``candidates`` rows per column and kind.
        pieces = pieces.withColumn("hash", F.xxhash64("piece")).join(
            F.broadcast(wanted), ["column_name", "kind", "hash"], "left_semi")
    return pieces.groupBy("column_name", "kind", "piece").agg(F.count(F.lit(1)).alias("n"))


def top_pieces(df: DataFrame, k: int = TOP_K, candidates: int = 100, tracked: int = 10_000) -> DataFrame:
    """The ``k`` most frequent values, prefixes and suffixes of each text column.

    Prefixes and suffixes are three characters of values at least that long;
    ties go to the lower text. Candidates come from counters of bounded size and
    are then counted exactly. Where the k-th count exceeds what any other piece can
    have, they are the answer; the columns and kinds where it does not (values
    that hardly repeat) are counted in full.
    """
    names = columns_of(df, "text")
    listed = stage_table(frequent_candidates(df, names, candidates, tracked), "candidates")
    rank = F.row_number().over(
        Window.partitionBy("column_name", "kind").orderBy(F.desc("n"), F.asc("piece")))

    def top(counts: DataFrame) -> DataFrame:
        return counts.withColumn("position", rank).filter(F.col("position") <= k)

    best = stage_table(top(_counted(df, names, listed.select("column_name", "kind", "hash"))), "best")
    bounds = listed.groupBy("column_name", "kind").agg(F.max("most").alias("most"))
    proven = (best.filter(F.col("position") == k).join(bounds, ["column_name", "kind"])
              .filter(F.col("n") > F.col("most")).select("column_name", "kind"))
    sure = {tuple(r) for r in proven.collect()}  # three rows per column at most
    out = best.join(proven, ["column_name", "kind"], "left_semi")
    open_ = [n for n in names if not all((n, kind) in sure for kind in PIECE_KINDS)]
    if open_:
        rest = top(_counted(df, open_, None).join(F.broadcast(proven), ["column_name", "kind"], "left_anti"))
        out = out.unionByName(rest)
    return out.select("column_name", "kind", "piece", "n", "position")
