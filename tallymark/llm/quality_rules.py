"""Quality rules as a bitmask ledger: every rule is evaluated once.

``ledger`` stores, per document, the measurements and one bit for each rule
that fails. ``apply_policy`` turns bits into a verdict under a named version of
the policy; ``ablations`` says what each rule contributes, from the bits alone.
Everything is DataFrame functions; no row leaves its partition.

Defined results: null or empty text and text of white space have no words, zero
measurements and fail ``short``; repeated rows each get their own row; an empty
table gives an empty ledger; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import common as C

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Rule name -> SQL condition under which a document fails it. The bit of a rule
# is its place in this list, so rules are only ever appended.
RULES = (
    ("short", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("dup_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    ("long_words", "word_chars > 15 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("capitals", "2 * n_capitals > word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

# Version -> rules that reject. A new version is a new entry.
POLICIES = {
    "base": ("short", "repeats"),
    "v1": ("short", "repeats", "symbols"),
    "v2": tuple(BIT),
}
CURRENT = "v2"


def mask_of(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _repeated_words(words: str, n: str) -> list[tuple[str, Column]]:
    """Steps that count the words lying in a 3-word window found twice or more.

    The 64-bit hash of a window gives way, in its low bits, to the window's
    position, so one sort of longs brings equal windows together. Neighbours
    with equal hash bits are compared word by word.
    """
    same = ("(({a} ^ {b}) >>> _bits) = 0"
            " AND {w}[cast({a} & _low AS INT)] = {w}[cast({b} & _low AS INT)]"
            " AND {w}[cast({a} & _low AS INT) + 1] = {w}[cast({b} & _low AS INT) + 1]"
            " AND {w}[cast({a} & _low AS INT) + 2] = {w}[cast({b} & _low AS INT) + 2]")
    before = same.format(a="x", b="_keys[j - 1]", w=words)
    after = same.format(a="x", b="_keys[j + 1]", w=words)
    return [
        ("_bits", F.expr(f"length(bin({n}))")),
        ("_low", F.expr("shiftleft(1L, _bits) - 1")),
        ("_keys", F.expr(
            f"CASE WHEN {n} >= 3 THEN sort_array(transform(sequence(0, cast({n} AS INT) - 3), i -> "
            f"shiftleft(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), _bits) | i)) "
            "ELSE array() END")),
        ("_starts", F.expr(
            f"sort_array(transform(filter(_keys, (x, j) -> (j > 0 AND {before}) "
            f"OR (j + 1 < size(_keys) AND {after})), x -> x & _low))")),
        ("n_repeat_words", F.expr(
            "aggregate(_starts, struct(-3L AS last, 0L AS covered), (a, p) -> "
            "struct(p AS last, a.covered + least(3L, p - a.last) AS covered), a -> a.covered)")),
    ]


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Measurements and ``failed_bits`` of every row.

    ``keep`` names columns to carry along (doc_id alone by default) in the struct
    ``row``, where their names cannot clash with the measurements.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in keep or ["doc_id"]]).alias("row")
    text = C.whole_text()
    blank = "x rlike '[^\\\\x20\\\\x09-\\\\x0D]'"
    steps = [
        ("_lines", F.expr(f"filter(split(_text, '\\n', -1), x -> {blank})")),
        ("n_words", F.size("_words").cast("bigint")),
        ("word_chars", F.length(F.array_join("_words", "")).cast("bigint")),
        ("n_symbols", F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("bigint")),
        ("n_capitals", F.length(F.regexp_replace("_text", r"[^A-Z]+", "")).cast("bigint")),
        ("n_lines", F.size("_lines").cast("bigint")),
        ("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")),
        *_repeated_words("_words", "n_words"),
    ]
    out = docs.select(carried, text.alias("_text")).withColumn("_words", C.space_words(F.col("_text")))
    for name, value in steps:
        out = out.withColumn(name, value)
    bits = " + ".join(f"CASE WHEN {rule} THEN {BIT[name]}L ELSE 0L END" for name, rule in RULES)
    return out.select("row", *MEASURES, "n_lines", "n_capitals",
                      F.expr(bits).alias("failed_bits"))


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under the named policy."""
    failed = lambda name: F.col("failed_bits").bitwiseAND(F.lit(mask_of(name))) != 0
    return (entries.withColumn("base_failed", failed("base"))
            .withColumn("kept", ~(failed("base") | failed(policy))))


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row for each rule of the policy: documents failing it, failing it
    alone, and kept were the rule dropped; with the bits seen in all and in any.

    Documents are first counted by their bits, so at most 2**rules rows move on.
    """
    mask = F.lit(mask_of(policy))
    by_bits = (entries.groupBy(F.col("failed_bits").bitwiseAND(mask).alias("bits"))
               .agg(F.count("*").alias("n")))
    rules = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("bigint").alias("bit"))
        for name in POLICIES[policy]]))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return (by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
            .groupBy("rule", "bit")
            .agg(F.sum("n").alias("documents"),
                 F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"),
                 F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
                 F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n"))
                       .otherwise(0)).alias("kept_without"),
                 F.bit_or("bits").alias("bits_in_any"), F.bit_and("bits").alias("bits_in_all")))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the verdict on every document, with its measurements."""
    return apply_policy(ledger(C.table(spark, sf_dir, "documents"))).select(
        "row.doc_id", *MEASURES, "base_failed", "kept", "failed_bits")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the current policy keeps, with their own columns."""
    # The row number keeps the filter above the measurements: pushed below, it
    # would make the words anew for each of their uses.
    judged = apply_policy(ledger(docs, keep=docs.columns)).withColumn("_at", F.monotonically_increasing_id())
    return judged.where("kept AND _at >= 0").select("row.*")


_MASK = mask_of(CURRENT)
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
m AS (SELECT *, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines
  FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, n_words - 1)) AS i FROM m)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE k > 1) GROUP BY 1),
f AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
b AS (SELECT *, CAST(""" + " + ".join(
    f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES) + f""" AS BIGINT) AS failed_bits FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed_bits & {mask_of('base')} <> 0 AS base_failed, failed_bits & {_MASK} = 0 AS kept, failed_bits FROM b
"""
