"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are the paragraphs (lines) of a text; ``SECTION`` consecutive paragraphs
form a section; the root is over the sections. Every hash is SHA-256 of the
children's hashes, so equal roots mean equal texts and, going down from
differing roots, the differing sections and paragraphs locate an edit. Each
paragraph also carries hashes of its sentences, which say how much of a
differing branch is left.

Defined results: null is the empty text, one empty paragraph; equal texts have
equal fingerprints and likeness 1, differing texts a likeness below 1; an empty
table gives an empty result; extra columns are ignored. Rows are compared with
the row after them in descending doc_id order (null ids last, ties by text),
the last with the first. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm import common as C

SECTION = 8
NOT_EQUAL = 1 - 1e-6  # the most that differing texts can be alike


def tree(text: Column) -> Column:
    """struct(root, sections, paragraphs, sentences) of a text.

    ``sentences`` are the distinct 64-bit hashes of the trimmed sentences.
    """
    paragraphs = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))
    sentences = F.array_distinct(F.transform(
        F.split(text, r"(?<=[.!?] )|\n", -1), lambda s: F.xxhash64(F.trim(s))))
    return _let(F.struct(paragraphs.alias("paragraphs"), sentences.alias("sentences")), lambda l: _let(
        F.transform(F.sequence(F.lit(0), F.ceil(F.size(l["paragraphs"]) / SECTION).cast("int") - 1),
                    lambda i: F.sha2(F.array_join(F.slice(l["paragraphs"], i * SECTION + 1, SECTION), ""), 256)),
        lambda s: F.struct(F.sha2(F.array_join(s, ""), 256).alias("root"), s.alias("sections"),
                           l["paragraphs"].alias("paragraphs"), l["sentences"].alias("sentences"))))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def likeness(a: Column, b: Column) -> Column:
    """Share of sentences that two trees have in common (Dice); 1 for equal roots alone."""
    shared = F.size(F.array_intersect(a["sentences"], b["sentences"]))
    dice = 2.0 * shared / (F.size(a["sentences"]) + F.size(b["sentences"]))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(F.least(dice, F.lit(NOT_EQUAL)))


def differing(a: Column, b: Column) -> Column:
    """Places of paragraphs that differ, reached through differing sections only."""
    def leaves(i):
        first = i * SECTION
        return F.filter(F.transform(F.sequence(F.lit(1), F.lit(SECTION)), lambda j: first + j),
                        lambda k: ~F.get(a["paragraphs"], k - 1).eqNullSafe(F.get(b["paragraphs"], k - 1)))
    most = F.greatest(F.size(a["sections"]), F.size(b["sections"]))
    sections = F.filter(F.sequence(F.lit(0), most - 1),
                        lambda i: ~F.get(a["sections"], i).eqNullSafe(F.get(b["sections"], i)))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(
        F.flatten(F.transform(sections, leaves)))


def _buckets(docs: DataFrame, n: int) -> tuple[list[int], dict[int, int | None]]:
    """Split points of doc_id into about ``n`` ranges, and each range's largest id.

    Reads the id column alone; what comes back are at most n numbers.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("q")).first()
    splits = sorted(set(found["q"] or []))
    tops = (ids.select(_bucket(F.col("doc_id"), splits).alias("b"), "doc_id")
            .groupBy("b").agg(F.max("doc_id").alias("top")).collect())
    return splits, {r["b"]: r["top"] for r in tops}


def _bucket(doc_id: Column, splits: list[int]) -> Column:
    """Number of split points at or below the id, 0 for null."""
    listed = F.expr(f"cast(array({', '.join(f'{s}L' for s in splits)}) AS array<bigint>)")
    return F.coalesce(F.size(F.filter(listed, lambda s: s <= doc_id)), F.lit(0))


def with_next(docs: DataFrame, add, ranges_per_partition: int = 4) -> DataFrame:
    """doc_id, text, tree and ``next_text``, ``next_tree`` of the following row.

    ``docs`` are dealt by ranges of ids, and the first rows of a range also go,
    marked, to the end of the range before it, so the window over one range
    always sees the follower. One shuffle of the texts; no row order is global.
    """
    spark = docs.sparkSession
    n = max(2, ranges_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits, tops = _buckets(docs, n)
    order = sorted(tops, reverse=True)
    # Range -> the range that ends where it begins; the first follows the last.
    before = {b: order[i - 1] for i, b in enumerate(order)}
    top = F.lit(None).cast("bigint")
    ahead = F.lit(None).cast("int")
    if tops:
        listed = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
        top = F.try_element_at(listed({b: t for b, t in tops.items() if t is not None} or {-1: 0}), F.col("_b"))
        ahead = F.try_element_at(listed(before), F.col("_b"))
    rows = (docs.select("doc_id", C.whole_text().alias("text"))
            .withColumn("_b", _bucket(F.col("doc_id"), splits))
            .withColumn("_goes", F.when(F.col("doc_id").eqNullSafe(top), F.array(
                F.struct(F.col("_b").alias("b"), F.lit(False).alias("tail")),
                F.struct(ahead.alias("b"), F.lit(True).alias("tail")))).otherwise(
                F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("tail")))))
            .select("doc_id", "text", F.explode("_goes").alias("_goes"))
            .select("doc_id", "text", "_goes.b", "_goes.tail"))
    window = Window.partitionBy("b").orderBy("tail", F.col("doc_id").desc_nulls_last(), "text")
    return (rows.repartition("b").withColumn("tree", add(F.col("text")))
            .withColumn("next_text", F.lead("text").over(window))
            .withColumn("next_tree", F.lead("tree").over(window))
            .where("NOT tail").drop("b", "tail"))


def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every text, its edited text and the next document's text, as trees."""
    docs = with_next(C.table(spark, sf_dir, "documents"), tree)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = (docs.withColumn("n_chars", n.cast("bigint"))
              .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                                             F.substring(F.col("next_text"), F.lit(1), half)))
              .withColumn("edited_tree", tree(F.col("edited"))))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.col("tree.root").alias("fingerprint"), F.col("edited_tree.root").alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        F.size(differing(F.col("tree"), F.col("edited_tree"))).cast("bigint").alias("n_edited_paragraphs"))


def _tree_sql(name: str, source: str, text: str) -> str:
    return rf"""
{name}_p AS (SELECT doc_id, {text} AS t, list_transform(string_split({text}, chr(10)), lambda p: sha256(p)) AS ps,
    list_distinct(list_transform(string_split_regex(regexp_replace({text}, '([.!?]) ', '\1 ' || chr(10), 'g'), '\n'),
      lambda s: trim(s))) AS ss FROM {source}),
{name}_s AS (SELECT *, list_transform(range(0, CAST(ceil(len(ps) / {SECTION}.0) AS BIGINT)),
    lambda i: sha256(array_to_string(ps[i * {SECTION} + 1 : i * {SECTION} + {SECTION}], ''))) AS cs FROM {name}_p),
{name} AS (SELECT doc_id, t, ps, ss, sha256(array_to_string(cs, '')) AS root FROM {name}_s)"""


def _near_sql(a: str, b: str) -> str:
    return (f"CASE WHEN {a}.root = {b}.root THEN 1.0 ELSE least(2.0::DOUBLE * len(list_intersect({a}.ss, {b}.ss)) / "
            f"(len({a}.ss) + len({b}.ss)), {NOT_EQUAL!r}::DOUBLE) END::DOUBLE")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
    coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d
  WINDOW w AS (ORDER BY doc_id DESC, text)),
e AS (SELECT doc_id, next_id, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS text FROM n),
{_tree_sql('a', 'd', 'text')},
{_tree_sql('x', 'e', 'text')}
SELECT a.doc_id, CAST(length(a.t) AS BIGINT) AS n_chars, sha256(x.t) AS edited_sha256, a.root AS fingerprint,
  x.root AS edited_fingerprint, {_near_sql('a', 'x')} AS near_edited, {_near_sql('a', 'b')} AS near_next,
  CAST(len(list_filter(range(1, greatest(len(a.ps), len(x.ps)) + 1), lambda i: a.ps[i] IS DISTINCT FROM x.ps[i])) AS BIGINT)
    AS n_edited_paragraphs
FROM a JOIN x USING (doc_id) JOIN e USING (doc_id) JOIN a AS b ON b.doc_id = e.next_id
"""
