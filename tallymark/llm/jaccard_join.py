"""N-gram Jaccard self-join by token-combination prefixes, and its components.

A document's set is its distinct shingles of ``words`` words, as 64-bit hashes; equal sets
are one node from the start. Two sets x, y of Jaccard similarity at least
``percent`` share at least need(x) = ceil(percent * |x| / 100) tokens, so under
any one order of tokens their first |x| - need(x) + k tokens share at least k.
This is used twice, and no pair can escape either step.

1. With k = ``SIFT`` per cent of the set: both partners then look at the k shared
   tokens of the smaller one, which has need(x) tokens at least. A set of whose
   first tokens (in hash order) fewer than ``SIFT`` per cent of need(x) are looked
   at by any other set has no partner and is left out.
2. Over the sets that remain, tokens of frequent hash classes (counted over all
   of those sets) are put last. Prefixes are extended by one token, so partners
   share two of them. Rare tokens are indexed alone; frequent tokens whose
   prefixes are short are indexed by pairs. Partners share a rare token or a pair.

Candidates under one signature must also pass the length and positional
filters, and are verified by counting. Under each signature the member with the
earliest place is compared with all others first; once components of those
links are known, only pairs of different components are compared. Links within
a component cannot change it, so the components are those of all links.

Defined results: null, empty and wordless texts have no set and stay alone;
fewer words than a shingle has make one token of the whole sequence; repeated rows get
a row each; null ids never name a component while another member has an id; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import common as C
from tallymark.llm.components import components
from tallymark.session import stage_table

WORDS, PERCENT = 3, 90  # of op9
SIFT = 10  # per cent of a set that step 1 asks to be shared
PASSES = 4  # over ranges of tokens in step 1: the tokens of one range are on disk at a time
CLASSES = 1 << 18  # hash classes of tokens: the table of their counts has 1 MB
FREQUENT = 64  # members under one signature from which a token counts as frequent
SHORT_PREFIX = 8  # longest prefix whose frequent tokens are indexed by pairs

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_set(text: Column, words: int = WORDS) -> Column:
    """Sorted distinct hashes of the shingles of so many words."""
    # Lower-casing is for A-Z alone; in ASCII text lower() does just that.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))
    return F.transform(F.array(C.space_words(lowered)), lambda w: F.when(
        F.size(w) >= words, F.sort_array(F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[w[i + k] for k in range(words)])))))
        .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.array().cast("array<bigint>")))[0]


def need(n: Column, percent: int) -> Column:
    """Tokens that a set of n shares at least with any partner."""
    return F.floor((n * percent + 99) / 100)


def _nodes(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """doc_id, n_shingles, key of the set, and the tokens that step 1 looks at."""
    sets = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), shingle_set(C.whole_text(), words).alias("s"))
    n = F.size("s").cast("bigint")
    per_cent = lambda k: F.floor((k * SIFT + 99) / 100)
    return stage_table(sets.select(
        "doc_id", n.alias("n"), F.when(n > 0, F.xxhash64("s", n)).alias("key"),
        per_cent(need(n, percent)).alias("shared"),
        # Smaller sets have no partner but their equals: one token more is too much.
        F.when(n * (100 - percent) >= percent,
               F.slice("s", 1, (n - need(n, percent) + per_cent(n)).cast("int"))).alias("head")), "sets")


def _sifted(nodes: DataFrame) -> DataFrame:
    """(key, doc_id) of one document for each set that may have a partner, among rows
    with the tokens looked at (``seen``) and those that had to be (``shared``)."""
    seen = None
    for k in range(PASSES):
        part = F.filter("head", lambda t: F.pmod(t, F.lit(PASSES)) == k)
        tokens = nodes.where("size(head) > 0").select("key", "doc_id", "shared", F.explode(part).alias("token"))
        common = (tokens.groupBy("token").agg(F.min("key").alias("a"), F.max("key").alias("b"))
                  .where("a <> b").select("token"))
        found = stage_table(tokens.join(common, "token").groupBy("key", "doc_id", "shared").count(), "sifted")
        seen = found if seen is None else seen.unionAll(found)
    return (seen.groupBy("key", "doc_id", "shared").agg(F.sum("count").alias("seen")).where("seen >= shared")
            .groupBy("key").agg(F.min(F.struct("doc_id", "seen", "shared")).alias("d")).select("key", "d.*"))


def _class_counts(sets: DataFrame) -> np.ndarray:
    """Tokens in each hash class; every task adds up its own before they meet."""
    counts = (sets.select(F.explode("s").alias("t")).groupBy(F.pmod("t", F.lit(CLASSES)).cast("int").alias("c"))
              .count().where("count > 1"))
    found = counts.toArrow()
    table = np.ones(CLASSES, dtype=np.int32)
    table[found["c"].to_numpy()] = np.minimum(found["count"].to_numpy(), 2**31 - 1)
    return table


SIGNATURE = "key bigint, n bigint, token bigint, pos int, width int"


def _prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Token, place and length of the prefix, for each set's extended prefix."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("s")
            tokens = column.flatten().to_numpy()
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            often = shared.value[np.mod(tokens, CLASSES)]
            order = np.lexsort((tokens, often, owner))
            tokens = tokens[order]
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            width = np.minimum(sizes, sizes - (sizes * percent + 99) // 100 + 2)
            keep = pos < width[owner]
            of = owner[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("key").to_numpy()[of]), pa.array(sizes[of]), pa.array(tokens[keep]),
                 pa.array(pos[keep].astype(np.int32)), pa.array(width[of].astype(np.int32))],
                ["key", "n", "token", "pos", "width"])
    return sets.select("key", "s").mapInArrow(run, SIGNATURE)


def _signatures(prefixes: DataFrame, percent: int) -> DataFrame:
    """Single rare tokens and pairs of frequent ones, with the set's place there.

    ``most`` is the largest size of a partner whose first shared token is here.
    """
    heavy = (prefixes.groupBy("token").agg(F.count("*").alias("c"), F.max("width").alias("w"))
             .where("c > 1").select("token", ((F.col("c") > FREQUENT) & (F.col("w") <= SHORT_PREFIX)).alias("heavy")))
    tagged = prefixes.join(heavy, "token")
    # One shared frequent token, of which no pair was made, may come before a rare one.
    single = tagged.where("NOT heavy").select(
        "key", "n", F.when(F.col("width") <= SHORT_PREFIX, F.greatest(F.col("pos") - 1, F.lit(0)))
        .otherwise(F.col("pos")).alias("pos"), F.col("token").alias("sig"))
    pairs = (tagged.where("heavy").groupBy("key", "n")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("h"))
             .select("key", "n", F.explode(F.expr(
                 "flatten(transform(h, (x, i) -> transform(slice(h, i + 2, size(h)), "
                 "y -> struct(x.pos AS pos, xxhash64(x.token, y.token) AS sig))))")).alias("p"))
             .select("key", "n", "p.pos", "p.sig"))
    # overlap o >= p(n + m) / (100 + p) and o <= n - pos bound the partner's size m.
    most = F.floor(((100 + percent) * (F.col("n") - F.col("pos")) - percent * F.col("n")) / percent)
    return single.unionByName(pairs).withColumn("most", most)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    of = lambda k: sets.select(F.col("key").alias(k), F.col("s").alias(f"s_{k}"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return (pairs.join(of("b"), "b").join(of("a"), "a")
            .where(100 * shared >= percent * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b"))


def links(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(nodes, components): every document's set, and (key, root) of linked sets."""
    spark = docs.sparkSession
    nodes = _nodes(docs, percent, words)
    # Written before texts are shuffled, so that its own shuffles are gone by then.
    chosen = stage_table(_sifted(nodes), "chosen").where("seen >= shared").select("key", "doc_id")
    # Only texts of chosen ids are shuffled. Written before it is filtered: as a condition of the join the set would be
    # made for every document. Ids that repeat bring other sets, or a set twice.
    sets = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(chosen, "doc_id")
            .select("doc_id", "key", shingle_set(C.whole_text(), words).alias("s"))
            # The id leads, so rows stay where the join has put them.
            .withColumn("own", F.xxhash64("s", F.size("s").cast("bigint"))).dropDuplicates(["doc_id", "key", "own"]))
    sets = stage_table(sets, "candidates", keys_first=True).where("key = own").drop("doc_id", "own")
    found = stage_table(_signatures(stage_table(
        _prefixes(sets, _class_counts(sets), percent), "prefixes"), percent), "signatures")

    place = F.struct((F.col("pos") / F.col("n")).alias("at"), "key", "n", "most")
    pivots = (found.groupBy("sig").agg(F.min(place).alias("p"), F.count("*").alias("c"))
              .where("c > 1").select("sig", "p.*")
              .select("sig", F.col("key").alias("pivot"), F.col("n").alias("pn"), F.col("most").alias("pmost")))
    first = stage_table(
        found.join(pivots, "sig").where("key <> pivot AND n <= pmost AND pn <= most")
        .select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct(), "pairs")
    linked = stage_table(_verified(first, sets, percent), "links")
    labels = components(linked)

    # What is left: pairs of different components under a signature, not yet compared.
    labelled = found.join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = labelled.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    open_sets = stage_table(labelled.join(mixed.select("sig"), "sig"), "open")
    x, y = open_sets.alias("x"), open_sets.alias("y")
    rest = (x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.key") < F.col("y.key"))
                   & (F.col("x.root") != F.col("y.root"))
                   & (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most")))
            .select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
            .join(first, ["a", "b"], "left_anti"))
    more = _verified(rest, sets, percent)
    return nodes, components(linked.unionAll(more))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and the smallest doc_id reachable over links, per row."""
    nodes, labels = links(docs, percent, words)
    rows = nodes.select("doc_id", "n", "key")
    own = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("own"))
    linked = own.join(labels, "key")
    least = linked.groupBy("root").agg(F.min("own").alias("least"))
    # Written, so that the join below is one of two plain shuffles: Spark then splits
    # the rows of a set that very many documents have.
    names = stage_table(own.join(linked.join(least, "root").select("key", "least"), "key", "left").select(
        "key", F.coalesce("least", "own").alias("name")), "names")
    return rows.join(names, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the near-duplicate component of every document."""
    return jaccard_components(C.table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The documents that name their component, with their own columns.

    Rows that share an id stay or go together, exact repeats becoming one; rows
    without an id stay.
    """
    names = (jaccard_components(docs, percent, words).where("doc_id = component_id")
             .select("doc_id").distinct())
    kept = docs.join(names, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1),
      lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS ss FROM w),
t AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t AS a JOIN t AS b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(doc_id, other) AS (SELECT x, y FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id) AS m USING (doc_id)
"""
