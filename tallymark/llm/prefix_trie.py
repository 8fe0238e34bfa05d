"""Prefix trie of conversations, subtree totals by parallel tree contraction.

Conversations share beginnings: a node is a distinct sequence of first turns, its
members are the conversations that begin so. Turns are numbered by one range
sort, so a conversation may be longer than a partition. A prefix is named by the
exclusive or of its turns' hashes (two of 64 bits, each of place, role and text),
which runs over stretches of a conversation and then over their totals. Nodes are
a grouping of the prefixes.

Totals over subtrees come from contraction rounds on the written tree. Rake: leaves
are final; their totals are added up per parent. Compress: in chains of nodes with
one child, those with a higher random number than both neighbours are cut out;
the child keeps, beside its own total, what lies on the edge to its new parent.
Every round removes all leaves and a third of each chain, so rounds grow with the
logarithm of the tree at any depth. Then the cut nodes are put back in reverse
order: each has the total of its former child and what it had beside it. Nodes
with many children are met by grouping alone; only the names of parents are joined
to children, over many tasks for a frequent parent.

Defined results: rows without a conv_id belong to no conversation; a null turn comes
first; turns of equal number are ordered by a digest of role and text, repeated
rows are turns of their own; null role and text are empty; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm import common as C
from tallymark.session import stage_table

STRETCH_BITS = 12  # turns of a stretch, conversation ids of a chunk: 4096
KEY = ["depth", "p1", "p2"]


# --- turns of the rebuilt conversations ---------------------------------------------------------


def _digest_half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")


def numbered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, rank (0, 1, ... by turn) and content hashes and words of every turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), C.whole_text()
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = stage_table(rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        digest.alias("_digest"), F.size(C.space_words(text)).alias("words"),
        # Tells equal rows apart, so that a range can end among them.
        F.monotonically_increasing_id().alias("mix"),
    ).select("conv_id", "turn", _digest_half(F.col("_digest"), 1).alias("a"),
             _digest_half(F.col("_digest"), 16).alias("b"), "words", "mix"), "turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("mix")]
    placed = stage_table(turns.repartitionByRange(*order).sortWithinPartitions(*order)
                         .select("conv_id", "a", "b", "words", F.spark_partition_id().alias("part"),
                                 F.monotonically_increasing_id().alias("at")), "placed")
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("_n")
    return placed.join(runs.withColumn("_before", before), ["conv_id", "part"]).select(
        "conv_id", (F.col("at") - F.col("_first") + F.col("_before")).alias("rank"), "a", "b", "words")


def lead_of(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one it is rebuilt with."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(4))


def rebuilt_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, pos, a, b, words of every rebuilt conversation; conv_id of all."""
    turns = stage_table(numbered_turns(rows), "ranks")
    convs = stage_table(turns.groupBy("conv_id").agg(F.count("*").alias("turns")), "convs")
    c = F.col("conv_id")
    led = convs.select("conv_id", "turns", (c - c % 20).alias("base"), lead_of(c).alias("lead"))
    heads = turns.where((c % 20 == 0) & (F.col("rank") < 3)).select(
        c.alias("base"), F.col("rank").alias("pos"), "a", "b", "words")
    begin = led.join(heads, "base").where("pos < lead").select("conv_id", "pos", "a", "b", "words")
    # Turns move up where the other conversation is too short to give as many as it should.
    sizes = convs.select(c.alias("base"), F.col("turns").alias("of_base"))
    short = stage_table(led.join(sizes, "base", "left").select(
        "conv_id", "turns", (F.col("lead") - F.coalesce("of_base", F.lit(0))).alias("gap")).where("gap > 0"), "short")
    total = convs.agg(F.coalesce(F.sum("turns"), F.lit(0))).first()[0]
    own = C.join_groups(turns.where(F.col("rank") >= lead_of(c)), short, "conv_id", "turns", total).select(
        "conv_id", (F.col("rank") - F.coalesce("gap", F.lit(0))).alias("pos"), "a", "b", "words")
    return begin.unionByName(own), convs.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2 (the prefix), q1, q2 (without its last turn) and the last turn's words."""
    marked = stage_table(turns.select(
        "conv_id", F.shiftright("pos", STRETCH_BITS).alias("stretch"), "pos", "words",
        F.xxhash64("pos", "a", "b").alias("e1"), F.xxhash64(F.lit(1), "b", "pos", "a").alias("e2")), "rebuilt")
    totals = marked.groupBy("conv_id", "stretch").agg(F.bit_xor("e1").alias("_s1"), F.bit_xor("e2").alias("_s2"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "stretch", F.bit_xor("_s1").over(earlier).alias("_t1"),
                           F.bit_xor("_s2").over(earlier).alias("_t2")).where("stretch > 0")
    so_far = Window.partitionBy("conv_id", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p1 = F.col("_r1").bitwiseXOR(F.coalesce("_t1", F.lit(0)))
    p2 = F.col("_r2").bitwiseXOR(F.coalesce("_t2", F.lit(0)))
    return (marked.withColumn("_r1", F.bit_xor("e1").over(so_far)).withColumn("_r2", F.bit_xor("e2").over(so_far))
            .join(totals, ["conv_id", "stretch"], "left")
            .select("conv_id", (F.col("pos") + 1).alias("depth"), p1.alias("p1"), p2.alias("p2"),
                    p1.bitwiseXOR(F.col("e1")).alias("q1"), p2.bitwiseXOR(F.col("e2")).alias("q2"), "words"))


# --- the tree -----------------------------------------------------------------------------------


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """ends_sha256 of the ids (column conv_id) that end at each node, however many they are.

    Ids are joined in chunks of 4096 neighbouring numbers; a running hash then takes
    the chunks of a node in order and holds one of them at a time.
    """
    chunks = ends.groupBy(*KEY, F.shiftright("conv_id", STRETCH_BITS).alias("chunk")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])
        at, running = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if node == at:
                    running.update(b"," + ids.encode())
                    continue
                if at:
                    out.append((*at, running.hexdigest()))
                at, running = node, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), names)], schema=names)
        if at:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((*at, running.hexdigest()), names)], schema=names)

    return (chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids")
            .mapInArrow(run, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string"))


def trie_nodes(rows: DataFrame) -> DataFrame:
    """The nodes with their parents and all but the subtree totals."""
    turns, convs = rebuilt_turns(rows)
    paths = stage_table(prefixes(turns), "prefixes")
    zero = F.lit(0).cast("bigint")
    no_turn = [zero.alias(c) for c in KEY]
    inner = paths.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.min(F.struct("q1", "q2")).alias("q"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *no_turn, "conv_id", "n_convs", F.lit(0).alias("words"), F.lit(None).cast(inner.schema["q"].dataType).alias("q"))
    key = F.struct(*[F.col(c).cast("bigint").alias(c) for c in KEY])
    up = F.struct((F.col("depth") - 1).cast("bigint").alias("depth"), F.col("q.q1").alias("p1"), F.col("q.q2").alias("p2"))
    nodes = stage_table(inner.unionByName(root).select(
        key.alias("node"), F.when(F.col("depth") > 0, up).alias("key"), "conv_id", "n_convs", "words"), "nodes")
    kids = nodes.where("key IS NOT NULL").groupBy(F.col("key").alias("node")).agg(F.count("*").alias("n_children"))
    last = paths.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end"))
    ends = convs.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in KEY])
    digests = digests_of_ends(ends).select(key.alias("node"), "ends_sha256")
    known = stage_table(
        nodes.join(kids, "node", "left").join(digests, "node", "left")
        .withColumn("n_children", F.coalesce("n_children", zero))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))), "known")
    parents = known.where("n_children > 0").select(
        F.col("node").alias("key"), F.col("n_children").alias("rows"), F.col("conv_id").alias("parent_conv_id"))
    total = parents.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return C.join_groups(known, parents, "key", "rows", total).select(
        "conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "words", "ends_sha256")


def _above(a: Column, b: Column, turn: int) -> Column:
    """Whether ``a`` has the higher random number of this round."""
    return F.struct(F.xxhash64(F.lit(turn), a), a) > F.struct(F.xxhash64(F.lit(turn), b), b)


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """id and, for each of ``values``, its sum over the subtree of the node.

    ``tree`` has id (unique), parent (null: a root) and the values; any forest will do.
    """
    edge = [f"edge_{v}" for v in values]
    live = stage_table(tree.select("id", "parent", *values, *[F.lit(0).cast("bigint").alias(e) for e in edge]), "live")
    finals, cuts = [], []
    while not live.isEmpty():
        has_child = live.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
        marked = stage_table(live.join(has_child.withColumn("inner", F.lit(True)), "id", "left"), "marked")
        leaf = F.col("inner").isNull()
        finals.append(marked.where(leaf).select("id", *values))
        # Rake: what the leaves hold, and what remains below each parent.
        folded = marked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            *[F.sum(F.when(leaf, F.col(v) + F.col(e)).otherwise(0)).alias(f"add_{v}") for v, e in zip(values, edge)],
            F.count("inner").alias("left"), F.max(F.when(~leaf, F.col("id"))).alias("only"))
        raked = stage_table(marked.where(~leaf).join(folded, "id").select(
            "id", "parent", *[(F.col(v) + F.col(f"add_{v}")).alias(v) for v in values], *edge, "left", "only"), "raked")
        # Compress: no two neighbours of a chain are both chosen.
        turn = len(finals)
        chosen = F.coalesce((F.col("left") == 1) & F.col("parent").isNotNull()
                            & _above(F.col("id"), F.col("parent"), turn)
                            & _above(F.col("id"), F.col("only"), turn), F.lit(False))
        cut = raked.where(chosen).select(
            F.col("only").alias("id"), F.col("id").alias("via"), F.col("parent").alias("up"),
            *[F.col(v).alias(f"via_{v}") for v in values],
            *[(F.col(v) + F.col(e)).alias(f"more_{v}") for v, e in zip(values, edge)])
        spliced = stage_table(raked.where(~chosen).join(cut, "id", "left"), "spliced")
        cuts.append(spliced.where("via IS NOT NULL").select(
            "id", "via", *[(F.col(f"via_{v}") + F.col(e)).alias(f"beside_{v}") for v, e in zip(values, edge)]))
        live = stage_table(spliced.select(
            "id", F.when(F.col("via").isNull(), F.col("parent")).otherwise(F.col("up")).alias("parent"), *values,
            *[(F.col(e) + F.coalesce(f"more_{v}", F.lit(0))).alias(e) for v, e in zip(values, edge)]), "live")
    known = None
    for final, gone in zip(reversed(finals), reversed(cuts)):
        if known is not None:
            back = stage_table(gone.join(known, "id").select(
                F.col("via").alias("id"), *[(F.col(v) + F.col(f"beside_{v}")).alias(v) for v in values]), "back")
            known = known.unionByName(back)
        known = final if known is None else known.unionByName(final)
    return tree.select("id", *values).limit(0) if known is None else known


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    nodes = stage_table(trie_nodes(rows), "trie")
    # Nodes of one depth have different members, so the smallest of them names a node.
    name = F.struct("conv_id", "depth")
    above = F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    tree = nodes.select(
        name.alias("id"), F.when(F.col("depth") > 0, above).alias("parent"),
        (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"]).select(
        "id.conv_id", "id.depth", "n_leaves", "saved_tokens")
    return nodes.join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the trie of all conversations."""
    return prefix_trie(C.table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS rank,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
whole AS (
  SELECT c.conv_id, list_concat(
    coalesce((SELECT list(b.said ORDER BY b.rank) FROM own b WHERE b.conv_id = c.conv_id - c.conv_id % 20 AND b.rank < c.h), []),
    coalesce((SELECT list(o.said ORDER BY o.rank) FROM own o WHERE o.conv_id = c.conv_id AND o.rank >= c.h), [])) AS turns
  FROM convs c),
paths AS MATERIALIZED (
  SELECT conv_id, d AS depth, turns[:d] AS prefix, turns[d].t AS last, d = len(turns) AS ends
  FROM whole, unnest(range(len(turns) + 1)) t(d)),
nodes AS MATERIALIZED (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(last) AS last,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY prefix, depth),
named AS MATERIALIZED (
  SELECT p.conv_id AS member, n.conv_id, n.depth FROM paths p JOIN nodes n ON p.prefix = n.prefix AND p.depth = n.depth),
family AS MATERIALIZED (
  SELECT n.*, m.conv_id AS parent_conv_id,
         (n.n_convs - 1) * len(regexp_extract_all(coalesce(n.last, ''), '[^\x20\x09-\x0D]+')) AS saved
  FROM nodes n LEFT JOIN named m ON m.member = n.conv_id AND m.depth = n.depth - 1),
kids AS MATERIALIZED (
  SELECT f.conv_id, f.depth, f.saved, (SELECT count(*) FROM family k WHERE k.parent_conv_id = f.conv_id AND k.depth = f.depth + 1) AS n_children
  FROM family f),
totals AS (
  SELECT a.conv_id, a.depth, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum(k.saved)::BIGINT AS saved_tokens
  FROM kids k JOIN named a ON a.member = k.conv_id AND a.depth <= k.depth GROUP BY a.conv_id, a.depth)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, k.n_children, t.n_leaves, t.saved_tokens, f.ends_sha256
FROM family f JOIN kids k USING (conv_id, depth) JOIN totals t USING (conv_id, depth)
"""
