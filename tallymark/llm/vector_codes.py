"""Product quantisation of vectors, entries searched through a GNAT.

Vectors become integers, floor(1024 * x), and are cut into equal consecutive
parts; each part position learns a codebook by rounds of assignment and
integer means. Rounds are jobs over the written parts: tasks give at most one
sum per part and entry for each batch, Spark adds them up, and the driver holds
the codebooks, whose size is fixed (parts * entries * width).

The nearest entry is found with a geometric near-neighbour access tree per
codebook: each node has split points, the other entries hang below the split
point nearest to them, and for every (split point, child) the tree stores the
range of distances from the point to all entries of the child. A query measures
its distances to the split points; a child is left out where these show that all
its entries are strictly farther than the best one found. Distances of this test
are widened by more than any rounding error, entries themselves are compared by
exact integer distances, the lower index first, so results are those of the full
search.

Defined results: rows without a vector or with a null or non-finite component
go; a null vec_id comes after all others, equal ids are ordered by their vectors;
with fewer rows than entries the codebook is as small as the table; the parts
of a length that they do not divide differ by one; a vector of another length than
that of the first vec_id gets no code; integers and sums beyond a long are its
largest or smallest value;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import common as C
from tallymark.session import stage_table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
SPLITS = 8  # split points of a node
WIDEN = 1e-9  # relative; doubles err by less than 1e-14 here
EXACT = 1 << 53  # integers below this are exact in doubles
LONGEST = (1 << 63) - 1


# --- the tree ---------------------------------------------------------------------------------


@dataclass
class Node:
    """Split points, and below each the entries nearest to it, with ``low`` and ``high``
    (split point x child): bounds on the distances from the point to the child's entries."""

    points: np.ndarray
    children: list[Node | None]
    low: np.ndarray
    high: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` and ``b``, integers held in doubles or as objects."""
    return (a * a).sum(1)[:, None] - 2 * a.dot(b.T) + (b * b).sum(1)[None, :]


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def grow(entries: np.ndarray, own: np.ndarray | None = None) -> Node | None:
    """The tree over the entries numbered ``own``; split points are chosen far apart."""
    own = np.arange(len(entries)) if own is None else own
    if not len(own):
        return None
    chosen = [0]
    away = squared(entries[own], entries[own[:1]])[:, 0]
    while len(chosen) < min(SPLITS, len(own)):
        rest = away.copy()
        rest[chosen] = -1
        chosen.append(int(np.argmax(rest)))
        away = np.minimum(away, squared(entries[own], entries[own[chosen[-1:]]])[:, 0])
    points = own[chosen]
    others = np.delete(own, chosen)
    far = squared(entries[points], entries[others])
    nearest = far.argmin(0) if len(others) else np.zeros(0, dtype=int)
    low = np.full((len(points), len(points)), np.inf)
    high = np.full((len(points), len(points)), -np.inf)
    children = []
    for j in range(len(points)):
        below = np.flatnonzero(nearest == j)
        children.append(grow(entries, others[below]))
        if len(below):
            d = _root(far[:, below])
            low[:, j], high[:, j] = d.min(1) * (1 - WIDEN), d.max(1) * (1 + WIDEN)
    return Node(points, children, low, high)


class Search:
    """Nearest entries of a block of queries; every entry left out was shown to be farther."""

    def __init__(self, entries: np.ndarray, tree: Node | None, queries: np.ndarray):
        self.entries, self.queries = entries, queries
        self.index = np.full(len(queries), -1, dtype=np.int64)
        self.error = np.full(len(queries), np.inf, dtype=queries.dtype)
        self.measured = 0
        if tree is not None and len(queries):
            self._visit(tree, np.arange(len(queries)))

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        d = squared(self.queries[rows], self.entries[node.points])
        self.measured += d.size
        for k, entry in enumerate(node.points):
            better = (d[:, k] < self.error[rows]) | ((d[:, k] == self.error[rows]) & (entry < self.index[rows]))
            self.error[rows[better]] = d[better, k]
            self.index[rows[better]] = entry
        away = _root(d)
        first = away.argmin(1)
        # The child of the nearest split point first: it shortens the distance to beat.
        for own in (True, False):
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                mine = np.flatnonzero((first == j) == own)
                least = np.maximum(away[mine] * (1 - WIDEN) - node.high[:, j],
                                   node.low[:, j] - away[mine] * (1 + WIDEN)).max(1)
                open_ = mine[least <= _root(self.error[rows[mine]]) * (1 + WIDEN)]
                if len(open_):
                    self._visit(child, rows[open_])


# --- codebooks --------------------------------------------------------------------------------


def bounds(width: int, parts: int = PARTS) -> list[int]:
    return [i * width // parts for i in range(parts + 1)]


def _fits(x: np.ndarray) -> bool:
    """Whether squared distances within and to values as large as these are exact in doubles."""
    return not x.size or 4 * max(int(x.max()), -int(x.min())) ** 2 * x.shape[1] < EXACT


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as doubles where their distances are exact so, else as Python's integers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)
    return flat.astype(np.float64 if _fits(flat) else object)


def _as_kind(entries: list[list[int]], like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and queries as the same kind, exact for both."""
    own = np.array(entries, dtype=object).reshape(len(entries), like.shape[1])
    if like.dtype != object and _fits(own):
        return own.astype(np.float64), like
    return own, like.astype(object) if like.dtype != object else like


Codebooks = list[list[list[int]]]


def assign(vectors: pa.Array, codebooks: Codebooks, trees: dict) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Index and exact squared distance of each part's nearest entry, and the matrix of the vectors."""
    matrix = _matrix(vectors, sum(len(c[0]) for c in codebooks))
    cuts = bounds(matrix.shape[1], len(codebooks))
    found, errors = [], []
    for p, entries in enumerate(codebooks):
        own, queries = _as_kind(entries, matrix[:, cuts[p]:cuts[p + 1]])
        key = (p, own.dtype)
        if key not in trees:
            trees[key] = grow(own)
        search = Search(own, trees[key], queries)
        found.append(search.index)
        errors.append(search.error)
    return found, errors, matrix


def integer_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label and the integers of every row that has a finite vector."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return rows.where(F.coalesce(whole, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("bigint")).alias("v"))


def first_codebooks(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> Codebooks:
    """The parts of the vectors with the smallest ids."""
    first = [r["v"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return []
    cuts = bounds(len(first[0]), parts)
    return [[list(v[a:b]) for v in first if len(v) == len(first[0])] for a, b in zip(cuts, cuts[1:])]


def means(vectors: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Every entry replaced by the floors of the means of its parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        for batch in batches:
            found, _, matrix = assign(batch.column(0), codebooks, trees)
            cuts = bounds(matrix.shape[1], len(codebooks))
            out = []
            for p, index in enumerate(found):
                order = np.argsort(index, kind="stable")
                used, at, n = np.unique(index[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(matrix[order, cuts[p]:cuts[p + 1]], at, axis=0)
                out += [(p, int(e), int(k), [int(s) for s in row]) for e, k, row in zip(used, n, sums)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["p", "e", "n", "sums"])

    width = sum(len(c[0]) for c in codebooks)
    parts = vectors.where(F.size("v") == width).select("v").mapInArrow(run, "p int, e int, n bigint, sums array<bigint>")
    longest = max(len(c[0]) for c in codebooks)
    total = parts.groupBy("p", "e").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(longest)])
    out = [[list(e) for e in c] for c in codebooks]
    for r in total.collect():  # one row per part and entry
        out[r["p"]][r["e"]] = [int(r[f"s{i}"]) // r["n"] for i in range(len(out[r["p"]][r["e"]]))]
    return out


def encode(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    width = sum(len(c[0]) for c in codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        for batch in batches:
            found, errors, _ = assign(batch.column("v"), codebooks, trees)
            code = ["".join(f"{int(i):02x}" for i in row) for row in zip(*found)]
            total = [min(sum(map(int, row)), LONGEST) for row in zip(*errors)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(total, pa.int64())],
                ["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    coded = (vectors.where(F.size("v") == width)
             .mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint"))
    return coded.unionByName(vectors.where(F.size("v") != width).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")))


def codebook_text(codebooks: Codebooks) -> str:
    """All components, by part, entry and place."""
    return ",".join(str(x) for part in codebooks for entry in part for x in entry)


def train(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    codebooks = first_codebooks(vectors, entries, parts)
    for _ in range(rounds if codebooks else 0):
        codebooks = means(vectors, codebooks)
    return codebooks


def vector_codes(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector kept."""
    vectors = stage_table(integer_vectors(rows), "vectors")
    codebooks = train(vectors, entries, parts, rounds)
    if not codebooks:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), *[
            F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    # A label is named by whether it is there and what it is, so that nulls meet.
    named = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
    coded = stage_table(encode(vectors, codebooks).withColumn("key", named), "codes")
    labels = stage_table(coded.groupBy("key").agg(
        F.count("*").alias("rows"),
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("bigint").alias("label_error")), "labels")
    total = labels.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return C.join_groups(coded, labels, "key", "rows", total).select(
        "vec_id", "label", "code", "error", "label_error",
        F.lit(hashlib.sha256(codebook_text(codebooks).encode()).hexdigest()).alias("codebooks_sha256"))


def vector_codes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all embeddings as four bytes."""
    return vector_codes(C.table(spark, sf_dir, "embeddings")).drop("label")


def _oracle() -> str:
    near = """SELECT p, vec_id, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
        SELECT q.p, q.vec_id, c.e, list_sum(list_transform(range(1, len(q.v) + 1),
            lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))::BIGINT AS d
        FROM parts q JOIN c{r} c ON q.p = c.p) GROUP BY p, vec_id"""
    out = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[(p * len(v) // {PARTS} + 1):((p + 1) * len(v) // {PARTS})] AS v
  FROM kept, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),"""
    for r in range(ROUNDS):
        out += f"""
a{r} AS MATERIALIZED ({near.format(r=r)}),
m{r} AS (SELECT a.p, a.e, i, floor(sum(q.v[i]) / count(*))::BIGINT AS x
  FROM a{r} a JOIN parts q USING (p, vec_id), unnest(range(1, len(q.v) + 1)) t(i) GROUP BY a.p, a.e, i),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c
  LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM m{r} GROUP BY p, e) m USING (p, e)),"""
    return out + f"""
final AS ({near.format(r=ROUNDS)}),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM final GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLE_SQL = _oracle()
