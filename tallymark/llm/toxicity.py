"""Toxic spans by a linear-chain CRF, and document scores from its marginals.

Labels are given for documents, so words are labelled first. Over all learned
documents, a word's weight on either side is the number of unlike documents that
it stands in, copies and near copies (most of 32 min-hashes agree) being one. A word is toxic if its
weight among toxic documents is far above that among clean ones, and surely so
(log-likelihood ratio), where either side's total is its number of unlike
documents too; the share of its weight that is toxic is its label.
Chains are lines; forward-backward gives every word its probability of being
toxic. A document's score is a logistic function of the expected number of toxic
words, of their density and of how sure they are.

The tagger and the logistic function are trained on the driver from a sample of
at most ``SAMPLE_DOCS`` documents of either label, and of these at most
``SAMPLE_LINES`` lines with a toxic word and as many of clean documents, all
lowest by hash; the word counts have no bound.

Defined results: null and empty texts and texts without words score what the
function gives for no toxic word, near 0; without any learned toxic document all
scores are 0; an id with several labels is toxic
if one of them says so; repeated rows give equal rows, an empty table an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import common as C
from tallymark.llm.bpe import slices
from tallymark.llm.crf import Crf, Tagger, train
from tallymark.session import stage_table

SAMPLE_LINES = 3_000
HASHES = 32  # min-hashes of a text
BAND = 4  # that agree between texts which are compared
SAME = 24  # that agree between copies
MIN_DOCS = 2  # unlike toxic documents that a toxic word stands in at least
MIN_ODDS = 12.0  # times more often than in clean documents
MIN_RATIO = 24.0  # of log-likelihoods; chance exceeds it about once in a million words
UNLIKELY = 0.1
SAMPLE_DOCS = 1_500
# A word is a run of letters and marks of any script, here and in the JVM.
WORDS = regex.compile(r"[\p{L}\p{M}]+|\n")
JVM_SPLIT = r"[^\p{L}\p{M}]+"


def _words(text) -> Column:
    return F.filter(F.split(F.lower(text), JVM_SPLIT), lambda w: w != "")


def _prints(texts: DataFrame) -> DataFrame:
    """Distinct texts of each label (toxic, own: hash of the words), with how many rows have them
    and ``HASHES`` independent min-hashes of any two words in a row."""
    pairs = F.expr("transform(w, (x, i) -> xxhash64(x, get(w, i + 1)))")
    rng = np.random.default_rng(11)
    odd = rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            starts = column.offsets.to_numpy()[:-1].astype(np.int64) - column.offsets[0].as_py()
            h = column.flatten().to_numpy().view(np.uint64)
            out = np.empty((len(starts), HASHES), dtype=np.int32)
            for k in range(HASHES if len(starts) else 0):
                v = (h ^ (h >> np.uint64(31))) * odd[k]
                v = (v ^ (v >> np.uint64(29))) * odd[k - 1]
                out[:, k] = (np.minimum.reduceat(v, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, out.size + 1, HASHES, dtype=np.int32)), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["toxic", "own", "sketch"])
    return (texts.select("toxic", "own", pairs.alias("pairs"))
            .mapInArrow(run, "toxic int, own bigint, sketch array<int>")
            .groupBy("toxic", "own", "sketch").agg(F.count("*").alias("rows")))


def families(texts: DataFrame) -> DataFrame:
    """toxic, own, rows and family of each distinct text among (toxic, own, w).

    Texts that agree in a band of ``BAND`` min-hashes meet its least one; they are its
    copies if ``SAME`` of all min-hashes agree. A text's family is its least original,
    or its own.
    """
    prints = stage_table(_prints(texts), "prints")
    bands = prints.select("toxic", "own", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)),
        lambda i: F.xxhash64("toxic", i, F.slice("sketch", i * BAND + 1, BAND)))).alias("band"))
    originals = (bands.groupBy("band").agg(F.min("own").alias("family"), F.max("own").alias("last"))
                 .where("family <> last").select("band", "family"))
    met = bands.join(originals, "band").where("own <> family").select("toxic", "own", "family").distinct()
    agree = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda e: e))
    copies = (met.join(prints.select("toxic", "own", F.col("sketch").alias("a")), ["toxic", "own"])
              .join(prints.select("toxic", F.col("own").alias("family"), F.col("sketch").alias("b")), ["toxic", "family"])
              .where(agree >= SAME).groupBy("toxic", "own").agg(F.min("family").alias("family")))
    return prints.drop("sketch").join(copies, ["toxic", "own"], "left").withColumn("family", F.coalesce("family", "own"))


def _marks_toxic(toxic: int, clean: int) -> Column:
    """Whether t of ``toxic`` and n of ``clean`` unlike documents mark a word as toxic."""
    t, n = F.col("t"), F.col("n")
    rate, base = t / (t + n), toxic / (toxic + clean)
    odds = ((t + 0.5) / (toxic + 1)) / ((n + 0.5) / (clean + 1))
    ratio = 2 * (t * F.log(rate / base) + F.when(n > 0, n * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    return (t >= MIN_DOCS) & (rate > base) & (odds >= MIN_ODDS) & (ratio >= MIN_RATIO)


def toxic_words(labelled: DataFrame) -> DataFrame | None:
    """Words that mark toxic documents among ``labelled`` (doc_id, text, toxic), with their
    probability of doing so; None if there are no documents of one label."""
    words = _words(C.whole_text())
    texts = (labelled.select(F.col("toxic").cast("int").alias("toxic"), words.alias("w")).where("size(w) > 0")
             .withColumn("own", F.xxhash64("w")))
    kin = stage_table(families(texts), "families")
    groups = kin.groupBy("toxic", "family").agg(F.sum("rows").alias("members"))
    totals = {r["toxic"]: r["count"] for r in groups.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return None
    # The words of all rows are counted where their texts lie. Only texts with copies are
    # shuffled, to take off again what a family counts beyond one.
    copied = stage_table(kin.join(groups, ["toxic", "family"]).select("toxic", "own", "family", "members"), "copied")
    each = F.explode(F.array_distinct("w")).alias("word")
    beyond = (texts.join(copied.where("members > 1"), ["toxic", "own"])
              .select("toxic", "family", each).groupBy("word", "toxic", "family").agg((1 - F.count("*")).alias("c")))
    words = (texts.select(each, "toxic", F.lit(1).cast("bigint").alias("c"))
             .unionByName(stage_table(beyond.where("c < 0").drop("family"), "beyond", keys_first=True))
             .groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("c")).otherwise(0)).alias("t"),
                                  F.sum(F.when(F.col("toxic") == 0, F.col("c")).otherwise(0)).alias("n")))
    return (words.where(_marks_toxic(toxic, clean)).select("word", ((F.col("t") + 0.5) / (F.col("t") + F.col("n") + 1)).alias("p")))


def _lowest(rows: DataFrame, column: str, n: int) -> list:
    return rows.orderBy(F.xxhash64(column), column).limit(n).collect()


@dataclass
class Model:
    crf: Crf
    slope: np.ndarray  # of the logistic function: constant and one weight for each evidence


def evidence(tagger: Tagger, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: constant, expected toxic words (log), their density, how sure they are
    (log of the summed evidence); and the probability of every word with its text."""
    marginals, text = tagger.marginals(texts)
    toxic, n = marginals[:, 1], len(texts)
    likely = toxic >= UNLIKELY
    count = np.bincount(text[likely], weights=toxic[likely], minlength=n)
    sure = np.bincount(text[likely], weights=-np.log1p(-np.minimum(toxic[likely], 0.999)), minlength=n)
    density = np.sqrt(count / np.maximum(np.bincount(text, minlength=n), 1))
    return np.stack([np.ones(n), np.log1p(count), density, np.log1p(sure)], axis=1), toxic, text


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton steps for a ridge logistic regression; the constant is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (p - y) + shrink @ w)
    return w


def fit(labelled: DataFrame, sample_lines: int = SAMPLE_LINES, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from (doc_id, text, toxic); None if no word marks toxic documents."""
    marked = toxic_words(labelled)
    if marked is None:
        return None
    marked = stage_table(marked, "marked")
    if marked.isEmpty():
        return None
    # Ids first, so that only the chosen documents' texts are read on.
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    chosen = [r["doc_id"] for k, n in sorted(sizes.items()) for r in _lowest(
        labelled.where((F.col("toxic") == k) & C.lowest_share("doc_id", sample_docs, n)).select("doc_id"),
        "doc_id", sample_docs)]
    sample = stage_table(labelled.where(F.col("doc_id").isin(chosen)), "sample")
    lines = sample.select("toxic", F.explode(F.split(C.whole_text(), "\n", -1)).alias("line")).where("line <> ''")
    spoken = lines.select("toxic", "line", F.explode(_words(F.col("line"))).alias("word"))
    hits = spoken.where("toxic = 1").join(marked, "word")
    # Only the words of the sample come here, however many are marked.
    known = {r["word"]: r["p"] for r in spoken.select("word").distinct().join(marked, "word").collect()}
    sequences = []
    for r in (_lowest(hits.select("line").distinct(), "line", sample_lines)
              + _lowest(lines.where("toxic = 0").select("line").distinct(), "line", sample_lines)):
        words = WORDS.findall(r["line"].lower())
        if words:
            toxic = np.array([known.get(w, 0.0) for w in words])
            sequences.append((words, np.stack([1 - toxic, toxic], axis=1)))
    crf = train(sequences, ["clean", "toxic"])
    seen = evidence_of(sample, crf).toArrow()
    x = np.stack([c.to_numpy() for c in seen.columns[1:]], axis=1)
    return Model(crf, _logistic(x, seen.column("toxic").to_numpy().astype(float)))


def _sent(docs: DataFrame, crf: Crf):
    return docs.sparkSession.sparkContext.broadcast((crf.labels, crf.weights.astype(np.float32), crf.transitions))


def evidence_of(labelled: DataFrame, crf: Crf) -> DataFrame:
    """The label and the evidence of each document."""
    sent = _sent(labelled, crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Crf(*sent.value), WORDS)
        for batch in batches:
            for at, part in slices(batch.column(1).to_pylist()):
                x = evidence(tagger, [t.lower() for t in part])[0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), *map(pa.array, x.T.copy())],
                    ["toxic", "e0", "e1", "e2", "e3"])
    return labelled.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(
        run, "toxic int, e0 double, e1 double, e2 double, e3 double")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, and the offending stretches of the text (first and end character)."""
    schema = "doc_id bigint, score double, spans array<struct<begin:int,end:int>>"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"),
                           F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))
    sent, slope = _sent(docs, model.crf), model.slope

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Crf(*sent.value), WORDS)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at, part in slices(batch.column(1).to_pylist()):
                lowered = [t.lower() for t in part]
                x, toxic, text = evidence(tagger, lowered)
                value = 1 / (1 + np.exp(-np.clip(x @ slope, -30, 30)))
                spans: list[list[dict]] = [[] for _ in part]
                for i in np.unique(text[toxic >= 0.5]).tolist():
                    own = toxic[text == i]
                    # Lower-casing may lengthen a text; its own words then give the offsets.
                    source = part[i] if len(part[i]) == len(lowered[i]) else lowered[i]
                    found = [m.span() for m in WORDS.finditer(source) if m.group() != "\n"]
                    spans[i] = [{"begin": b, "end": e} for (b, e), p in zip(found, own) if p >= 0.5]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(value),
                     pa.array(spans, kind)], ["doc_id", "score", "spans"])
    return rows.mapInArrow(run, schema)


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document's toxicity, from a model that never saw the held-out labels."""
    docs = C.table(spark, sf_dir, "documents")
    held_out = C.is_held_out(F.col("doc_id"), 3, 1)
    known = F.col("toxic").isin(0, 1)
    labels = stage_table(C.table(spark, sf_dir, "labels").where(~held_out & known)
                         .groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    # Joined once and written, since several statistics read it. Said again, the condition
    # shows Spark that labels may be few, and texts without one are not shuffled.
    labelled = stage_table(docs.select("doc_id", "text").where(~held_out)
                           .join(labels.where(known), "doc_id"), "labelled", keys_first=True)
    return score(docs, fit(labelled)).select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"))
