"""Language identification of code-switched text by a linear-chain CRF.

Each word gets a posterior over the languages by forward-backward along its
line; a document's shares of languages are the means over its words. The model
is trained on the driver from a bounded sample of labelled rows: for each
language at most ``SAMPLE_DOCS`` distinct texts, of whose whole lines at most
``SAMPLE_STRETCHES`` distinct stretches of ``CHAIN_WORDS`` words, both lowest by
hash. Stretches of different languages are joined into code-switched chains, from
which the transitions are learned.

Defined results: null texts and texts without a letter are ``und`` with score 0;
null languages are not learned from; without any labelled text all texts are
``und``; repeated rows give equal rows, an empty table an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm import common as C
from tallymark.llm.bpe import slices
from tallymark.llm.crf import Crf, Tagger, train

SAMPLE_DOCS = 400
SAMPLE_STRETCHES = 2_400
CHAIN_WORDS = 14  # longest stretch of one language in a training chain
UNDETERMINED = "und"
MIN_CERTAINTY = 1 / 3  # below, two thirds of the words are guesses
WORDS = regex.compile(r"[\p{L}\p{M}]+|\n")  # marks belong to their letters


def _sample(docs: DataFrame, texts_per_language: int, stretches_per_language: int) -> list[tuple[str, str]]:
    """(lang, stretch) of the sample, chosen by hash; languages are a closed set.

    Texts and stretches are distinct before they are chosen, so neither copies nor
    a line that very many documents share can fill the sample, and ids play no part.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    size = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("lang")]

    def lowest(df: DataFrame, value: str, wanted: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(value), value))
        return df.withColumn("r", rank).where(F.col("r") <= wanted).drop("r")

    chosen = lowest(rows.where(C.lowest_share("h", texts_per_language, size)).select("lang", "h").distinct(),
                    "h", texts_per_language)
    # At most texts_per_language hashes of each language: small enough to send to every task.
    texts = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi")
    words = texts.select("lang", F.explode(F.split("text", "\n", -1)).alias("line")).select(
        "lang", F.split("line", " ").alias("w"))
    stretches = words.select("lang", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - 1, F.lit(CHAIN_WORDS)),
        lambda i: F.array_join(F.slice("w", i + 1, CHAIN_WORDS), " "))).alias("stretch"))
    found = lowest(stretches.where("trim(stretch) <> ''").distinct(), "stretch", stretches_per_language).collect()
    return sorted((r["lang"], r["stretch"]) for r in found)


def fit(docs: DataFrame, texts_per_language: int = SAMPLE_DOCS,
        stretches_per_language: int = SAMPLE_STRETCHES) -> Crf | None:
    """A model from the rows' text and lang; None if there is nothing to learn from."""
    by_language: dict[str, list[list[str]]] = {}
    for lang, stretch in _sample(docs, texts_per_language, stretches_per_language):
        words = [w for w in WORDS.findall(stretch.lower()) if w != "\n"]
        if words:
            by_language.setdefault(lang, []).append(words)
    labels = sorted(by_language)
    if not labels:
        return None
    rng = np.random.default_rng(11)
    stretches = [(i, words) for i, lang in enumerate(labels) for words in by_language[lang]]
    order, sequences, at = rng.permutation(len(stretches)), [], 0
    while at < len(order):  # chains of one to four stretches
        part = [stretches[i] for i in order[at:at + int(rng.integers(1, 5))]]
        at += len(part)
        sequences.append(([w for _, s in part for w in s],
                          np.concatenate([np.full(len(s), i, dtype=np.int64) for i, s in part])))
    return train(sequences, labels)


def identify(docs: DataFrame, model: Crf | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The struct ``row`` of the columns ``keep``, lang_pred, score, the share of the second language, and certainty.

    Certainty is 0 where no word favours a language and 1 where every word has one,
    whichever it is: clean mixed text has a high one. One learned language is certain.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    if model is None:
        return docs.select(row, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0.0).alias("second_share"), F.lit(0.0).alias("certainty"))
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights.astype(np.float32), model.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, weights, transitions = sent.value
        tagger = Tagger(Crf(labels, weights, transitions), WORDS)
        names = np.array([*labels, UNDETERMINED], dtype=object)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at, part in slices(texts):
                marginals, text = tagger.marginals([t.lower() for t in part])
                n = np.bincount(text, minlength=len(part))
                shares = np.stack([np.bincount(text, weights=marginals[:, k], minlength=len(part))
                                   for k in range(len(labels))], axis=1) / np.maximum(n, 1)[:, None]
                sure = np.bincount(text, weights=marginals.max(axis=1), minlength=len(part)) / np.maximum(n, 1)
                chance = 1 / len(labels)
                sure = (sure - chance) / (1 - chance) if chance < 1 else np.ones(len(part))
                ranked = np.sort(shares, axis=1)
                best = shares.argmax(axis=1)
                # Signs such as superscript digits count as word characters but are no letters.
                silent = np.array([k == 0 or not any(map(str.isalpha, t)) for k, t in zip(n.tolist(), part)], dtype=bool)
                best[silent] = len(labels)
                score = np.where(silent, 0.0, np.clip(ranked[:, -1], 0, 1))
                second = np.where(silent | (len(labels) < 2), 0.0, ranked[:, -2] if len(labels) > 1 else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(at, len(part)), pa.array(names[best], pa.string()),
                     pa.array(score), pa.array(second), pa.array(np.where(silent, 0.0, np.clip(sure, 0, 1)))],
                    ["row", "lang_pred", "score", "second_share", "certainty"])
    rows = docs.select(row, "text")
    return rows.mapInArrow(run, rows.select("row").schema.add("lang_pred", "string").add("score", "double")
                           .add("second_share", "double").add("certainty", "double"))


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~C.is_held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text", "lang")


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the language of every document, from a model that never saw the held-out ones."""
    docs = C.table(spark, sf_dir, "documents")
    found = identify(docs, fit(_learnable(docs)))
    return found.select("row.doc_id", C.is_held_out(F.col("row.doc_id"), 5, 0).alias("held_out"),
                        "lang_pred", "score", "second_share")


def filter_documents(docs: DataFrame, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """The documents with a determined language, with their own columns.

    Text of a language or script that was not learned has words without a likeliest
    language, and goes; clean text mixed from several learned languages stays.
    """
    model = fit(_learnable(docs))
    return identify(docs, model, tuple(docs.columns)).where(
        (F.col("lang_pred") != UNDETERMINED) & (F.col("certainty") >= min_certainty)).select("row.*")
