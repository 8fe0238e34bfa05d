"""Best-fit packing by bin completion with branch and bound.

Documents become token ids with an end id; longer ones than a sequence are cut
into whole sequences, the shorter rest coming first. What is left is a bin
packing of lengths, and how lengths are combined depends on their histogram
alone: at most ``capacity`` numbers, whatever the corpus.

The search works on that histogram. Around the largest length left it
enumerates fillings of the free room, longest pieces first, so that a filling
dominated by another (its pieces fit into the other's) comes after it; the
best-fit filling is the first incumbent, branches whose waste cannot fall below
the incumbent's are cut, and a filling without waste ends the search. The
filling is used as often as its lengths allow, so every step uses up a length.

Spark then numbers the pieces of each length (a hot length is dealt over many
cells) and each piece looks up its place in the plan, which is a table of at
most a few stretches per length pair.

Defined results: null and empty texts are one piece, the end id alone; repeated
rows are packed each; an empty table gives an empty result; extra columns are
ignored. Pieces equal in id, place and checksum are interchangeable.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import common as C
from tallymark.llm.bpe import load, slices, vocabulary_path
from tallymark.session import stage_table

CAPACITY = 1024
END_ID = 2
NODES = 3_000  # branches tried for one filling before the incumbent is taken
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# --- the plan, from the histogram ---------------------------------------------------------


class _Search:
    """Fillings of ``room`` from the lengths in ``left``."""

    def __init__(self, left: np.ndarray, room: int):
        self.left, self.room, self.nodes = left, room, 0
        self.best, self.waste = self._best_fit(), 0
        self.waste = room - sum(self.best)

    def _best_fit(self) -> list[int]:
        out, room, used = [], self.room, {}
        while room > 0:
            fits = np.flatnonzero(self.left[1:room + 1]) + 1
            fits = fits[::-1]
            pick = next((int(x) for x in fits if self.left[x] > used.get(int(x), 0)), 0)
            if not pick:
                break
            out.append(pick)
            used[pick] = used.get(pick, 0) + 1
            room -= pick
        return out

    def run(self) -> list[int]:
        # Few long pieces first: a filling of fewer pieces leaves the small ones for later.
        for pieces in range(1, self.room + 1):
            if self.waste == 0 or self.nodes > NODES:
                break
            if not self._deepen(self.room, self.room, pieces, []):
                break
        return self.best

    def _deepen(self, room: int, longest: int, pieces: int, chosen: list[int]) -> bool:
        """Whether some filling of exactly ``pieces`` more pieces exists below this branch."""
        self.nodes += 1
        if pieces == 1:
            fits = np.flatnonzero(self.left[1:min(room, longest) + 1]) + 1
            for x in fits[::-1]:
                x = int(x)
                if room - x >= self.waste:
                    return True
                if self.left[x] > chosen.count(x):
                    self.best, self.waste = [*chosen, x], room - x
                    return True
            return len(fits) > 0
        found = False
        for x in (np.flatnonzero(self.left[1:min(room - 1, longest) + 1]) + 1)[::-1]:
            x = int(x)
            if self.waste == 0 or self.nodes > NODES or room - x * pieces >= self.waste:
                return True  # shorter pieces leave at least as much room
            if self.left[x] > chosen.count(x):
                found |= self._deepen(room - x, x, pieces - 1, [*chosen, x])
        return found


@dataclass
class Plan:
    """Stretches of the pieces of each length: piece number i in [begin, end) of a
    length lies in sequence first + (i - begin) // each, at offset + (i - begin) % each * length."""

    sequences: int = 0
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)

    def arrays(self) -> dict[int, np.ndarray]:
        by_length: dict[int, list] = {}
        for length, *rest in self.rows:
            by_length.setdefault(length, []).append(rest)
        return {k: np.array(sorted(v), dtype=np.int64) for k, v in by_length.items()}


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """How the pieces counted in ``histogram`` (length -> count) fill sequences."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    taken = np.zeros(capacity + 1, dtype=np.int64)
    out = Plan()
    for longest in range(capacity, 0, -1):
        while left[longest]:
            left[longest] -= 1
            filling = _Search(left, capacity - longest).run()
            left[longest] += 1
            need: dict[int, int] = {}
            for x in [longest, *filling]:
                need[x] = need.get(x, 0) + 1
            times = min(int(left[x]) // k for x, k in need.items())
            offset = 0
            for x, k in need.items():
                begin = int(taken[x])
                out.rows.append((x, begin, begin + k * times, out.sequences, k, offset))
                taken[x] += k * times
                left[x] -= k * times
                offset += k * x
            out.sequences += times
    return out


# --- pieces and their places -------------------------------------------------------------------


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: place, length and checksum of the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            doc_ids = batch.column(0)
            for at, part in slices(batch.column(1).to_pylist()):
                ids, sizes = bpe.encode_flat(part)
                sizes += 1
                # Pieces of a document: all whole but the first.
                counts = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = (sizes - 1) % capacity + 1
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[owner], capacity)
                # The ids of the slice, each document's end id after them.
                flat = np.full(int(sizes.sum()), END_ID, dtype="<u4")
                inside = np.ones(len(flat), dtype=bool)
                inside[np.cumsum(sizes) - 1] = False
                flat[inside] = ids
                begin = np.repeat(np.cumsum(sizes) - sizes, counts) + start
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(at + owner)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECE_SCHEMA)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and offset."""
    cut = stage_table(pieces(docs, path, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    stretches = plan(histogram, capacity).arrays()
    numbered = C.gapless_index(
        cut, "length", F.xxhash64("doc_id", "piece", "ids_crc32"),
        [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")], "_index", histogram)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            index = batch.column("_index").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for value in np.unique(length):
                here = np.flatnonzero(length == value)
                table = stretches[int(value)]
                row = table[np.searchsorted(table[:, 0], index[here], side="right") - 1]
                nth = index[here] - row[:, 0]
                sequence[here] = row[:, 2] + nth // row[:, 3]
                offset[here] = row[:, 4] + nth % row[:, 3] * value
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return (numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "_index")
            .mapInArrow(place, PIECE_SCHEMA + ", sequence_id bigint, offset bigint"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents in sequences of at most 1024 tokens."""
    return pack(C.table(spark, sf_dir, "documents"), vocabulary_path())
