"""Byte-level BPE by batched merge rounds in numpy.

The distinct words of a batch lie in one flat array of symbols. In each round
every adjacent pair is looked up by binary search among the sorted keys of the
merge list; each word merges all places of its lowest-ranked pair, and words
without a pair left leave the array. Ids of words met before are kept in a
bounded cache of the Python worker.

The vocabulary file (JSON of a byte-level BPE model) is a parameter; executors
read it at the same path. It must be a plain byte-level model: no normalizer,
no dropout, merges that only use symbols made before.

Defined results: null and empty texts encode to no ids and decode to the empty
text; special strings of the file become their ids; bytes of an invalid
sequence decode to replacement characters. Repeated rows give equal rows, an
empty table an empty result, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import common as C

# Fixed value: how byte-level models cut text into words before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHED_WORDS = 600_000  # the cache of a worker starts anew beyond this
LONG_WORD = 2_000  # bytes; longer words are merged through a heap, one merge at a time
SLICE_CHARS = 2_000_000  # characters of text encoded at once
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves,
    the others, in order, for the code points from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        alphabet = byte_alphabet()
        self.byte_ids = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.word = regex.compile(WORD_PATTERN)
        self.cut = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
                    if self.special else None)
        as_byte = {c: b for b, c in enumerate(alphabet)}
        size = 1 + max([*vocab.values(), *self.special.values()])
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = (bytes(as_byte[c] for c in token) if all(c in as_byte for c in token)
                         else token.encode())
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self._forget()

    # --- words -> ids --------------------------------------------------------------

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, dtype=np.int64)
        self.start = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs (NONE if not to be merged) and their places among the keys."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE), at

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [], []
        while len(symbols):
            inside = np.empty(len(symbols), dtype=bool)  # a pair begins here
            inside[-1] = False
            inside[:-1] = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), NONE)
            place = np.zeros(len(symbols), dtype=np.int64)
            here = np.flatnonzero(inside)
            rank[here], place[here] = self._find(symbols[here], symbols[here + 1])
            firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            counts = np.diff(np.r_[firsts, len(symbols)])
            best = np.minimum.reduceat(rank, firsts)
            active = np.repeat(best != NONE, counts)
            if not active.all():
                done_ids.append(symbols[~active])
                done_owner.append(owner[~active])
            merge = active & (rank == np.repeat(best, counts))
            # Of overlapping places (a run of one symbol) every second one merges.
            if (merge[1:] & merge[:-1]).any():
                run_start = merge & ~np.r_[False, merge[:-1]]
                at = np.flatnonzero(merge)
                run_first = np.flatnonzero(run_start)
                offset = at - run_first[np.cumsum(run_start[at]) - 1]
                merge[at[offset % 2 == 1]] = False
            symbols = np.where(merge, self.made[place], symbols)
            keep = active & ~np.r_[False, merge[:-1]]
            symbols, owner = symbols[keep], owner[keep]
        ids = np.concatenate([np.empty(0, dtype=np.int64), *done_ids])
        of = np.concatenate([np.empty(0, dtype=np.int64), *done_owner])
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long word: lowest rank, then leftmost, from a heap."""
        n = len(word)
        symbol = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, place = self._find(np.array(symbol[:-1]), np.array(symbol[1:]))
        heap = [(r, i, symbol[i], symbol[i + 1], p)
                for i, (r, p) in enumerate(zip(rank.tolist(), place.tolist())) if r != NONE]
        heapq.heapify(heap)
        alive = [True] * n

        def push(i: int, j: int) -> None:
            wanted = symbol[i] << 32 | symbol[j]
            p = int(np.searchsorted(self.keys, wanted))
            if p < len(self.keys) and self.keys[p] == wanted:
                heapq.heappush(heap, (int(self.ranks[p]), i, symbol[i], symbol[j], p))

        while heap:
            _, i, a, b, p = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], alive[j], after[i] = int(self.made[p]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([s for s, live in zip(symbol, alive) if live], dtype=np.int64)

    def _learn(self, words: set[str]) -> None:
        """Adds the ids of new words to the cache."""
        fresh = list(words)
        raw = [w.encode() for w in fresh]
        long = [i for i, w in enumerate(raw) if len(w) > LONG_WORD]
        flat, sizes = self.merge_words([w if len(w) <= LONG_WORD else b"" for w in raw] if long else raw)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        tail = [self.flat, flat]
        for i in long:
            ids = self.merge_long(raw[i])
            starts[i], sizes[i] = sum(map(len, tail)), len(ids)
            tail.append(ids)
        self.flat = np.concatenate(tail)
        self.start, self.size = np.r_[self.start, starts], np.r_[self.size, sizes]
        self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))

    def _word_list(self, text: str) -> list[str]:
        """Words of the text; special strings stand for themselves."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.word.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.word.findall(part)
        return out

    def _ready(self) -> None:
        """Starts the cache, and starts it anew where it has become too large."""
        if len(self.index) > CACHED_WORDS:
            self._forget()
        if not self.index:  # special strings have their ids from the start
            self.index = {s: i for i, s in enumerate(self.special)}
            self.flat = np.array(list(self.special.values()), dtype=np.int64)
            self.start = np.arange(len(self.special), dtype=np.int64)
            self.size = np.ones(len(self.special), dtype=np.int64)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        words = [self._word_list(t) for t in texts]
        self._ready()
        every = list(chain.from_iterable(words))
        at = np.fromiter(map(self.index.get, every, repeat(-1)), dtype=np.int64, count=len(every))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn({every[i] for i in new})
            at[new] = [self.index[every[i]] for i in new]
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        so_far = np.r_[0, np.cumsum(self.size[at])]
        return _gather(self.flat, self.start[at], self.size[at]), np.diff(np.r_[0, so_far[ends]])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        words = [self._word_list(t) for t in texts]
        self._ready()
        fresh = set().union(*words).difference(self.index)
        if fresh:
            self._learn(fresh)
        out = []
        for w in words:
            at = np.fromiter(map(self.index.__getitem__, w), dtype=np.int64, count=len(w))
            out.append(_gather(self.flat, self.start[at], self.size[at]))
        return out

    # --- ids -> text -----------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        raw = _gather(self.token_bytes, self.token_start[ids], self.token_size[ids])
        return raw.tobytes().decode("utf-8", errors="replace")


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches flat[start:start + size], one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - ends + size, size) + np.arange(total)]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about SLICE_CHARS characters, with their first index."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE_CHARS or i + 1 == len(texts):
            yield start, [x or "" for x in texts[start:i + 1]]
            start, chars = i + 1, 0


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files lie on this machine; executors have the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number and checksum of the ids, checksum of the text decoded from them."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, part in slices(texts):
                encoded = bpe.encode_batch(part)
                yield pa.RecordBatch.from_arrays([
                    doc_ids.slice(start, len(part)),
                    pa.array([len(x) for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in encoded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in encoded], pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for start, part in slices(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(part)),
                     pa.array([x.astype(np.int32) for x in bpe.encode_batch(part)], pa.list_(pa.int32()))],
                    ["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every whole text encoded and decoded again."""
    return encode_digests(C.table(spark, sf_dir, "documents"), vocabulary_path())
