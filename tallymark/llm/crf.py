"""Linear-chain conditional random field over words, in numpy.

Features of a word are the hashes of its character n-grams with the word's ends
marked (so affixes are n-grams too) and of the whole word (its entry in a
lexicon). A label's score in a place is the sum of its weights for the word's
features; transitions between labels are learned with them. Chains of any
length are handled side by side, one step for all of them at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 18  # weights are kept for 2**BITS hashed features
BEGIN, END = 2, 3  # marks of a word's ends; no letter has these code points
GRAMS = (2, 3, 4)
CACHED_WORDS = 400_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slot(h: np.ndarray) -> np.ndarray:
    """Feature index of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs of all words: marked n-grams and the word as a whole."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    last = np.repeat(np.cumsum(sizes), sizes)  # end of the own word
    at = np.arange(len(codes))
    features, owners = [], []
    h = codes + np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * np.uint64(1000003) + codes[n - 1:]
            if n in GRAMS:
                whole = at[:len(h)] + n <= last[:len(h)]
                features.append(_slot(h[whole] + np.uint64(n)))
                owners.append(owner[:len(h)][whole])
        # The whole word: positions weigh in, and words of one set of letters differ.
        place = (at - (last - np.repeat(sizes, sizes))).astype(np.uint64)
        mixed = (codes + np.uint64(7)) * (_MIX + place * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(31)
        total = np.r_[np.uint64(0), np.cumsum(mixed)]
        ends = np.cumsum(sizes)
        features.append(_slot(total[ends] - total[ends - sizes] + np.uint64(99)))
        owners.append(np.arange(len(words)))
    return np.concatenate(features), np.concatenate(owners)


def chains(emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions: np.ndarray,
           pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of every place, and expected label pairs summed over all chains.

    Chain c is emissions[starts[c]:starts[c] + lengths[c]]; chains must not be empty.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    step = np.exp(transitions)
    forward, backward = np.empty_like(local), np.empty_like(local)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    for t in range(longest):
        at = starts[:active[t]] + t
        a = local[at] if t == 0 else (forward[at - 1] @ step) * local[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    backward[starts + lengths - 1] = 1.0
    for t in range(longest - 2, -1, -1):
        at = starts[:active[t + 1]] + t
        b = (backward[at + 1] * local[at + 1]) @ step.T
        backward[at] = b / b.sum(axis=1, keepdims=True)
    marginals = forward * backward
    marginals /= marginals.sum(axis=1, keepdims=True)
    if not pairs:
        return marginals, None
    inner = np.ones(len(local), dtype=bool)
    inner[starts + lengths - 1] = False
    at = np.flatnonzero(inner)
    joint = forward[at][:, :, None] * step[None] * (local[at + 1] * backward[at + 1])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return marginals, joint.sum(axis=0)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # features x labels
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        features, owners = word_features(words)
        out = np.empty((len(words), len(self.labels)))
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(owners, weights=self.weights[features, k], minlength=len(words))
        return out


def train(sequences: list[tuple[list[str], np.ndarray]], labels: list[str], updates: int = 300,
          batch: int = 96, rate: float = 0.15, decay: float = 1e-4, seed: int = 7) -> Crf:
    """Weights by AdaGrad on the likelihood of labelled chains.

    A chain is its words and either label numbers or, per word, the probability
    of each label. Passes over the chains go on until ``updates`` batches have
    been used.
    """
    hard = np.eye(len(labels))
    n = len(labels)
    model = Crf(labels, np.zeros((1 << BITS, n)), np.zeros((n, n)))
    seen, seen_t = np.full_like(model.weights, 1e-2), np.full_like(model.transitions, 1e-2)
    rng = np.random.default_rng(seed)
    sequences = [s for s in sequences if len(s[0])]
    per_pass = max(1, len(sequences) // batch)
    for _ in range(-(-updates // per_pass) if sequences else 0):
        for part in np.array_split(rng.permutation(len(sequences)), per_pass):
            chosen = [sequences[i] for i in part]
            words = [w for s, _ in chosen for w in s]
            gold = np.concatenate([y if y.ndim == 2 else hard[y] for _, y in chosen])
            lengths = np.array([len(s) for s, _ in chosen])
            starts = np.cumsum(lengths) - lengths
            distinct, of = np.unique(np.array(words, dtype=object), return_inverse=True)
            features, owners = word_features(distinct.tolist())
            scores = np.stack([np.bincount(owners, weights=model.weights[features, k], minlength=len(distinct))
                               for k in range(n)], axis=1)
            marginals, expected = chains(scores[of], starts, lengths, model.transitions, pairs=True)
            error = marginals - gold
            per_word = np.stack([np.bincount(of, weights=error[:, k], minlength=len(distinct)) for k in range(n)], axis=1)
            used, slot = np.unique(features, return_inverse=True)
            slope = np.stack([np.bincount(slot, weights=per_word[owners, k], minlength=len(used)) for k in range(n)], axis=1)
            slope = slope / len(chosen) + decay * model.weights[used]
            seen[used] += slope ** 2
            model.weights[used] -= rate * slope / np.sqrt(seen[used])
            inner = np.ones(len(gold), dtype=bool)
            inner[starts + lengths - 1] = False
            at = np.flatnonzero(inner)
            slope_t = (expected - gold[at].T @ gold[at + 1]) / len(chosen) + decay * model.transitions
            seen_t += slope_t ** 2
            model.transitions -= rate * slope_t / np.sqrt(seen_t)
    return model


class Tagger:
    """Marginals of many texts at once; scores of words met before are kept in a bounded table."""

    def __init__(self, model: Crf, pattern):
        self.model, self.pattern = model, pattern  # pattern finds words and line ends
        self._forget()

    def _forget(self) -> None:
        self.index = {"\n": 0}
        self.scores = np.zeros((1, len(self.model.labels)))

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the words of all texts in order, and each word's text number.

        A line is a chain.
        """
        found = [self.pattern.findall(t) for t in texts]
        if len(self.index) > CACHED_WORDS:
            self._forget()
        fresh = list(set().union(*found).difference(self.index))
        if fresh:
            self.scores = np.concatenate([self.scores, self.model.emissions(fresh)])
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        at = np.fromiter((i for f in found for i in map(self.index.__getitem__, f)), dtype=np.int64, count=int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        word = at > 0
        line = np.cumsum(~word) + text  # changes at line ends and from text to text
        at, text, line = at[word], text[word], line[word]
        if not len(at):
            return np.zeros((0, len(self.model.labels))), text
        starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        lengths = np.diff(np.r_[starts, len(at)])
        return chains(self.scores[at], starts, lengths, self.model.transitions)[0], text
