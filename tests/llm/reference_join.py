"""Brute force for the near-duplicate join: all pairs, real sets."""

import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def components(texts, percent=90, words=3):
    """doc_id -> smallest doc_id reachable."""
    sets = {d: shingles(t, words) for d, t in texts.items()}
    name = {d: d for d in texts}

    def root(d):
        while name[d] != d:
            d = name[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                name[max(x, y)] = min(x, y)
    return {d: root(d) for d in texts}
