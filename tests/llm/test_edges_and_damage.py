"""Archives, vector codes, the prefix trie and language samples: edge tables, brute force, damage."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import common, language_id, prefix_trie, vector_codes, warc


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


# --- 11 ---


def pages_of(spark, values):
    extra = [F.lit("x").alias(c) for c in ("key", "value", "rows", "html_", "_cell", "refers_to")]
    return spark.createDataFrame(values, "page_id bigint, url string, html string").select("*", *extra)


PAGES = [
    (1, "http://a/ b\r\nX: y", "same"), (2, "http://b", "same"), (9, None, "same"), (3, "", ""), (4, "u", None),
    (5, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (6, "u", "a\r\n\r\nb é\0"),
    (7, "u", "long " * 400_000), (8, "u", "tie"), (8, "u", "tie"), (None, "u", "null id"), (None, "u", "same"),
    (10, "u", "only null ids" * 3),
]


def expected_pages(values, min_bytes=0):
    raw = [(i, (h or "").encode()) for i, _, h in values]
    top = {}
    for i, h in raw:
        top[h] = i if top.get(h) is None else max(x for x in (top[h], i if i is not None else top[h]))
    out = []
    for i, h in raw:
        sha = base64.b32encode(hashlib.sha1(h).digest()).decode()
        revisit = len(h) >= min_bytes and i != top[h]
        out.append((i, len(h), sha, "revisit" if revisit else "response", top[h] if revisit else None))
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("min_bytes, archive_bytes", [(0, 1 << 20), (5, 1), (0, 1 << 40)])
def test_archives_round_trip(spark, tmp_path, min_bytes, archive_bytes):
    path = str(tmp_path / "out")
    warc.write_archives(pages_of(spark, PAGES), path, min_bytes, archive_bytes)
    entries = warc.read_archives(spark, path, payloads=True)
    assert entries.where("reason IS NOT NULL").count() == 0
    got = entries.select(warc._page("record_id"), "payload_bytes", "payload_digest", "record_type",
                         warc._page("refers_to"))
    assert rows(got) == expected_pages(PAGES, min_bytes)
    payloads = {bytes(r["payload"]) for r in entries.where("record_type = 'response'").collect()}
    assert payloads == {(h or "").encode() for _, _, h in PAGES}


def test_archive_query_on_edges_and_empty_tables(spark, tmp_path):
    pages_of(spark, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert rows(warc.warc_query(spark, str(tmp_path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == expected_pages(PAGES)
    pages_of(spark, []).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert warc.warc_query(spark, str(tmp_path / "none")).count() == 0


def test_members_are_read_by_gzip_and_large_ones_end_in_zero():
    big = b"x" * (1 << 24) + b"end"
    for raw in (b"", b"abc", big):
        packed = warc.member(raw)
        assert packed.endswith(b"\0") and gzip.decompress(packed) == raw


def payloads_of(data):
    found = list(warc.salvage(data))
    return [e.payload for e in found if e.reason is None], [(e.start, e.length) for e in found if e.reason and not e.inner]


RECORDS = [warc.record(i, "http://u", f"payload {i} ".encode() * (i + 1)) for i in range(6)]
BODIES = [f"payload {i} ".encode() * (i + 1) for i in range(6)]


@pytest.mark.parametrize("packed", [True, False])
def test_damaged_records_are_skipped_and_logged(packed):
    parts = [warc.member(r) if packed else r for r in RECORDS]
    offsets = np.cumsum([0] + [len(p) for p in parts])
    data = b"".join(parts)
    assert payloads_of(data) == (BODIES, [])
    hurt = bytearray(data)
    for i in (1, 2, 4):  # one byte of each member, or of each payload
        hurt[(offsets[i] + offsets[i + 1]) // 2 + 20 if packed else offsets[i + 1] - 6] ^= 0x55
    got, gaps = payloads_of(bytes(hurt))
    assert got == [BODIES[i] for i in (0, 3, 5)]
    assert gaps == [(offsets[1], offsets[3] - offsets[1]), (offsets[4], len(parts[4]))]
    # Cut in the last record, junk before the first and between others.
    cut = b"junk" + parts[0] + b"\0" * 9 + parts[1] + parts[2][:-7]
    got, gaps = payloads_of(cut)
    assert got == BODIES[:3 if packed else 2]  # a cut member may still hold its whole record
    assert gaps == [(0, 4), (4 + len(parts[0]), 9), (4 + len(parts[0]) + 9 + len(parts[1]), len(parts[2]) - 7)]


def test_random_damage_loses_only_what_it_hits():
    rng = random.Random(5)
    for _ in range(60):
        parts = [warc.member(r) if rng.random() < 0.6 else r for r in RECORDS]
        offsets = np.cumsum([0] + [len(p) for p in parts])
        data, hit = bytearray(b"".join(parts)), set()
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(data))
            data[at] ^= rng.randint(1, 255)
            hit.add(int(np.searchsorted(offsets, at, side="right")) - 1)
        got, gaps = payloads_of(bytes(data))
        whole = [BODIES[i] for i in range(6) if i not in hit]
        assert [b for b in got if b in whole] == whole
        for start, length in gaps:  # gaps never cover a sound record
            for i in set(range(6)) - hit:
                assert start + length <= offsets[i] or start >= offsets[i + 1]


def test_member_of_many_records_gives_those_before_its_damage():
    data = gzip.compress(b"".join(RECORDS[:3]) + RECORDS[3][:-9] + RECORDS[4], mtime=0)
    got, _ = payloads_of(data)
    assert got == BODIES[:3] + [BODIES[4]]
    entries = list(warc.salvage(data))
    assert [e.inner for e in entries if e.reason is None][1] == len(RECORDS[0])
    lost = [e for e in entries if e.reason]
    assert len(lost) == 1 and lost[0].inner == sum(map(len, RECORDS[:3]))
    noise = b"".join(bytes([random.Random(i).randrange(256)]) * 3 for i in range(60_000))
    cut = gzip.compress(b"".join(RECORDS) + noise, mtime=0)[:-200]
    got, gaps = payloads_of(cut + warc.member(RECORDS[5]))
    assert got[:6] == BODIES and got[-1] == BODIES[5] and gaps[0][0] == 0 and gaps[0][1] == len(cut)


def test_hot_payloads_meet_over_many_cells(spark):
    values = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = values.groupBy("k").agg(F.count("*").alias("rows"), F.max("id").alias("top"))
    met = common.join_groups(values, groups, "k", "rows", 3000)
    assert met.count() == 3000 and met.columns == ["k", "id", "top"]
    assert met.where("k = 0").select("top").distinct().collect()[0][0] == 2997
    assert met.where("k <> 0 AND top <> id").count() == 0


# --- 12 ---


def brute_codes(vectors, entries=256, parts=4, rounds=4):
    """Plain k-means in Python's integers."""
    whole = [(i, [int(np.floor(float(x) * 1024)) for x in v], label) for i, v, label in vectors
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(whole[0][1])
    cuts = [p * width // parts for p in range(parts + 1)]
    books = [[v[a:b] for _, v, _ in whole[:entries]] for a, b in zip(cuts, cuts[1:])]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            members = {}
            for _, v, _ in whole:
                members.setdefault(nearest(v[a:b], books[p])[1], []).append(v[a:b])
            for k, xs in members.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], {}
    for i, v, label in whole:
        found = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, by_label[l], sha) for i, c, e, l in out],
                  key=lambda r: tuple((v is not None, str(v)) for v in r))


VECTOR = "vec_id bigint, embedding array<float>, label int"


def codes(df, **kwargs):
    return rows(vector_codes.vector_codes(df, **kwargs).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"))


@pytest.mark.parametrize("width, spread", [(8, 1), (10, 4), (3, 1000), (16, 0.02), (8, 1e5)])
def test_codes_equal_brute_force(spark, width, spread):
    rng = np.random.default_rng(width)
    values = [(i, [float(x) for x in rng.normal(0, spread, width).astype("f4")], int(i % 4) if i % 5 else None)
              for i in range(300)]
    values += [(i + 300, values[i % 7][1], 1) for i in range(40)]  # copies
    df = spark.createDataFrame(values, VECTOR)
    assert codes(df, entries=16, rounds=2) == brute_codes(values, 16, rounds=2)


def test_vector_edges(spark, tmp_path):
    v = [0.5, -0.25, 0.125, -1.0]
    values = [(3, v, 1), (3, v, 1), (None, v, None), (1, None, 1), (2, [0.5, None, 0.1, 0.2], 1),
              (4, [float("nan"), 0.0, 0.0, 0.0], 1), (5, [float("inf"), 0.0, 0.0, 0.0], 1), (6, [-0.0003] * 4, None)]
    df = spark.createDataFrame(values, VECTOR).withColumn("key", F.lit("x")).withColumn("code", F.lit("x"))
    assert codes(df) == brute_codes(values)
    longer = spark.createDataFrame([(0, v, 1), (1, v * 2, 1), (2, [], 1)], VECTOR)
    assert [(r["vec_id"], r["code"]) for r in vector_codes.vector_codes(longer).orderBy("vec_id").collect()] == [
        (0, "00000000"), (1, None), (2, None)]
    huge = codes(spark.createDataFrame([(0, [3e38] * 4, 1), (1, [-3e38] * 4, 1)], VECTOR))
    assert [r[1] for r in huge] == ["00000000", "01010101"]
    assert codes(spark.createDataFrame([], VECTOR)) == []
    assert len(codes(spark.createDataFrame([(0, [], 1)], VECTOR))) == 1


def test_tree_finds_the_nearest_entry_and_leaves_out_others():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (16, 4))
    entries = (centres[np.arange(256) % 16] + rng.integers(-40, 40, (256, 4))).astype(float)
    entries[100:120] = entries[:20]  # ties
    queries = np.vstack([centres[rng.integers(0, 16, 2000)] + rng.integers(-90, 90, (2000, 4)), entries]).astype(float)
    d = vector_codes.squared(queries, entries)
    search = vector_codes.Search(entries, vector_codes.grow(entries), queries)
    assert (search.index == d.argmin(1)).all() and (search.error == d.min(1)).all()
    assert search.measured < 0.6 * d.size


# --- 13 ---


def brute_trie(values):
    own = {}
    for conv, turn, role, text in values:
        if conv is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), int(digest[:15], 16),
                                             int(digest[15:30], 16), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members)]
        ends = ",".join(str(c) for c in sorted(convs) if built[c] == node)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    sum(len(m) == len(node) + 1 and m[:len(node)] == node for m in members), len(leaves),
                    sum((len(members[n]) - 1) * len(n[-1][1].split()) for n in below if n),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


def trie(spark, values):
    df = spark.createDataFrame(values, CONVERSATION)
    for c in ("depth", "key", "a", "rank", "node", "id"):
        df = df.withColumn(c, F.lit("x"))
    return rows(prefix_trie.prefix_trie(df))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    values = []
    for c in [*range(0, 45), *range(-25, 0), 1000, 1007]:
        if rng.random() < 0.8:
            n = rng.choice([1, 1, 2, 3, 5, 9])
            values += [(c, t, rng.choice(["user", "bot"]), f"say {rng.choice('ab')}") for t in range(n)]
    rng.shuffle(values)
    assert trie(spark, values) == brute_trie(values)


def test_trie_edges(spark, tmp_path):
    values = [(20, None, None, None), (20, 1, "u", ""), (20, 1, "u", "x y"), (20, 1, "u", "x y"), (21, 5, "u", None),
              (None, 1, "u", "lost"), (23, 1, "u", "w " * 50_000), (24, 1, None, " "), (3, 0, "a", "b")]
    assert trie(spark, values) == brute_trie(values)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "u", "x")]) == []
    spark.createDataFrame(values, CONVERSATION).write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows(prefix_trie.prefix_trie_query(spark, str(tmp_path))) == brute_trie(values)


def test_long_and_hot_conversations(spark, monkeypatch):
    """Stretches of four turns and chunks of four ids: every path over more than one of them."""
    monkeypatch.setattr(prefix_trie, "STRETCH_BITS", 2)
    values = [(40, t, "u", f"t{t % 3}") for t in range(30)] + [(c, t, "u", "hi") for c in range(60, 80) for t in range(4)]
    assert trie(spark, values) == brute_trie(values)


def brute_totals(parent, value):
    total = dict(value)
    for node in sorted(parent, key=lambda n: -depth(parent, n)):
        if parent[node] is not None:
            total[parent[node]] += total[node]
    return total


def depth(parent, node):
    n = 0
    while parent[node] is not None:
        node, n = parent[node], n + 1
    return n


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest", "caterpillar"])
def test_contraction_of_any_tree(spark, shape):
    rng = random.Random(shape)
    n = 120
    parent = {0: None}
    for i in range(1, n):
        parent[i] = {"chain": i - 1, "star": 0, "random": rng.randrange(i), "forest": None if i % 9 == 0 else i - 1,
                     "caterpillar": i - 1 if i % 2 else max(0, i - 2)}[shape]
    value = {i: rng.randrange(1000) for i in range(n)}
    tree = spark.createDataFrame([(i, parent[i], value[i], 1) for i in range(n)],
                                 "id bigint, parent bigint, worth bigint, one bigint")
    got = {r["id"]: (r["worth"], r["one"]) for r in prefix_trie.subtree_totals(tree, ["worth", "one"]).collect()}
    worth, one = brute_totals(parent, value), brute_totals(parent, dict.fromkeys(parent, 1))
    assert got == {i: (worth[i], one[i]) for i in range(n)}


# --- 3 ---


def language_rows(rng, lang, n, alphabet, ident=None):
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(60)]
    return [(ident if ident is not None else rng.randrange(1 << 40),
             "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(3)), lang) for _ in range(n)]


@pytest.mark.parametrize("case", ["hot line", "hot id", "hot copy", "one long line", "marks"])
def test_every_language_is_learned_whatever_is_hot(spark, case):
    rng = random.Random(case)
    ident = 4 if case == "hot id" else None
    rows_ = language_rows(rng, "x", 500, "abcdef", ident) + language_rows(rng, "y", 500, "ghijkl", ident)
    if case == "hot line":
        rows_ = [(i, t + "\nshared words of every document", lang) for i, t, lang in rows_]
    if case == "hot copy":
        rows_ += [(i, rows_[0][1], "x") for i in range(2000)]
    if case == "one long line":
        rows_ = [r for r in rows_ if r[2] == "x"] + [(7, " ".join(t.replace("\n", " ") for _, t, lang in rows_ if lang == "y"), "y")]
    if case == "marks":  # letters and the marks upon them are one word
        rows_ = [(i, t.replace("a", "á").replace("g", "गी"), lang) for i, t, lang in rows_]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string, lang string")
    sample = language_id._sample(docs, 50, 200)
    for lang in "xy":
        mine = [s for k, s in sample if k == lang]
        assert len(mine) == len(set(mine)) > 100
    if case == "one long line":  # not its beginning alone
        line = rows_[-1][1]
        assert max(line.index(s) for k, s in sample if k == "y") > 0.8 * len(line)
    found = language_id.identify(docs, language_id.fit(docs, 50, 200), ("doc_id", "lang"))
    right = found.select((F.col("row.lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.95


def test_language_filter_drops_unlearned_scripts_and_keeps_mixed_text(spark):
    """The tagger has no ground to label words of a script it never saw; a mix of learned languages is clean."""
    rng = random.Random(5)
    letters = {"x": "abcde", "y": "fghij", "z": "klmno", "w": "pqrst"}

    def words(lang, n):
        return [" ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 6))) for _ in range(n))]

    learned = [(i, words(lang, 40)[0], lang) for i, lang in enumerate("xyzw" * 60)]
    mixed = " ".join(w for lang in "xyzw" for w in words(lang, 12))
    odd = ["Быстрая лиса прыгает через ленивую собаку " * 5, "η γρήγορη καφετιά αλεπού πηδά " * 5, "1234 5678"]
    asked = [(10_000, mixed, None)] + [(10_001 + i, t, None) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(learned + asked, "doc_id bigint, text string, lang string")
    left = {r["doc_id"] for r in language_id.filter_documents(docs).collect()}
    assert left == {r[0] for r in learned} | {10_000}
