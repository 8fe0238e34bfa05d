"""The methods against brute force, round trips and held-out rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from reference_join import components as brute_components

from tallymark import session
from tallymark.llm import bpe, crf, jaccard_join, language_id, license_scan, merkle, packing, quality_qda
from tallymark.llm import common, quality_rules, ring_shards, toxicity
from tallymark.llm.components import components


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


# --- 1 ---

def test_license_blocks_and_thresholds(spark):
    filler = " ".join(f"f{i}" for i in range(61))
    texts = [filler + " all rights reserved", "rights all reserved", "x ALL-Rights.Reserved y cc by cc by",
             "software obtaining copy permission hereby granted free charge any person this is to of a and "
             "associated documentation", "released under the license"]
    rows = {r["doc_id"]: r for r in license_scan.license_scan(
        frame(spark, texts), license_scan.PHRASES + license_scan.LICENSES).collect()}
    assert (rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"]) == (1, 61, 61)
    assert rows[1]["n_base"] == 0 and rows[1]["labels"] == ""
    assert (rows[2]["n_base"], rows[2]["base_labels"], rows[2]["first_word"], rows[2]["last_word"]) == (
        3, "cc-by,reserved", 1, 7)
    assert "mit" in rows[3]["labels"] and 0.85 <= rows[3]["score"] < 1
    assert rows[4]["score"] == 0


# --- 5 ---

def test_policies_and_ablations(spark):
    bits = [0, 1, 1 | 4, 4, 8, 64 | 4]
    entries = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "doc_id bigint, failed_bits bigint")
    kept = {p: [r["kept"] for r in quality_rules.apply_policy(entries, p).orderBy("doc_id").collect()]
            for p in quality_rules.POLICIES}
    assert kept["base"] == [True, False, False, True, True, True]
    assert kept["v2"] == [True] + [False] * 5
    found = {r["rule"]: r for r in quality_rules.ablations(entries).collect()}
    assert found["symbols"]["failing"] == 3 and found["symbols"]["failing_alone"] == 1
    assert found["symbols"]["kept_without"] == 2
    assert found["symbols"]["bits_in_any"] == 1 | 4 | 8 | 64 and found["symbols"]["documents"] == 6


# --- 10 ---

@pytest.mark.parametrize("n", [1, 7, 8, 1001])
def test_shards_balance_hot_texts(spark, n):
    rows = ring_shards.ring_shards(frame(spark, ["same" if i % 3 else f"t{i}" for i in range(n)])).collect()
    loads = Counter(r["shard"] for r in rows)
    assert len(rows) == n and max(loads.values()) - min(loads.get(s, 0) for s in range(8)) <= 1
    for s in loads:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(loads[s]))


def test_ring_moves_little(spark):
    texts = [f"text {i}" for i in range(800)]
    shard = lambda k: {r["doc_id"]: r["shard"] for r in
                       ring_shards.ring_shards(frame(spark, texts), shards=k, slack=0.25).collect()}
    before, after = shard(8), shard(9)
    assert max(Counter(after.values()).values()) <= 1.25 * 800 / 9 + 1
    assert sum(before[d] != after[d] for d in before) < 800 * 0.35


def test_arc_lookup_equals_search(spark):
    points = ring_shards.ring_points(5, 7)
    keys = [points[0][0], points[-1][0], points[-1][0] + 1, points[3][0] + 1, -(1 << 63), (1 << 63) - 1, 0]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").select(
        "k", ring_shards.arc_of(F.col("k"), points).alias("arc")).collect()
    assert all(r["arc"] == next((i for i, (p, _) in enumerate(points) if p >= r["k"]), 0) for r in rows)


def test_gapless_index_in_hot_groups(spark):
    rows = spark.range(3000).select((F.col("id") % 2).cast("int").alias("g"), (F.col("id") % 10).alias("x"), "id")
    out = common.gapless_index(rows, "g", F.xxhash64("id"), [F.col("id")], "i", {0: 1500, 1: 1500}).collect()
    for g in (0, 1):
        assert sorted(r["i"] for r in out if r["g"] == g) == list(range(1500))


# --- 7 ---

def test_next_document_and_edit_places(spark):
    texts = ["\n".join(f"p{d} {i}." for i in range(20)) for d in range(30)]
    rows = merkle.with_next(frame(spark, texts).repartition(4), merkle.tree).collect()
    assert {r["doc_id"]: r["next_text"] for r in rows} == {i: texts[i - 1] for i in range(30)}
    edited = texts[3].replace("p3 9.", "p3 nine.").replace("p3 17.", "p3 x.")
    pair = frame(spark, [texts[3]]).withColumn("edited", F.lit(edited)).select(
        merkle.tree(F.col("text")).alias("a"), merkle.tree(F.col("edited")).alias("b"))
    r = pair.select(merkle.differing(F.col("a"), F.col("b")).alias("places"),
                    merkle.likeness(F.col("a"), F.col("b")).alias("near")).first()
    assert r["places"] == [10, 18] and r["near"] == pytest.approx(18 / 20)


def test_single_document_follows_itself(spark):
    r = merkle.with_next(frame(spark, ["abc"]), merkle.tree).first()
    assert r["next_text"] == "abc"


# --- 4, 6 ---

def random_texts(n, seed=3):
    rng = random.Random(seed)
    pools = ["ab", "aaaa  \n\t", "abc dé'sßñ çé 12", "      a\x1c\x85", "漢字かな😀👩‍👩‍👧 ", "<|endoftext|> a<|", "'’'ll've"]
    return ["".join(rng.choice(rng.choice(pools)) if rng.random() < 0.9 else chr(rng.randint(1, 0x2FFF))
                    for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    texts = random_texts(600) + ["", "<|endoftext|>x<|endoftext|>", "a" * 5000, "the quick" * 400,
                                 "".join(random.Random(1).choice("abcdefgh") for _ in range(4000))]
    rows = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(frame(spark, texts), path).collect()}
    assert all(rows[i] == library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(frame(spark, texts), path), path).collect()}
    assert all(back[i] == t for i, t in enumerate(texts))


def test_bpe_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    model = bpe.Bpe(bpe.vocabulary_path())
    texts = random_texts(50)
    again = [x.tolist() for x in model.encode_batch(texts)]
    assert [model.encode_batch([t])[0].tolist() for t in texts] == again


def optimum(lengths, capacity):
    """Fewest bins, by search over all assignments."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= lengths[i]:
                place(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1:])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_plan_is_near_the_optimum():
    rng = random.Random(5)
    extra = 0
    for _ in range(40):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        extra += packing.plan(Counter(lengths), 20).sequences - optimum(lengths, 20)
    assert extra <= 1


def test_packing_is_whole(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.packing_query(spark, sf_dir).collect()
    library = Tokenizer.from_file(bpe.vocabulary_path())
    ids = {r["doc_id"]: np.array(library.encode(r["text"], add_special_tokens=False).ids + [2], dtype="<u4")
           for r in docs.collect()}
    by_sequence = {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["length"] <= 1024 and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for places in by_sequence.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024
    for d, x in ids.items():
        own = sorted((r["piece"], r["length"]) for r in rows if r["doc_id"] == d)
        assert [n for _, n in own[1:]] == [1024] * (len(own) - 1) and len(own) == -(-len(x) // 1024)
    assert len(by_sequence) <= -(-sum(map(len, ids.values())) // 1024) * 1.02 + 1


# --- 9 ---

def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200)]
    found = {r["key"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({found[i] for i in range(41)}) == 1 and len({found[i] for i in range(100, 130)}) == 1
    assert len(set(found.values())) == 3


def test_join_equals_brute_force(spark, monkeypatch):
    """Copies, chains of near copies, shared passages, short texts; pairs of tokens are indexed too."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randint(0, 9))
    base = [[word() for _ in range(n)] for n in (4, 12, 14, 16, 20, 40, 80, 200, 400)]
    shared = [word() for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(14):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 40))):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c).upper() if rng.random() < 0.2 else " ".join(c))
            if rng.random() < 0.3:
                texts.append("  ".join(c))
    texts += [" ".join(shared + [word() for _ in range(rng.randint(0, 3))]) for _ in range(40)]
    texts += ["", None, "a", "a b", "A b", "b a"]
    found = {r["doc_id"]: r["component_id"] for r in
             jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert found == brute_components(dict(enumerate(texts)))


def test_sift_in_ranges_of_tokens(spark, monkeypatch):
    """The ranges sift as one pass would, each holds its share of the tokens, and few texts move."""
    rng = random.Random(9)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(120)]
    base = [text() for _ in range(12)]
    docs = frame(spark, [" ".join(b[:-1] + [f"z{i}"]) for i in range(2) for b in base] + [" ".join(text()) for _ in range(60)])
    nodes = jaccard_join._nodes(docs, 90, 3)
    chosen = {}
    for passes in (1, jaccard_join.PASSES):
        monkeypatch.setattr(jaccard_join, "PASSES", passes)
        chosen[passes] = sorted(map(tuple, jaccard_join._sifted(nodes).select("key", "doc_id").collect()))
    assert passes > 1 and chosen[1] == chosen[passes] and {d for _, d in chosen[1]} == set(range(24))
    plans = staged_plans(spark, monkeypatch, jaccard_join)
    jaccard_join.jaccard_components(docs).collect()
    assert len(plans["sifted"]) == passes and "might_contain" in plans["candidates"][0]


# --- 3, 8, 2 ---

def test_chain_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    lengths = np.array([1, 4, 3])
    starts = np.cumsum(lengths) - lengths
    scores, steps = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    marginals, joint = crf.chains(scores, starts, lengths, steps, pairs=True)
    expected, pairs = np.zeros((8, 3)), np.zeros((3, 3))
    for s, n in zip(starts, lengths):
        paths = list(itertools.product(range(3), repeat=int(n)))
        p = np.exp([sum(scores[s + i, y] for i, y in enumerate(path))
                    + sum(steps[a, b] for a, b in zip(path, path[1:])) for path in paths])
        for path, q in zip(paths, p / p.sum()):
            for i, y in enumerate(path):
                expected[s + i, y] += q
            for a, b in zip(path, path[1:]):
                pairs[a, b] += q
    assert np.allclose(marginals, expected) and np.allclose(joint, pairs)


def test_language_held_out_and_switched(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.language_query(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    english, german = (next(r["text"] for r in docs.where(F.col("lang") == k).collect() if len(r["text"]) > 900)
                       for k in ("en", "de"))
    model = language_id.fit(docs)
    r = language_id.identify(frame(spark, [english[:600] + "\n" + german[:600]]), model).first()
    assert r["lang_pred"] in ("en", "de") and 0.25 < r["second_share"] <= 0.5


def test_toxic_spans(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(240):
        words = [word() for _ in range(25)]
        if i % 4 == 0:
            words[rng.randrange(25)] = words[rng.randrange(25)] = "vilest"
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"))
    texts = ["abcd Vilest efgh VILEST abce", "abcd efgh", "", None]
    found = {r["doc_id"]: r for r in toxicity.score(frame(spark, texts), model).collect()}
    assert [(s["begin"], s["end"]) for s in found[0]["spans"]] == [(5, 11), (17, 23)]
    assert found[0]["score"] > 0.7 and all(found[i]["score"] < 0.3 for i in (1, 2, 3))


def _labelled(spark, toxic, clean):
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + clean)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_copies_hide_no_toxic_word(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))
    toxic = [text() + " vilest" for _ in range(8)] + [text() for _ in range(30)]
    clean = [text() for _ in range(300)]
    words = {r["word"]: r["p"] for r in toxicity.toxic_words(_labelled(spark, toxic, clean)).collect()}
    copied = toxic + [toxic[-1]] * 1_500
    assert set(words) == {"vilest"}
    assert {r["word"]: r["p"] for r in toxicity.toxic_words(_labelled(spark, copied, clean)).collect()} == words
    assert toxicity.fit(_labelled(spark, copied, clean)) is not None


def staged_plans(spark, monkeypatch, module):
    """Plans of the tables that ``module`` writes from now on, by label, as they are written."""
    plans, stage = {}, module.stage_table

    def noted(df, label, **how):
        with session.settings(spark, session.KEYS_FIRST if how.get("keys_first") else {}):
            plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label, **how)
    monkeypatch.setattr(module, "stage_table", noted)
    return plans


def test_only_texts_that_count_are_shuffled(spark, sf_dir, monkeypatch):
    """Texts without a label, and at the second join those without copies, stay where they are."""
    plans = staged_plans(spark, monkeypatch, toxicity)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = toxicity.toxicity_query(spark, sf_dir)
    assert rows.count() == docs.count()
    for label in ("labelled", "beyond"):
        assert "might_contain" in plans[label][0].split("FileScan")[0] and "Broadcast" not in plans[label][0]


def test_unlike_documents_never_merge(spark):
    """Two words that every min-hash of one function picks do not make texts copies."""
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    low = (spark.range(20_000).select(F.concat(F.lit("x"), F.translate("id", "0123456789", "abcdefghij")).alias("a"))
           .select("a", F.xxhash64("a", F.lit("y")).alias("h")).orderBy("h").first()["a"])
    toxic = [f"{text()} {low} y {text()} vilest" for _ in range(12)]
    clean = [f"{text()} {low} y {text()}" for _ in range(200)]
    assert {r["word"] for r in toxicity.toxic_words(_labelled(spark, toxic, clean)).collect()} == {"vilest"}
    near = [f"{toxic[0]} {w}" for w in ("eins", "zwei", "drei")]
    assert {r["word"]: r["p"] for r in toxicity.toxic_words(_labelled(spark, toxic + near, clean)).collect()} == {
        "vilest": 12.5 / 13}


def test_words_are_the_same_on_both_sides(spark):
    texts = ["un imbe\u0301cile, a\u0300 vous", "\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e", "x\u00b2 \u2167 3rd a_b \u00bd don't"]
    jvm = [r["w"] for r in frame(spark, texts).orderBy("doc_id").select(toxicity._words(F.col("text")).alias("w")).collect()]
    assert jvm == [toxicity.WORDS.findall(t.lower()) for t in texts]
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(25))
    toxic = [f"{text()} imbe\u0301cile {text()}" for _ in range(60)]
    model = toxicity.fit(_labelled(spark, toxic, [text() for _ in range(180)]))
    found = toxicity.score(frame(spark, ["abcd imbe\u0301cile efgh"]), model).first()
    assert [(s["begin"], s["end"]) for s in found["spans"]] == [(5, 14)] and found["score"] > 0.5


def test_quality_held_out(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in quality_qda.quality_query(spark, sf_dir).collect() if r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    d = 3
    means, factors = rng.normal(size=(2, d)), np.stack([np.linalg.cholesky(a @ a.T + np.eye(d)) for a in rng.normal(size=(2, d, d))])
    model = quality_qda.Discriminant(means, factors, np.array([-np.log(np.diag(f)).sum() for f in factors]))
    x = rng.normal(size=(5, d))

    def log_density(k):
        c = factors[k] @ factors[k].T
        z = x - means[k]
        return -0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(c), z) - 0.5 * np.log(np.linalg.det(c))

    assert np.allclose(model.log_odds(x), log_density(1) - log_density(0))


def test_digests(spark):
    r = bpe.encode_digests(frame(spark, ["héllo"]), bpe.vocabulary_path()).first()
    assert r["decoded_sha256"] == hashlib.sha256("héllo".encode()).hexdigest() and r["n_tokens"] > 0
