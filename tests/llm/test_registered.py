"""Every numbered query: its oracle, edge rows, and empty tables."""

import pytest
from compare import difference, duck

import corpus_pipeline
from tallymark.llm import jaccard_join, queries

# Queries over documents; the others have edge tables of their own in test_edges_and_damage.py.
OTHERS = ("op11_warc_salvage", "op12_vector_codes", "op13_prefix_trie")
NAMES = sorted(set(queries.QUERIES) - set(OTHERS))


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(name, spark, sf_dir, con):
    assert difference(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLE[name]) is None


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(name, spark, edge_dir, edge):
    rows = queries.QUERIES[name](spark, edge_dir).collect()
    ids = {r["doc_id"] for r in rows}
    assert ids == {r["doc_id"] for r in edge.collect()}
    if name != "op6_packing":
        assert len(rows) == edge.count()
    twins = [tuple(v for k, v in r.asDict().items() if k not in ("slot", "shard", "sequence_id", "offset"))
             for r in rows if r["doc_id"] == 1]
    assert len(set(twins)) == len(twins) // 2  # repeated rows have equal results


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, spark, empty_dir):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


def test_pipeline_edges(spark, edge_dir, empty_dir):
    for where in (edge_dir, empty_dir):
        docs = spark.read.parquet(f"{where}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, where)
            if name != "packing":
                assert docs.columns == columns
        left = {r["doc_id"] for r in docs.collect()}
        # Near copies of 0 (its repeats among them) go; the row without an id stays.
        assert left == ({0, None} if where == edge_dir else set())


def test_pipeline_equals_its_parts(spark, sf_dir):
    """Which documents are packed, from brute force over each stage's rule."""
    from reference_join import components

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in queries.QUERIES["op5_quality_rules"](spark, sf_dir).collect() if r["kept"]}
    # The stage's own rule: shingles of five words, similarity 0.8 or more.
    named = components({d: docs[d]["text"] for d in kept}, percent=80, words=5)
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert packed == {d for d in kept if named[d] == d}


def test_near_duplicate_stage_is_five_words_at_four_fifths(spark):
    """Pairs between the stage's rule and op9's, by sets of shingles in Python."""
    def alike(x, y, k):
        a, b = ({tuple(t.split()[i:i + k]) for i in range(len(t.split()) - k + 1)} for t in (x, y))
        return len(a & b) / len(a | b)

    base = [f"w{i}" for i in range(100)]
    near, far = base.copy(), base.copy()
    near[30] = near[70] = "other"  # ten shingles of five words differ
    far[20] = far[50] = far[80] = "other"
    texts = [" ".join(t) for t in (base, near, far)]
    assert alike(texts[0], texts[1], 5) >= 0.8 > alike(texts[0], texts[2], 5)
    assert alike(texts[0], texts[1], 3) < 0.9 and alike(texts[1], texts[2], 5) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == {0, 2}
    assert {r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == {0, 1, 2}
