import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = " ".join(f"word{i} and thing{i * 7 % 31} of matter{i * 3}." for i in range(40))
LONG = "\n".join(f"line {i} holds some words of its own number{i * 13}" for i in range(4_000))

# Nulls in every column, empty and blank text, long text, ties and repeated rows.
EDGE_ROWS = [
    (0, PROSE, "en", "a", 1),
    (1, PROSE, "en", "a", 1),
    (1, PROSE, "en", "a", 1),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, " \t\n ", "en", "b", 3),
    (5, LONG, "en", "b", 1),
    (6, "one two", "en", "b", 1),
    (7, "ONE two", None, "b", 1),
    (8, "12 34 !!", "en", "b", 1),
    (9, "a" * 30_000, "en", "c", 1),
    (None, PROSE + " tail", "en", "c", 1),
    (10, "All rights\nreserved. General Public License K é ſ", "de", "c", 1),
    (11, PROSE.replace("word3 ", "other "), "de", "c", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, SCHEMA)


@pytest.fixture(scope="session")
def edge_dir(spark, edge, tmp_path_factory):
    """A folder with documents (and clashing extra columns) and labels."""
    out = str(tmp_path_factory.mktemp("edge"))
    extra = edge
    for name in ("score", "key", "n_words", "kept", "row", "label", "shard", "text_", "n", "piece"):
        extra = extra.withColumn(name, F.lit("x"))
    extra.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (0, 0, 1), (1, None, None), (None, 1, 0), (5, 0, 1), (6, 1, 0)],
                          "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out
