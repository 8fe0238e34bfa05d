"""How many row groups a filter has to read, by the statistics in the files."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallymark.sources import layout, writers
from tallymark.workloads import views as V

COLUMNS = ("visit_day", "visit_status", "payer")


def groups_read(path, column, low, high):
    """(row groups whose statistics overlap the range, all row groups)."""
    read = total = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(column)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            total += 1
            read += not stats.has_min_max or (stats.max >= low and stats.min <= high)
    return read, total


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("layout"))
    df = V.encounters(spark, sf_dir.replace("sf0.001", "sf0.01")).select(
        "visit_id", F.datediff("visit_date", F.lit("1990-01-01")).alias("visit_day"), "visit_status",
        (F.col("visit_id") % 97).alias("payer"), "charge", "code_description")
    plain = df.repartition(8)
    writers.write_parquet(plain, f"{root}/plain", row_group_bytes=16 << 10)
    layout.write_clustered(df, f"{root}/curve", COLUMNS, files=8, row_group_bytes=16 << 10)
    return root, df


def test_rows_are_the_same(spark, tables):
    root, df = tables
    back = spark.read.parquet(f"{root}/curve")
    assert back.columns == df.columns and back.count() == df.count()
    assert back.exceptAll(df).isEmpty()


@pytest.mark.parametrize("column, low, high", [("visit_day", 2600, 2630), ("payer", 11, 12), ("visit_status", "Alert", "Alert")])
def test_filters_on_any_column_read_few_row_groups(tables, column, low, high):
    root, _ = tables
    before, after = groups_read(f"{root}/plain", column, low, high), groups_read(f"{root}/curve", column, low, high)
    assert before[1] >= 16 and before[0] > 0.9 * before[1]
    assert after[0] <= 0.7 * after[1], (before, after)


def test_edges(spark, tmp_path):
    df = spark.sql("SELECT IF(id = 0, NULL, id) AS n, CAST(NULL AS STRING) AS t, DATE'2001-01-01' + CAST(id % 3 AS INT) AS d, "
                   "IF(id % 2 = 0, DOUBLE('NaN'), 1.5) AS x, id > 4 AS b, TIMESTAMP_NTZ'2001-01-01' AS at FROM range(9)")
    layout.write_clustered(df, str(tmp_path / "t"), df.columns)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 9
    layout.write_clustered(df.limit(0), str(tmp_path / "none"), ["n", "t"])
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        layout.write_clustered(df, str(tmp_path / "bad"), [])
