"""Queries of the upload manifest where pages are long, against their oracle SQL."""

import duckdb
import pytest
from compare import difference, duck

from tallymark.workloads import registry


@pytest.fixture(scope="module")
def long_pages(tmp_path_factory):
    """One page in seven has 150,000 characters, 3 GB as a file of the manifest."""
    folder = tmp_path_factory.mktemp("long")
    duckdb.sql(f"""COPY (
        SELECT i AS page_id, concat('http://a.example/', CAST(i AS VARCHAR)) AS url,
          repeat('x', CASE WHEN i % 7 = 3 THEN 150000 ELSE 10 + CAST(i AS INT) END) AS html
        FROM range(200) t(i)) TO '{folder}/pages.parquet' (FORMAT PARQUET)""")
    return str(folder)


@pytest.mark.parametrize("name", ["quota_usage", "storage_usage", "upload_manifest", "upload_validation"])
def test_sizes_beyond_an_int(name, spark, long_pages):
    assert difference(registry.QUERIES[name](spark, long_pages), duck(long_pages), registry.ORACLE[name]) is None


def test_page_numbers_beyond_an_int(spark, tmp_path):
    duckdb.sql(f"""COPY (
        SELECT i * 100000000 AS page_id, 'http://a.example/' AS url, 'text' AS html FROM range(40) t(i))
        TO '{tmp_path}/pages.parquet' (FORMAT PARQUET)""")
    name = "upload_manifest"
    assert difference(registry.QUERIES[name](spark, str(tmp_path)), duck(str(tmp_path)), registry.ORACLE[name]) is None
