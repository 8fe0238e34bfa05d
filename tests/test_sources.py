"""Ingest, registration, sinks and logs on files."""

import datetime as dt
import os

import pytest

from tallymark.session import scratch_path
from tallymark.sources import catalog, readers, uploads, writers


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)
    return os.path.join(folder, name)


def test_csv_types_headers_and_missing_values(spark, tmp_path):
    path = put(str(tmp_path), "a.csv", 'Visit ID,Amount ($),When,Note,Note,Flag,Code\n'
               '1,2.5,2024-01-02,"say ""hi""",x,True,1d\n2,NA,2024-02-03,"a, b",,false,2\n')
    got = readers.ingest_csv(spark, path, str(tmp_path / "out"))
    assert got["row_count"] == 2
    df = spark.read.parquet(got["parquet_path"]).orderBy("Visit_ID")
    assert dict(df.dtypes) == {"Visit_ID": "bigint", "Amount": "double", "When": "timestamp_ntz",
                               "Note": "string", "Note_1": "string", "Flag": "boolean", "Code": "string"}
    assert [tuple(r) for r in df.collect()] == [
        (1, 2.5, dt.datetime(2024, 1, 2), 'say "hi"', "x", True, "1d"),
        (2, None, dt.datetime(2024, 2, 3), "a, b", None, False, "2")]


def test_tsv_and_quoted_line_breaks(spark, tmp_path):
    tabs = put(str(tmp_path), "t.tsv", "a\tb\n1\tx\n")
    assert readers.read_delimited(spark, tabs).collect()[0].asDict() == {"a": 1, "b": "x"}
    broken = put(str(tmp_path), "m.csv", 'a,b\n1,"two\nlines"\n2,"one"\n')
    assert [r["b"] for r in readers.read_delimited(spark, broken, multi_line=True).collect()] == ["two\nlines", "one"]


def test_sheets_skip_empty_and_count_written_rows(spark, tmp_path):
    folder = str(tmp_path / "book")
    put(folder, "Visits 2024.csv", "ID,(Amt)\n1,2\n,\n3,4\n")
    put(folder, "Empty.csv", "a,b\n")
    got = readers.ingest_sheets(spark, folder, str(tmp_path / "out"))
    assert [(s["table_name"], s["row_count"], s["column_count"]) for s in got] == [("visits_2024", 2, 2)]
    assert spark.read.parquet(got[0]["parquet_path"]).dtypes == [("id", "tinyint"), ("amt", "tinyint")]


def test_register_files_and_folder(spark, tmp_path):
    for name in ("abc_sales", "9lives"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert readers.register_parquet(spark, str(tmp_path / "abc_sales.parquet")) == "sales"
    assert readers.register_parquet(spark, str(tmp_path / "9lives.parquet")) == "t_9lives"
    assert spark.table("sales").count() == 3
    assert readers.copy_parquet(spark, str(tmp_path / "9lives.parquet"), str(tmp_path / "copy"))["row_count"] == 3


def test_register_folder_of_files(spark, sf_dir):
    views = readers.register_folder(spark, sf_dir, "*.parquet", named=True)
    assert "lineitem" in views and len(views) == 14


def test_a_folder_of_part_files_is_one_table(spark, tmp_path):
    """Tables of one file, of many part files and of partitions are one view each."""
    rows = spark.range(0, 100, 1, 5)
    for name in ("visits.parquet", "more/claims.parquet"):
        rows.write.parquet(str(tmp_path / name))
    rows.selectExpr("id", "id % 3 AS part").write.partitionBy("part").parquet(str(tmp_path / "paid.parquet"))
    single = next((tmp_path / "visits.parquet").glob("part-*.parquet"))
    (tmp_path / "codes.parquet").write_bytes(single.read_bytes())
    views = readers.register_folder(spark, str(tmp_path), named=True)
    assert sorted(views) == ["claims", "codes", "paid", "visits"]
    counts = {v: spark.table(v).count() for v in views}
    assert counts == {"claims": 100, "codes": 20, "paid": 100, "visits": 100}


def test_jdbc_options_are_read_only_and_partitioned():
    options = readers.jdbc_options("jdbc:mysql://db/billing", "SELECT * FROM payment;", user="u",
                                   partition_column="id", lower=1, upper=100, partitions=8)
    assert options["dbtable"] == "(SELECT * FROM payment) q" and options["numPartitions"] == "8"
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "DELETE FROM payment")
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "SELECT 1", partition_column="id")


def test_provenance_skips_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(3):
        writers.log_query(spark, path, "c", "u", f"q{i}", "SELECT 1", i != 1, i, 0.5,
                          timestamp=dt.datetime(2024, 1, 1, 0, i))
    put(path, "part-bad.json", '{"timestamp": "2024-01-09T00:00:00", broken\n'
                               '{"timestamp": "2024-01-08T00:00:00", "question": "plain"}\n')
    got = writers.recent_queries(writers.read_provenance(spark, path), 3).collect()
    assert [r["question"] for r in got] == ["plain", "q2", "q1"]


def test_parquet_sink_stores_nested_values_as_text(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, map('a', 1) AS m, named_struct('x', 1) AS s, CAST(NULL AS STRING) AS t")
    writers.write_parquet(df, str(tmp_path / "o"), max_records_per_file=10)
    got = spark.read.parquet(str(tmp_path / "o")).first()
    assert tuple(got) == (1, '{"a":1}', '{"x":1}', None)


def test_catalog_views(spark):
    df = spark.range(4).selectExpr("id AS b", "id * 2 AS a")
    assert [tuple(r) for r in catalog.table_info(df, "t", ["b"], 2).collect()] == [
        ("t", 4, 2, 0, 0), ("t", 4, 2, 1, 2)]
    assert [r["column_name"] for r in catalog.table_schema(df, "t").orderBy("position").collect()] == ["b", "a"]


def test_storage_usage(spark, tmp_path):
    put(str(tmp_path / "chat1" / "raw"), "a.csv", "12345")
    put(str(tmp_path / "chat1"), "b.csv", "1")
    put(str(tmp_path / "chat2"), "c.csv", "123")
    got = {r["chat_id"]: (r["file_count"], r["total_bytes"])
           for r in catalog.storage_usage(spark, str(tmp_path)).collect()}
    assert got == {"chat1": (2, 6), "chat2": (1, 3)}


def test_manifest_append(spark, tmp_path):
    df = spark.createDataFrame([("f1", 1, 10)], "file_id string, chat_id int, size_bytes int")
    writers.append_manifest(df, str(tmp_path / "m"))
    writers.append_manifest(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_scratch_paths_are_new_and_shared(spark):
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]


def test_upload_becomes_tables_profiles_and_a_manifest_row(spark, tmp_path):
    work = str(tmp_path / "work")
    csv = put(str(tmp_path), "May visits.csv", "Visit ID,Charge\n1,2.5\n2,3.5\n")
    got = uploads.process_upload(spark, csv, work, "chat1", "u1")
    assert [t["table_name"] for t in got["tables"]] == ["May_visits"] and got["total_rows"] == 2
    assert spark.sql("SELECT sum(Charge) FROM May_visits").first()[0] == 6.0
    put(str(tmp_path / "book"), "Sheet 1.csv", "a\n1\n")
    uploads.process_upload(spark, str(tmp_path / "book"), work, "chat1", "u1", original_name="book.xlsx")
    assert spark.table("sheet_1").count() == 1
    manifest = uploads.read_manifest(spark, work).orderBy("uploaded_at").collect()
    assert [(r["sanitized_name"], r["extension"], list(r["tables"])) for r in manifest] == [
        ("May_visits.csv", ".csv", ["May_visits"]), ("book.xlsx", ".xlsx", ["sheet_1"])]
    profiles = spark.read.json(f"{work}/chat1/profiles")
    assert {r["column_name"] for r in profiles.collect()} == {"Visit_ID", "Charge", "a"}
    with pytest.raises(ValueError, match="Unsupported file format"):
        uploads.process_upload(spark, csv, work, "chat1", "u1", original_name="x.doc")
    empty = put(str(tmp_path), "none.csv", "")
    with pytest.raises(ValueError, match="File is empty"):
        uploads.process_upload(spark, empty, work, "chat1", "u1")


def test_files_are_matched_by_their_own_headers(spark, tmp_path):
    """Two column orders, a new column, an empty file, a short and a long row."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,x\n2,y\n")
    (folder / "2.csv").write_text("b,a\nz,3\n")
    (folder / "3.csv").write_text("a,c,b\n4,new,w\n5\n6,7,8,9\n")
    (folder / "4.csv").write_text("")
    df = readers.read_delimited(spark, str(folder))
    assert df.columns == ["a", "b", "c"] and dict(df.dtypes)["a"] == "bigint"
    assert [tuple(r) for r in df.orderBy("a").collect()] == [
        (1, "x", None), (2, "y", None), (3, "z", None), (4, "w", "new"), (5, None, None), (6, "8", "7")]
    aside = str(tmp_path / "aside")
    kept = readers.read_delimited(spark, str(folder), rescued=aside)
    assert [r["a"] for r in kept.orderBy("a").collect()] == [1, 2, 3, 4]
    assert sorted(r["line"] for r in spark.read.parquet(aside).collect()) == ["5", "6,7,8,9"]
