"""SQL policy, audits, uploads, intents and chat history."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions import sqltext as Q
from tallymark.functions import text as T
from tallymark.operators import governance as G
from tallymark.operators import history as H

POLICY = Q.Policy(max_rows=1000, max_joins=3, pii=Q.PII_COLUMNS)

STATEMENTS = [
    ("SELECT claim_no, balance FROM claims", None, "SELECT claim_no, balance FROM claims LIMIT 1000", "claims"),
    ("SELECT claim_no FROM claims LIMIT 5000", None, "SELECT claim_no FROM claims LIMIT 1000", "claims"),
    ("SELECT name FROM staff WHERE ssn IS NOT NULL",
     "Query references PII column 'ssn' which is not allowed", None, "staff"),
    ("UPDATE claims SET balance = 0",
     "Operation 'UPDATE' not allowed. Only SELECT operations are permitted.", None, ""),
    ("SELECT c.claim_no, p.amount FROM claims c CROSS JOIN payments p",
     "CROSS JOIN is not allowed (potential cartesian product)", None, "claims"),
    ("SELECT claim_no FROM claims WHERE balance > 10 LIMIT 25", None,
     "SELECT claim_no FROM claims WHERE balance > 10 LIMIT 25", "claims"),
    ("SELECT * FROM a LEFT JOIN b ON a.i = b.i LEFT JOIN c ON a.i = c.i",
     "Too many JOINs (4). Maximum allowed: 3", None, "a"),
    ("SELECT * FROM a LEFT JOIN b ON a.i = b.i JOIN c ON a.i = c.i", None,
     "SELECT * FROM a LEFT JOIN b ON a.i = b.i JOIN c ON a.i = c.i LIMIT 1000", "a"),
    ("SELECT limit_x FROM db.t1 x, `t2`;", None, "SELECT limit_x FROM db.t1 x, `t2`;", "t1,t2"),
    ("  ", "Empty SQL query", None, ""),
    ("-- note\nSELECT 1; DROP TABLE x", "Forbidden keyword 'DROP' detected", None, ""),
    ("SELECT updated FROM t", None, "SELECT updated FROM t LIMIT 1000", "t"),
]


def test_audit(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(STATEMENTS)], "id int, q string")
    got = {r["id"]: r for r in G.audit_sql_log(df, "q", POLICY).collect()}
    for i, (sql, error, sanitized, tables) in enumerate(STATEMENTS):
        assert (got[i]["error"], got[i]["sanitized_sql"], got[i]["tables"]) == (error, sanitized, tables), sql
        assert got[i]["valid"] == (error is None)


def test_unlimited_policy_removes_limits(spark):
    df = spark.createDataFrame([("SELECT * FROM t LIMIT 5",)], "q string")
    got = df.select(Q.capped_sql(F.col("q"), Q.UNLIMITED_ROWS)).first()[0]
    assert got == "SELECT * FROM t"


@pytest.mark.parametrize("sql, message", [
    ("", "Empty"), ("DROP TABLE t", "Operation 'DROP'"), ("SELECT 1; DELETE FROM t", "DELETE"),
    ("SELECT * FROM a CROSS JOIN b", "CROSS JOIN"), ("SELECT ssn FROM t", "ssn"),
    ("SELECT 1 FROM a JOIN b JOIN c JOIN d JOIN e", "Too many JOINs (4)")])
def test_guard_refuses(sql, message):
    with pytest.raises(G.QueryRefused, match=message.replace("(", r"\(").replace(")", r"\)")):
        G.check_sql(sql, POLICY)


def test_guard_runs_and_caps(spark):
    spark.range(50).createOrReplaceTempView("numbers")
    assert G.guarded_sql(spark, "SELECT id FROM numbers", Q.Policy(max_rows=7)).count() == 7
    assert G.guarded_sql(spark, "SELECT id FROM numbers LIMIT 3", Q.FILE_POLICY).count() == 50
    assert G.guarded_sql(spark, "SELECT 'drop table, ssn' AS note").first()[0] == "drop table, ssn"
    result = G.run_guarded_sql(spark, "SELECT id FROM numbers", Q.Policy(max_rows=2))
    assert (result["success"], result["row_count"], result["column_names"]) == (True, 2, ["id"])
    assert G.run_guarded_sql(spark, "DROP TABLE numbers")["success"] is False


def test_guard_sees_personal_columns_behind_a_star(spark):
    spark.sql("SELECT 1 AS id, 2 AS SSN").createOrReplaceTempView("people")
    with pytest.raises(G.QueryRefused):
        G.guarded_sql(spark, "SELECT * FROM people")
    assert G.guard_columns(spark.table("people"), mode="drop").columns == ["id"]


@pytest.mark.parametrize("sql", [
    'SELECT "--", ssn AS x FROM people', "SELECT '\\'' AS a, ssn AS x, '\\'' AS b FROM people",
    "SELECT x FROM (SELECT `SSN` AS x FROM people)", "SELECT id FROM people WHERE (SELECT max(ssn) FROM people) > id",
    "WITH", "SELECT id FROM people p ORDER BY substr(p.ssn, 1, 2)"])
def test_guard_finds_personal_columns_behind_other_names(spark, sql):
    spark.sql("SELECT 1 AS id, '2' AS SSN").createOrReplaceTempView("people")
    with pytest.raises(G.QueryRefused):
        G.guarded_sql(spark, sql)


@pytest.mark.parametrize("sql", [
    "SELECT a.id FROM pairs a, pairs b", "SELECT a.id FROM pairs a JOIN pairs b ON 1 = 1",
    'SELECT "--", a.id FROM pairs a CROSS JOIN pairs b', "SELECT a.id FROM pairs a JOIN pairs b ON a.id < b.id",
    "SELECT 1 FROM pairs a, pairs b, pairs c, pairs d, pairs e WHERE a.id = b.id AND b.id = c.id AND c.id = d.id AND d.id = e.id"])
def test_guard_refuses_products_and_many_joins(spark, sql):
    spark.range(9).createOrReplaceTempView("pairs")
    with pytest.raises(G.QueryRefused):
        G.guarded_sql(spark, sql, POLICY)


def test_guard_runs_what_only_looks_forbidden(spark):
    spark.range(9).createOrReplaceTempView("pairs")
    assert G.guarded_sql(spark, 'SELECT "drop" AS w').first()["w"] == "drop"
    assert G.guarded_sql(spark, "SELECT a.id FROM pairs a, pairs b WHERE a.id = b.id").count() == 9
    assert G.guarded_sql(spark, "SELECT id FROM pairs WHERE id IN (SELECT id FROM pairs WHERE id > 3)").count() == 5


NESTED = ("SELECT named_struct('SSN', '1', 'n', 2) AS person, 5 AS id, "
          "array(named_struct('password', 'x', 'phone', '7')) AS logins, array(named_struct('ssn', 1)) AS gone, "
          "map('ssn', 1, 'age', 40) AS facts, named_struct('inner', named_struct('credit_card', 1, 'ok', 3)) AS deep")


@pytest.fixture
def nested(spark, tmp_path):
    """The same rows as a one-row view and as a Parquet view."""
    spark.sql(NESTED).write.parquet(str(tmp_path / "p"))
    spark.read.parquet(str(tmp_path / "p")).createOrReplaceTempView("stored_people")
    spark.sql(NESTED).createOrReplaceTempView("row_people")


@pytest.mark.parametrize("table", ["stored_people", "row_people"])
@pytest.mark.parametrize("item", [
    "person.`ssn`", "person.SSN", "person", "logins[0].`password`", "facts", "deep.inner", "deep", "`gone`",
    "transform(logins, l -> l.`password`)", "map_from_entries(array(struct(1, person)))"])
def test_personal_fields_are_out_of_reach(spark, nested, table, item):
    sql = f"SELECT {item} AS x FROM {table}"
    try:
        shown = [str(v) for r in G.guarded_sql(spark, sql).collect() for v in r]
    except G.QueryRefused:
        return
    assert item == "facts" and shown == ["{'age': 40}"]


@pytest.mark.parametrize("table", ["stored_people", "row_people"])
def test_masked_results_keep_the_rest(spark, nested, table):
    row = G.guarded_sql(spark, f"SELECT * FROM {table}", mode="mask").first().asDict(recursive=True)
    assert row == {"person": {"n": 2}, "id": 5, "logins": [{"phone": "7"}], "facts": {"age": 40},
                   "deep": {"inner": {"ok": 3}}}
    assert G.guarded_sql(spark, f"SELECT to_json(person) AS j FROM {table}").first()["j"] == '{"n":2}'
    assert G.guarded_sql(spark, f"SELECT person.n + id AS s FROM {table}").first()["s"] == 7


def test_null_structs_stay_null(spark):
    df = spark.sql("SELECT IF(id = 0, NULL, named_struct('ssn', id, 'n', id)) AS s FROM range(2)")
    assert [r["s"] and r["s"].asDict() for r in G.masked(df).orderBy("s.n").collect()] == [None, {"n": 1}]


@pytest.mark.parametrize("sql", [
    "SELECT t.k FROM t JOIN u ON t.k = u.k WHERE t.k = 5",
    "SELECT a.k FROM (SELECT * FROM t) a JOIN (SELECT * FROM u) b ON a.k = b.k AND b.k = 5",
    "SELECT t.k FROM t, u WHERE u.k = t.k AND u.k = 5", "SELECT t.k FROM t LEFT JOIN u ON t.k = u.k AND u.k = 5",
    "SELECT k FROM t WHERE k NOT IN (SELECT k + 1 FROM u)"])
@pytest.mark.parametrize("stored", [False, True])
def test_joins_that_equate_something_run(spark, tmp_path, sql, stored):
    for name in ("t", "u"):
        df = spark.sql("SELECT 5 AS k")
        if stored:
            df.write.parquet(str(tmp_path / name))
            df = spark.read.parquet(str(tmp_path / name))
        df.createOrReplaceTempView(name)
    assert G.guarded_sql(spark, sql, POLICY).collect()[0][0] == 5


def test_only_given_tables_are_read(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "f"))
    spark.range(3).createOrReplaceGlobalTempView("everywhere")
    for source in (f"parquet.`{tmp_path}/f`", "global_temp.everywhere"):
        with pytest.raises(Exception):
            G.guarded_sql(spark, f"SELECT id FROM {source}").collect()
    with pytest.raises(Exception):
        G.guarded_sql(spark, "SELECT id FROM numbers", tables={"others": spark.range(1)}).collect()
    assert G.guarded_sql(spark, "SELECT id FROM mine", tables={"mine": spark.range(4)}).count() == 4


def test_error_triage(spark):
    errors = ["must appear in the group by", "unknown COLUMN x", "timeout", None, ""]
    df = spark.createDataFrame([(e,) for e in errors], "error string")
    got = {r["error_class"]: (r["query_count"], r["retryable"]) for r in G.error_triage(df, "error").collect()}
    assert got == {"GROUP BY": (1, True), "UNKNOWN COLUMN": (1, True), "none": (1, False)}
    files = {r["error_class"] for r in G.error_triage(df, "error", Q.FILE_RETRY_WORDS).collect()}
    assert files == {"GROUP BY", "none"}


@pytest.mark.parametrize("raw, want", [
    ("My  Report (v2).XLSX", "My_Report_v2.xlsx"), ("a/b/c.tar.gz", "c.tar.gz"), (".bashrc", "bashrc"),
    ("???.csv", "upload.csv"), ("x" * 120 + ".csv", "x" * 100 + ".csv"), ("no_suffix", "no_suffix"),
    ("rést umé.csv", "rést_umé.csv"), ("dir/", "dir"), ("a.", "a")])
def test_file_names(spark, raw, want):
    assert spark.range(1).select(T.sanitize_filename(F.lit(raw))).first()[0] == want


@pytest.mark.parametrize("name, want", [
    ("Sheet 1", None), (" ", "Sheet has empty name"), ("Select", "Sheet name 'Select' is a SQL keyword"),
    ("a/b", "Sheet name 'a/b' contains invalid characters")])
def test_sheet_names(spark, name, want):
    assert spark.range(1).select(T.sheet_name_error(F.lit(name))).first()[0] == want


def test_upload_verdicts_follow_order_and_quota(spark):
    mb = G.MEGABYTE
    files = [("a.csv", 0, "empty"), ("b.csv", 201 * mb, "too_large"), ("c.exe", 1, "unsupported_format"),
             ("d.doc", 1, "unsupported_format"), ("e.csv", 200 * mb, "accepted"),
             ("f.csv", 200 * mb, "accepted"), ("g.csv", 150 * mb, "quota_exceeded"),
             ("h.CSV", 1, "quota_exceeded"), ("i.csv", 1, "quota_exceeded"), ("j.csv", 1, "too_many_files")]
    rows = [(i, 1, 1, n, s, v) for i, (n, s, v) in enumerate(files)]
    df = spark.createDataFrame(rows, "seq int, chat_id int, user_id int, original_name string, "
                                     "size_bytes long, want string")
    got = G.validate_uploads(df, F.floor(F.col("seq") / 3), ("seq",)).collect()
    assert len(got) == len(files) and all(r["verdict"] == r["want"] for r in got)


def test_quota_usage(spark):
    df = spark.createDataFrame([(1, 9, 300 * G.MEGABYTE)] * 6, "chat_id int, user_id int, size_bytes long")
    got = {r["scope"]: (r["used"], r["remaining"], r["used_pct"]) for r in G.quota_usage(df).collect()}
    assert got == {"chat": (6, 0, 120.0), "user": (1800 * G.MEGABYTE, 0, 360.0)}


@pytest.mark.parametrize("question, report, company", [
    ("Weekly report for acme, please", True, "Acme"), ("/weeklyreport --north shore", True, "North Shore"),
    ("charges for", False, "Company"), ("company beta and client o'neil!", False, "O'Neil"),
    ("performance REPORT for a company", True, "A"), ("platform issues", False, "Company")])
def test_intents(spark, question, report, company):
    df = spark.createDataFrame([(question,)], "q string")
    got = H.classify_intents(df, "q").first()
    assert (got["is_weekly_report"], got["company_name"]) == (report, company)


def test_fences_are_removed(spark):
    assert spark.range(1).select(T.without_fence(F.lit("```sql\nSELECT 1\n```"))).first()[0].strip() == "SELECT 1"


def test_history_keeps_the_last_messages_of_a_hot_conversation(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(300)] + [(1, 300, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = H.chat_history(df, 3).first()
    assert got["history"] == "User: m297\nAssistant: m298\nUser: m299" and got["message_count"] == 3


def test_json_rows(spark):
    df = spark.sql("SELECT 1 AS a, double('NaN') AS b, timestamp_ntz'2024-01-02 03:04:05' AS t, array(1, 2) AS l")
    assert G.json_rows(df).first()[0] == '{"a":1,"b":null,"t":"2024-01-02T03:04:05","l":[1,2]}'
