from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from corpuslens.operators import reports as R
from corpuslens.operators import tables as TB
from corpuslens.registry import Rule


def test_head_and_columns(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS b", "id * 3 AS c")
    assert [r["id"] for r in TB.head_rows(df, ["id"], 3).collect()] == [0, 1, 2]
    assert "TakeOrderedAndProject" in TB.head_rows(df, ["id"], 3)._jdf.queryExecution().toString()
    assert TB.cap_columns(df, 2).columns == ["id", "b"]
    assert TB.cap_columns(df, 9).columns == df.columns


def test_stringify(spark):
    rows = [
        (1.0, 1e7, 1.5e-5, 12345678.25, None, b"abc", float("inf"), True, dt.date(2020, 1, 2), 7),
        (-0.5, 1e21, 0.0, 0.1, "x", None, float("nan"), None, None, None),
    ]
    schema = "a double, b double, c double, d double, e string, f binary, g double, h boolean, i date, j int"
    got = TB.stringify(spark.createDataFrame(rows, schema), "NULL").collect()
    assert tuple(got[0]) == (
        "1", "10000000", "0.000015", "12345678.25", "NULL", "<blob 3 bytes>", "inf", "true",
        "2020-01-02", "7",
    )
    assert tuple(got[1]) == (
        "-0.5", "1000000000000000000000", "0", "0.1", "x", "NULL", "NaN", "NULL", "NULL", "NULL",
    )


def test_tsv(spark):
    df = spark.createDataFrame([(2, None, 1.0), (1, "x", None)], "k int, s string, d double")
    lines = TB.tsv_lines(df, ["k"]).orderBy("part", "k").collect()
    assert [r["line"] for r in lines] == ["k\ts\td", "1\tx\t", "2\t\t1"]


def test_head_per_group(spark):
    df = spark.createDataFrame(
        [("a", i) for i in range(5)] + [("b", 1), (None, 1)], "g string, o int"
    )
    rows = TB.head_per_group(df, ["g"], ["o"], 2).orderBy(F.col("g").asc_nulls_last(), "o").collect()
    assert [(r["g"], r["row_no"], r["more_rows"], r["note"]) for r in rows] == [
        ("a", 1, 3, "… 3 more row(s)"),
        ("a", 2, 3, "… 3 more row(s)"),
        ("b", 1, 0, None),
        (None, 1, 0, None),
    ]
    plan = TB.head_per_group(df, ["g"], ["o"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_schema_report(spark):
    tables = {"t": spark.range(3), "u": spark.createDataFrame([("x", [1])], "a string, b array<int>")}
    rows = TB.schema_report(tables).orderBy("table_name", "ordinal").collect()
    assert [tuple(r) for r in rows] == [
        ("t", 1, "id", "bigint", 3), ("u", 1, "a", "string", 1), ("u", 2, "b", "array<int>", 1)
    ]


def test_catalog_preview(spark):
    spark.createDataFrame(
        [(1, "ada", "admin"), (2, "bob", None), (3, "cyd", "user")], "id int, name string, role string"
    ).createOrReplaceTempView("cat_users")
    spark.range(80).createOrReplaceTempView("cat_numbers")
    rows = TB.catalog_preview(spark, "cat_*", order={"cat_users": ["id"], "cat_numbers": ["id"]}).collect()
    users = sorted((r["row_no"], r["cells"]) for r in rows if r["table_name"] == "cat_users")
    assert users == [(1, ["1", "ada", "admin"]), (2, ["2", "bob", "NULL"]), (3, ["3", "cyd", "user"])]
    assert sum(r["table_name"] == "cat_numbers" for r in rows) == 50
    assert {r["columns"] for r in rows} == {"id, name, role", "id"}


def test_registry_report(spark):
    corpus = spark.createDataFrame([("markdown",), ("markdown",), ("mine",)], "kind string")
    rules = [Rule("mine", ("abc",)), Rule("code", ("zzz",))]
    rows = {r["kind"]: r for r in R.registry_report(corpus, rules).collect()}
    assert len(rows) == 20
    assert rows["markdown"]["n_files"] == 2 and rows["markdown"]["in_use"]
    assert rows["markdown"]["extensions"] == "md, markdown, mdown, mkd, mkdn"
    assert rows["mine"]["n_files"] == 1 and rows["mine"]["priority"] == 20
    assert rows["code"]["n_rules"] == 1 and not rows["code"]["in_use"]
