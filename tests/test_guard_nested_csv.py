"""SQL that specs may not run, nulls inside nested values, and CSV dialects."""

import csv
import random

import pytest

from tablelens.operators.cleaning import clean, row_groups
from tablelens.operators.column_stats import distinct_counts
from tablelens.plans import specs
from tablelens.plans.sql_guard import check_sql
from tablelens.sources.tables import TableLoadError, read_csv


@pytest.fixture(scope="module")
def view(spark):
    spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], 'id int, `from x` string, v double').createOrReplaceTempView("cleaned_data")
    spark.createDataFrame([(9,)], "id int").createOrReplaceTempView("other")


@pytest.mark.parametrize("sql", [
    "SELECT id FROM (SELECT id FROM other) t", "SELECT id FROM (SELECT * FROM parquet.`/x`) t", "SELECT id FROM cleaned_data UNION ALL TABLE other",
    "INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT * FROM cleaned_data", "CREATE TABLE never AS SELECT * FROM cleaned_data",
    "CREATE OR REPLACE TEMP VIEW never AS SELECT * FROM cleaned_data", "DROP VIEW other", "WITH t AS (SELECT * FROM other) SELECT id FROM t",
    "SELECT (SELECT max(id) FROM other) AS m FROM cleaned_data", "SELECT id FROM cleaned_data WHERE id IN (SELECT id FROM other)",
    "SELECT id FROM cleaned_data WHERE EXISTS (SELECT 1 FROM other)", "SELECT c.id FROM cleaned_data c JOIN other o ON c.id = o.id",
    "SELECT id FROM cleaned_data, other", "SELECT * FROM range(5)", "SELECT 1", "SELECT java_method('java.lang.Math', 'abs', 1) FROM cleaned_data",
    "SELECT percentile(v, 0.5) FROM cleaned_data", "SELECT id, median(v) FROM cleaned_data GROUP BY id HAVING median(v) > 1",
    "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY v) FROM cleaned_data", "SELECT id FROM default.cleaned_data", "SET x = 1",
])
def test_refused_and_never_executed(spark, view, sql):
    with pytest.raises(ValueError):
        specs.run_sql(spark, sql)
    assert not specs.bind_check(spark, [{"title": "t", "sql_query": sql}]).first().ok
    assert not spark.catalog.tableExists("never")
    assert spark.table("other").count() == 1


@pytest.mark.parametrize("sql", [
    'SELECT "from x", COUNT(*) AS n FROM cleaned_data GROUP BY "from x" ORDER BY n DESC LIMIT 5', "SELECT id FROM (SELECT id FROM cleaned_data) t",
    "SELECT DISTINCT id FROM cleaned_data WHERE v IS NOT NULL", "SELECT id, sum(v) AS s FROM cleaned_data GROUP BY id HAVING sum(v) > 1",
    "SELECT id, rank() OVER (ORDER BY id) AS r FROM cleaned_data", "SELECT 'INSERT INTO other' AS t FROM CLEANED_DATA -- from other",
])
def test_plain_queries_run(spark, view, sql):
    specs.run_sql(spark, sql).collect()
    check_sql(spark, specs.spark_sql_text(sql))


def test_planned_median_is_bounded(spark, view):
    out = specs.run_sql(spark, 'SELECT "from x", MEDIAN("v") AS result FROM cleaned_data GROUP BY "from x" ORDER BY result DESC LIMIT 10')
    assert [tuple(r) for r in out.collect()][0] == ("a", 2.0)


NESTED = "tags array<string>, s struct<a: int, b: int>, m array<array<int>>, p array<struct<k: int>>, id int"


def test_nested_nulls_are_values_of_their_own(spark):
    rows = [(["a"], (1, None), [[1]], [(1,)], 1), (["a", None], (None, 1), [[1], None], [(None,)], 2), (["a"], (1, None), [[1, None]], [None], 3)]
    df = spark.createDataFrame(rows, NESTED)
    assert clean(df).table.columns == df.columns
    assert row_groups(df.drop("id", "m", "p")).first().asDict() == {"rows": 3, "distinct_rows": 2, "duplicate_rows": 1, "duplicate_groups": 1}
    assert row_groups(df.select("m")).first().distinct_rows == 3 and row_groups(df.select("p")).first().distinct_rows == 3
    assert distinct_counts(df, ["tags", "s", "m", "p"]) == {"tags": 2, "s": 2, "m": 3, "p": 3}


def test_empty_array_is_not_an_array_of_null(spark):
    df = spark.createDataFrame([([],), ([None],), (None,)], "a array<int>")
    assert row_groups(df).first().distinct_rows == 3 and distinct_counts(df, ["a"]) == {"a": 2}


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiter_and_doubled_quotes(spark, tmp_path, sep):
    path = tmp_path / "t.csv"
    path.write_text(f'name{sep}"a,b;c"\n"O\'Dwyer, ""Nellie"""{sep}1\n"x{sep}y"{sep}2\n')
    df = read_csv(spark, str(path))
    assert df.columns == ["name", "a,b;c"]
    assert [r[0] for r in df.collect()] == ['O\'Dwyer, "Nellie"', f"x{sep}y"]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('name,"n\nm"\r\n"one\ntwo",1\r\nthree,2\n"say ""\n\n"", x",3\n5" pipe,4\n')
    df = read_csv(spark, str(path))
    assert df.columns == ["name", "n\nm"]
    assert sorted(tuple(r) for r in df.collect()) == [('5" pipe', 4), ("one\ntwo", 1), ('say "\n\n", x', 3), ("three", 2)]
    path.write_text('name,n\n"one\ntwo,1\nthree,2\n')
    with pytest.raises(TableLoadError, match="inside quotes"):
        read_csv(spark, str(path))


@pytest.mark.parametrize("split", [64, 1000, 1 << 27])
def test_records_across_splits_match_the_serial_reader(spark, tmp_path, split):
    """Fields with breaks, separators and quotes, some longer than a split, over several files."""
    rng = random.Random(split)
    folder, n = tmp_path / "t", 0
    folder.mkdir()
    for k in range(3):
        with open(folder / f"{k}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(["id", "note", "x"])
            for _ in range(60):
                note = "".join(rng.choice(["a", "b c", '"', ",", "\n", '""', "é"]) for _ in range(rng.choice([0, 1, 3, 9, 200])))
                out.writerow([n, note or "-", rng.randrange(9)])
                n += 1
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
              if spark.conf.get(c, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = sorted(tuple(r) for r in read_csv(spark, str(folder)).collect())
        serial = spark.read.option("multiLine", True).option("header", True).option("escape", '"').option("inferSchema", True).csv(str(folder))
        want = sorted(tuple(r) for r in serial.collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == want and len(got) == 180


def test_amount_example_is_an_amount(spark):
    df = spark.createDataFrame([(f"€{n}", n) for n in range(40, 90)] + [("N/A", 1)], "price string, id int")
    detail = {r.rule: r.detail for r in clean(df).report.collect()}["currency"]
    assert detail == "Example original value: '€40'"


@pytest.mark.parametrize("text, want", [
    ("2020/03/09", "2020-03-09 00:00:00"), ("2020-03-09T10:20:30Z", "2020-03-09 10:20:30"), ("2020-03-09 10:20:30.5+02:00", "2020-03-09 10:20:30.5"),
    ("12/31/2020 23:59", "2020-12-31 23:59:00")])
def test_more_date_formats(spark, text, want):
    df = spark.createDataFrame([(text, i) for i in range(30)], "d string, i int").selectExpr("CASE WHEN i < 2 THEN NULL ELSE d END AS d", "i")
    df = df.unionByName(spark.createDataFrame([(text.replace("20", "19", 1), 99)], "d string, i int"))
    out = clean(df).table
    assert dict(out.dtypes)["d"] == "timestamp_ntz" and str(out.where("i = 5").selectExpr("CAST(d AS STRING)").first()[0]) == want
