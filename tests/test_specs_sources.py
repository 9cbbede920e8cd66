"""Reading, spec validation, parsing, execution and the whole run."""

import pytest
from pyspark.sql import functions as F

from tablelens import TableLoadError, build_dashboard, read_csv, read_table, validate_specs
from tablelens.plans import specs as sp
from tablelens.sources.tables import CLEAN_VIEW, number_repeats, register

VALID = {
    "title": "Rows by room type", "chart_type": "bar", "business_question": "Which room type is most common?",
    "sql_query": "SELECT a, COUNT(*) AS n FROM cleaned_data GROUP BY a", "x_column": "a", "y_column": "n", "color_column": None,
    "aggregation": "COUNT", "sort_order": "desc", "limit": 10, "x_label": None, "y_label": None,
    "plain_language_explanation": "Shows how many rows each type has.",
}


def violations(spark, **changes):
    spec = {**VALID, **changes}
    df = spark.createDataFrame([tuple(spec[n.split(" ")[0].strip("`")] for n in sp.SPEC_SCHEMA.split(", "))], sp.SPEC_SCHEMA)
    return validate_specs(df).first().violations


@pytest.mark.parametrize("changes, want", [
    ({}, []),
    ({"sort_order": None, "limit": None}, []),
    ({"title": "ab"}, ["title_length"]),
    ({"title": None}, ["title_length"]),
    ({"chart_type": "pie"}, ["chart_type"]),
    ({"limit": 1}, ["limit"]),
    ({"x_label": "l" * 61}, ["x_label_length"]),
    ({"sql_query": "DROP TABLE cleaned_data"}, ["sql_not_select", "sql_drop", "sql_source"]),
    ({"sql_query": "SELECT 'drop' FROM cleaned_data"}, ["sql_drop"]),
    ({"sql_query": "SELECT a FROM  cleaned_data"}, ["sql_source"]),
    ({"sql_query": "\n select dropped from cleaned_data"}, []),
    ({"sql_query": "WITH t AS (SELECT 1) SELECT * FROM cleaned_data"}, ["sql_not_select"]),
    ({"chart_type": "histogram"}, ["histogram_has_y", "raw_chart_aggregates"]),
    ({"chart_type": "histogram", "x_column": None, "y_column": None, "aggregation": "NONE"}, ["histogram_without_x"]),
    ({"chart_type": "scatter", "y_column": None, "aggregation": "NONE"}, ["scatter_without_axes"]),
    ({"chart_type": "heatmap", "aggregation": "NONE"}, ["heatmap_has_axes"]),
    ({"chart_type": "line"}, ["line_is_sorted"]),
    ({"chart_type": "line", "sort_order": "none", "aggregation": "NONE"}, ["bar_or_line_without_aggregate"]),
    ({"chart_type": "box"}, []),
])
def test_spec_rules(spark, changes, want):
    assert violations(spark, **changes) == want


def test_responses(spark):
    rows = [(1, '```json\n{"charts": [{"title": "x", "limit": 3}]}\n```'), (2, '{"charts": [{"title": "x"'), (3, "no json"),
            (4, "[]"), (5, '{"charts": []}'), (6, None)]
    df = spark.createDataFrame(rows, "id int, body string")
    assert [(r.id, r.title, r["limit"]) for r in sp.parse_responses(df, "id", "body").collect()] == [(1, "x", 3)]


def test_insights(spark):
    rows = [(1, '{"insights": ["a", 5, "b"]}'), (2, '["1", "2", "3", "4", "5", "6"]'), (3, "{broken"), (4, '{"other": []}'),
            (5, '```\n["z"]\n```')]
    df = spark.createDataFrame(rows, "id int, body string")
    found = {}
    for r in sp.parse_insights(df, "id", "body").orderBy("id", "pos").collect():
        found.setdefault(r.id, []).append(r.insight)
    assert found == {1: ["a", "b"], 2: ["1", "2", "3", "4", "5"], 5: ["z"]}


def test_sql_runs_over_the_cleaned_view_only(spark):
    register(spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], "`room type` string, n int"), CLEAN_VIEW)
    register(spark.range(3), "other")
    out = sp.run_sql(spark, "SELECT \"room type\", SUM(n) AS s FROM cleaned_data WHERE \"room type\" <> 'a \"b\"' GROUP BY \"room type\"")
    assert sorted(map(tuple, out.collect())) == [("x", 1), ("y", 5)]
    assert sp.run_sql(spark, "SELECT n FROM (SELECT n FROM cleaned_data) t WHERE n > 1").count() == 2
    for bad in ("SELECT id FROM other", "SELECT 1 FROM cleaned_data, other", "SELECT 1 FROM cleaned_data JOIN other ON true",
                "SELECT 1 FROM cleaned_data WHERE n IN (SELECT id FROM other)", "SELECT 1 FROM parquet.`/x`"):
        with pytest.raises(ValueError):
            sp.run_sql(spark, bad)


def test_bind_check_and_errors(spark):
    register(spark.createDataFrame([], "a string, n int"), CLEAN_VIEW)
    good, wrong = dict(VALID), {**VALID, "title": "Wrong", "sql_query": "SELECT b FROM cleaned_data"}
    assert [(r.title, r.ok) for r in sp.bind_check(spark, [good, wrong]).collect()] == [(VALID["title"], True), ("Wrong", False)]
    results, errors = sp.run_specs(spark, [good, wrong])
    assert len(results) == 1 and errors[0].startswith("Chart 'Wrong' failed:")
    assert sp.result_preview(results[0][1]).first().preview == "No data returned."


def test_render_data(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 1.0, "b"), (3.0, 0.5, "c")], "x double, y double, k string")
    bar = {"chart_type": "box", "x_column": "k", "y_column": "y", "sort_order": "asc"}
    assert [r.k for r in sp.render_data(df, bar).collect()] == ["c", "b", "a"]
    assert sp.render_data(df, {"chart_type": "heatmap"}).count() == 4
    assert sp.render_data(df, {"chart_type": "histogram", "x_column": "x"}).agg(F.sum("n")).first()[0] == 3


def test_spec_frame_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 4.0), ("a", None)], "k string, v double")
    got = {r.k: r.y for r in sp.spec_frame(df, "k", "v", "MEDIAN").collect()}
    assert got == {"a": 1.0, None: 3.0}


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("name,age,score\nAnn,30,1.5\nBob,40,2.5\nCy,,3.5\n")
    df = read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["string", "int", "double"] and df.count() == 3
    semi = tmp_path / "s.csv"
    semi.write_text("a;b\n1;2\n")
    assert read_csv(spark, str(semi), delimiter=";").columns == ["a", "b"]


def test_csv_with_repeated_names(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("price,price,id\n1,1,7\n2,2,8\n")
    assert read_csv(spark, str(path)).columns == ["price", "price.1", "id"]
    assert number_repeats(["a", "a", "a", "b"]) == ["a", "a.1", "a.2", "b"]


def test_load_errors(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_bytes(b"\x00\xff\xfe\x00 not a table")
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    for path in (bad, empty, tmp_path / "missing.csv"):
        with pytest.raises(TableLoadError):
            read_csv(spark, str(path))
    with pytest.raises(TableLoadError):
        read_table(spark, str(tmp_path / "missing.parquet"))


@pytest.fixture()
def passengers(tmp_path):
    path = tmp_path / "passengers.csv"
    rows = [f"{'male' if i % 2 else 'female'},{20 + i * 2 % 31},{7.5 + i * 3.25}" for i in range(20)]
    path.write_text("sex,age,fare\n" + "\n".join(rows) + "\n")
    return str(path)


def spec(title, sql, kind="bar", x="sex", y="n", agg="COUNT"):
    return {**VALID, "title": title, "sql_query": sql, "chart_type": kind, "x_column": x, "y_column": y, "aggregation": agg, "sort_order": "none"}


def test_dashboard_from_specs(spark, passengers):
    board = build_dashboard(spark, passengers, [
        spec("Count", "SELECT sex, COUNT(*) AS n FROM cleaned_data GROUP BY sex"),
        spec("Mean fare", "SELECT sex, AVG(fare) AS n FROM cleaned_data GROUP BY sex", agg="AVG"),
        spec("Ages", "SELECT age FROM cleaned_data WHERE age IS NOT NULL", "histogram", "age", None, "NONE")])
    assert [c.source for c in board.charts] == ["llm"] * 3 and board.errors == []
    assert {r.sex: r.n for r in board.charts[0].data.collect()} == {"male": 10, "female": 10}
    assert board.charts[2].data.agg(F.sum("n")).first()[0] == 20
    assert board.cleaned.count() == 20 and board.summary.first().row_count == 20


def test_dashboard_falls_back(spark, passengers):
    board = build_dashboard(spark, passengers, [spec(f"Bad {i}", f"SELECT nope{i} FROM cleaned_data") for i in range(3)])
    assert len(board.errors) == 3 and {c.source for c in board.charts} == {"fallback"}
    assert board.charts[0].title == "Dataset summary" and 3 <= len(board.charts) <= 6
    assert all(c.data.count() > 0 for c in board.charts)


def test_dashboard_plans_its_own_specs(spark, passengers):
    board = build_dashboard(spark, passengers)
    assert [c.title for c in board.charts] == ["Number of rows by sex", "Distribution of age", "Average age by sex"]


def test_registered_queries(spark, sf_dir):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 11
