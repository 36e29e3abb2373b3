"""Behaviour of the operators on a small messy table, properties, and plan shapes."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow.functions.dates import parse_date
from winnow.functions.text import title_case
from winnow.ml import models
from winnow.operators import anomalies, clean, columns, compare, encode, impute, ordered, privacy, quality, reshape, rules, sample, scale
from winnow.plans import steps
from winnow.sources import tables
from winnow.sources.versions import VersionStore

LI = "/root/testdata/sf0.001/lineitem.parquet"


@pytest.fixture(scope="module")
def people(spark):
    """Sixty rows: duplicate ids and rows, gaps, a negative and an absurd age, variant spellings, padded notes."""
    rng = np.random.default_rng(42)
    n = 60
    pdf = pd.DataFrame({
        "row": range(n), "User_ID": [f"ID_{i % 56}" for i in range(n)], "Age": rng.integers(18, 70, n).astype(float),
        "Salary": rng.integers(30000, 120000, n), "Score": rng.uniform(0, 100, n),
        "Category": [("yes", "Yes", "YES", "no", "No")[i % 5] for i in range(n)],
        "Notes": [f"  Customer note number {i}  " for i in range(n)],
        "Signup_Date": [str(d.date()) for d in pd.date_range("2023-01-01", periods=n)], "Purchased": rng.integers(0, 2, n)})
    pdf.loc[:5, "Age"] = None
    pdf.loc[10, "Age"], pdf.loc[20, "Age"], pdf.loc[30, "Salary"] = -5, 180, 950000
    pdf.loc[58, pdf.columns[1:]] = pdf.loc[0, pdf.columns[1:]]
    pdf.loc[59, pdf.columns[1:]] = pdf.loc[1, pdf.columns[1:]]
    pdf["Salary"], pdf["Purchased"] = pdf["Salary"].astype("int64"), pdf["Purchased"].astype("int64")
    return spark.createDataFrame(pdf).replace(float("nan"), None).cache()


@pytest.fixture(scope="module")
def contacts(spark):
    return spark.createDataFrame([
        (" John ", "John", 25, "john@example.com", "123-456-7890", 50000),
        ("Jane ", "Jane", 150, "jane@test.com", "9876543210", 60000),
        ("John ", "John", 25, "invalid-email", "123-456-7890", 50000),
        (" Alice", "Alice", 30, "alice@example.com", "555-123-4567", 70000)],
        "`First Name` string, FirstName string, Age long, Email string, Phone string, Salary long")


def test_rules_catch_age_and_email(contacts):
    got = {r["rule_type"]: r for r in rules.validate(contacts, [
        {"column": "Age", "rule_type": "min_value", "value": 0}, {"column": "Age", "rule_type": "max_value", "value": 120},
        {"column": "Email", "rule_type": "email_format"}]).collect()}
    assert got["min_value"]["passed"] and got["max_value"]["failed_count"] == 1
    assert got["email_format"]["failed_count"] == 1


def test_masking_touches_every_email(contacts):
    masked = [r["Email"] for r in privacy.mask_pii(contacts, "Email", "Email").collect()]
    assert masked == ["jo***@example.com", "ja***@test.com", "in***", "al***@example.com"]


def test_similar_columns_and_merge(contacts):
    pairs = {(r["col1"], r["col2"]) for r in quality.similar_columns(contacts).collect()}
    assert ("First Name", "FirstName") in pairs
    m = columns.merge_columns(contacts, "First Name", "FirstName", "concatenate", "Name")
    assert m.columns == ["Age", "Email", "Phone", "Salary", "Name"]


def test_names_with_blanks_and_dots(spark):
    d = spark.createDataFrame([(1, " x "), (2, None)], "`a b.c` long, `t.x` string")
    assert columns.rename_snake(d).columns == ["a_b.c", "t.x"]
    assert clean.trim_whitespace(d).collect()[0][1] == "x"
    assert clean.fill_all_missing(d).collect()[1][1] == " x "


def test_knn_impute_leaves_no_gap(people):
    got = impute.knn_impute(people, "Age", "row", ["Salary", "Score"])
    assert got.where("Age is null").count() == 0 and got.count() == 60


def test_winsorize_brings_the_extreme_down(people):
    assert clean.winsorize(people, "Salary").agg(F.max("Salary")).first()[0] < 950000


def test_categories_map(people):
    m = {"yes": "Yes", "YES": "Yes", "no": "No"}
    got = {r[0] for r in clean.map_categories(people, "Category", m).select("Category").distinct().collect()}
    assert got == {"Yes", "No"}


def test_standard_scaling_and_back(people):
    s, params = scale.scale_features(people, ["Score", "Salary"], "standard")
    r = s.agg(F.avg("Score"), F.stddev_pop("Score")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9
    back = scale.inverse_scale(s, params).orderBy("row").toPandas()
    np.testing.assert_allclose(back["Score"], people.orderBy("row").toPandas()["Score"])


def test_constant_column_scales_to_zero(spark):
    d = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    for m in ("minmax", "standard", "robust"):
        assert [r[0] for r in scale.scale_features(d, ["x"], m)[0].collect()] == [0.0, 0.0]


def test_repairs_leave_no_negative_age(people):
    found = anomalies.negative_values(people)
    assert found.first()["count"] == 1
    assert anomalies.fix_all(people, "row", found).where("Age < 0").count() == 0


def test_duplicate_ids_get_suffixes(people):
    d = anomalies.fix_duplicate_id(people, "User_ID", "row")
    assert d.select("User_ID").distinct().count() == 60
    assert d.where("User_ID like '%\\_dup\\_%'").count() == 4


def test_random_sample_is_exact_and_repeatable(people):
    a = sample.random_sample(people, "row", 15)
    assert a.count() == 15
    assert {r["row"] for r in a.collect()} == {r["row"] for r in sample.random_sample(people.repartition(7), "row", 15).collect()}


def test_multiply(people):
    a = columns.math_operation(people, "Score", "multiply", 1.5).agg(F.sum("Score")).first()[0]
    assert a == pytest.approx(1.5 * people.agg(F.sum("Score")).first()[0])
    with pytest.raises(ValueError):
        columns.math_operation(people, "Score", "divide", 0)


def test_unknown_names_are_refused(people):
    with pytest.raises(ValueError):
        clean.fill_missing(people, "nope")
    with pytest.raises(ValueError):
        clean.fill_missing(people, "Age", "guess")
    with pytest.raises(ValueError):
        steps.run_steps(people, [{"operation": "guess"}])


def test_steps_report_and_result(people):
    d, log = steps.run_preset(people.drop("row"), "Finance Data", report=True)
    got = {r["operation"]: r["affected"] for r in log.collect()}
    assert got["trim_whitespace"] == 60 and got["remove_duplicates"] == 2 and got["fill_all_missing"] == 6
    assert d.count() == 58 and d.where("Age is null").count() == 0


def test_versions(spark, people, tmp_path):
    v = VersionStore(spark, str(tmp_path / "v"))
    assert v.save(people, "upload") == 1
    assert v.save(people.drop("Notes"), "drop_column") == 2
    diff = v.compare(1, 2, "row").first()
    assert diff["columns_removed"] == "Notes" and diff["cells_changed"] == 0
    assert "Notes" in v.undo().columns and "Notes" not in v.redo().columns
    with pytest.raises(ValueError):
        v.redo()
    assert [(r["version"], r["is_current"]) for r in v.history().orderBy("version").collect()] == [(1, False), (2, True)]


def test_formats_are_checked(spark, people, tmp_path):
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", "xlsx")
    p = str(tmp_path / "empty")
    people.limit(0).write.parquet(p)
    with pytest.raises(ValueError):
        tables.read_table(spark, p, "parquet")


def test_text_that_csv_could_break(spark, tmp_path):
    rows = [(1, 'say "hi", ok'), (2, ""), (3, None), (4, "  pad "), (5, "tab\there"), (6, "back\\slash")]
    d = spark.createDataFrame(rows, "k long, t string")
    for sep in (",", "\t"):
        p = str(tmp_path / f"csv{ord(sep)}")
        tables.write_csv(d, p, sep)
        want = [(k, t or None) for k, t in rows]
        assert sorted(map(tuple, tables.read_csv(spark, p, d.schema, sep).collect())) == sorted(want)
    p = str(tmp_path / "lines")
    tables.write_csv(spark.createDataFrame([(1, "a\nb")], "k long, t string"), p)
    assert tables.read_csv(spark, p, "k long, t string", multi_line=True).first()["t"] == "a\nb"


def test_nan_is_missing(spark):
    d = spark.createDataFrame([(1, float("nan")), (2, 4.0), (3, 6.0)], "k long, x double")
    assert clean.fill_missing(d, "x", "mean").where("k = 1").first()["x"] == 5.0
    assert clean.fill_missing(d, "x", "median").where("k = 1").first()["x"] == 5.0


def test_text_numbers(spark):
    d = spark.createDataFrame([(x,) for x in ("12", " 7.5 ", "1e3", "nan", "1d", "2f", "x", "", None, "-3")], "t string")
    got = [r["t"] for r in columns.change_dtype(d, "t", "float").collect()]
    assert got == [12.0, 7.5, 1000.0, None, None, None, None, None, None, -3.0]


@pytest.mark.parametrize("text,day", [
    ("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("03/04/2020", "2020-03-04"), ("25/12/2020", "2020-12-25"),
    ("25.12.2020", "2020-12-25"), ("20200131", "2020-01-31"), ("Jan 5, 2021", "2021-01-05"), ("5 March 2021", "2021-03-05"),
    ("2024-01-02T03:04:05", "2024-01-02"), ("soon", None), ("12345678", None)])
def test_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(F.date_format(parse_date(F.col("t")), "yyyy-MM-dd")).first()[0]
    assert got == day


def test_labels_look_like_intervals(spark):
    d = spark.createDataFrame([(float(i),) for i in range(0, 101)], "x double")
    got = [r[0] for r in reshape.bin_numeric(d, "x", "equal_width", 4).select("x_binned").distinct().orderBy("x_binned").collect()]
    want = sorted(str(i) for i in pd.cut(pd.Series(np.arange(101.0)), 4, include_lowest=True).cat.categories)
    assert sorted(got) == want


def test_detectors_together(people):
    kinds = {r["type"] for r in anomalies.detect_all(people, order="row").collect()}
    assert {"business_negative_value", "business_duplicate_identifier", "statistical_zscore"} <= kinds


def test_algorithm_filter():
    assert models.choose("classification", ["forest"]) == ["Random Forest"]
    assert models.choose("regression", ["nothing"]) == list(models.REGRESSORS)


# ---------------------------------------------------------------- properties

TEXT = st.text(alphabet="ab'B-z 9\téß", max_size=12)
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(st.lists(TEXT, min_size=1, max_size=25))
def test_trim_is_idempotent_and_counted(spark, xs):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k long, t string")
    once = clean.trim_whitespace(d)
    assert [r["t"] for r in once.orderBy("k").collect()] == [x.strip() for x in xs]
    assert clean.changed_cells(once, clean.trim_plan(once)) == 0
    assert clean.changed_cells(d, clean.trim_plan(d)) == sum(x != x.strip() for x in xs)


@few
@given(st.lists(st.text(alphabet="ab'B-z 9\t", max_size=12), min_size=1, max_size=25))
def test_title_like_python(spark, xs):
    d = spark.createDataFrame([(x,) for x in xs], "t string")
    assert [r[0] for r in d.select(title_case(F.col("t"))).collect()] == [x.title() for x in xs]


@few
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_histogram_counts_every_value(spark, xs):
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    got = reshape.histogram(d, "x").agg(F.sum("n")).first()[0] or 0
    assert got == sum(x is not None for x in xs)


@few
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.sampled_from("ab"))), min_size=1, max_size=40))
def test_duplicates_treat_nulls_as_equal(spark, xs):
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], "k long, a long, b string")
    dup = len(xs) - len(set(xs))
    assert clean.duplicate_count(d, ["a", "b"]) == dup
    assert clean.remove_duplicates(d, ["a", "b"], key="k").count() == len(set(xs))
    flags = clean.duplicate_flag(d, ["a", "b"], "k").where("is_duplicate").count()
    members = clean.duplicate_members(d, ["a", "b"]).where("is_member").count()
    assert flags == dup and members == sum(xs.count(x) > 1 for x in xs)


# ---------------------------------------------------------------- plans

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_products(spark):
    li = spark.read.parquet(LI)
    for d in (clean.duplicate_flag(li, ["l_orderkey"], "l_linenumber"), encode.encode_target(li, "l_returnflag", "l_tax"),
              compare.diff_cells(li, li, "l_orderkey"), ordered.with_row_index(li, "l_orderkey", block_rows=500)):
        p = plan(d)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_only_needed_columns_are_read(spark):
    li = spark.read.parquet(LI)
    p = plan(li.groupBy("l_returnflag").agg(F.avg("l_tax")))
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in p
    p = plan(clean.fill_missing(li, "l_tax", "custom_value", 0).select("l_tax").where("l_tax > 0.05"))
    assert "ReadSchema: struct<l_tax:double>" in p


def test_filters_reach_the_scan(spark):
    li = spark.read.parquet(LI)
    assert "GreaterThan(l_orderkey,10)" in plan(sample.page_after(li, "l_orderkey", 10, 5))


def test_row_order_windows_run_per_block(spark):
    li = spark.read.parquet(LI).select("l_orderkey", "l_tax").dropDuplicates(["l_orderkey"])
    p = plan(ordered.fill_forward(li, "l_tax", "l_orderkey", block_rows=300))
    assert "hashpartitioning(_block" in p


def test_row_wise_steps_add_no_shuffle(spark):
    li = spark.read.parquet(LI)
    d = clean.standardize_case(clean.trim_whitespace(li), None, "upper")
    d = rules.quarantine(privacy.mask_pii(d, "l_linestatus", "name"), [{"column": "l_tax", "rule_type": "min_value", "value": 0}])[0]
    assert "Exchange" not in plan(d)
