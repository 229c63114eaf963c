import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.catalog.registry import long_counts, long_form
from ballast.functions import dates as D
from ballast.functions import numeric as N
from ballast.functions.text import extract_int
from ballast.operators import columns as C
from ballast.operators import profile as O
from ballast.plans import features as P

INF, NAN = float("inf"), float("nan")


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b))))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(1.0, 2.0, 0.5), (1.0, 0.0, INF), (-1.0, 0.0, -INF), (0.0, 0.0, NAN), (NAN, 0.0, NAN), (None, 0.0, None), (1.0, None, None), (NAN, 2.0, NAN)],
)
def test_division(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert same(df.select(N.ieee_divide(F.col("a"), F.col("b"))).first()[0], want)


@pytest.mark.parametrize(("x", "want"), [(0.0, 0.0), (-1.0, -INF), (-2.0, NAN), (NAN, NAN), (None, None), (math.e - 1, 1.0)])
def test_log(spark, x, want):
    got = spark.createDataFrame([(x,)], "x double").select(N.ieee_log1p(F.col("x"))).first()[0]
    assert same(got, want) or got == pytest.approx(want)


def test_missing_values_stay_apart(spark):
    df = spark.createDataFrame([(None,), (NAN,), (-3.0,)], "x double")
    x = F.col("x")
    got = df.select(N.fill_null_zero(x), N.fill_nan_zero(x), N.clamp_nonpositive(x)).collect()
    assert [r[0] for r in got][0] == 0 and math.isnan(got[1][0])
    assert got[0][1] is None and got[1][1] == 0
    assert got[0][2] is None and math.isnan(got[1][2]) and got[2][2] == 0


def test_texts(spark):
    df = spark.createDataFrame([("Mar-2016", "10+ years"), ("bad", "none"), (None, None)], "m string, e string")
    got = df.select(D.parse_month(F.col("m")).cast("string"), extract_int(F.col("e"))).collect()
    assert [tuple(r) for r in got] == [("2016-03-01", 10.0), (None, None), (None, None)]


def test_infinite_features_become_nan_and_integers_stay(spark):
    df = spark.createDataFrame([(1.0, 1, 0), (INF, 2, 1), (-INF, 3, 0)], "feature double, n int, target int")
    got = C.clean_features(df).orderBy("n").collect()
    assert got[0].feature == 1.0 and math.isnan(got[1].feature) and math.isnan(got[2].feature)
    assert [r.n for r in got] == [1, 2, 3]
    with pytest.raises(ValueError, match="target"):
        C.split_xy(df.drop("target"))


def test_dummies(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c d",)], "k string")
    got = C.sanitize_columns(C.one_hot_drop_first(df, ["k"]))
    assert got.columns == ["k_b", "k_cd"]
    assert [tuple(r) for r in got.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    with pytest.raises(ValueError, match="levels"):
        C.one_hot_drop_first(spark.range(20).select(F.col("id").cast("string").alias("k")), ["k"], C.category_levels(df, ["k"], 1))


def test_name_clashes_raise(spark):
    with pytest.raises(ValueError, match="share"):
        C.sanitize_columns(spark.createDataFrame([(1, 2)], ["a b", "a-b"]))


def test_narrowing_overflow_raises(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        C.cast_by_class(spark.createDataFrame([(2**40,)], "n bigint")).collect()


def lending(spark, **changes):
    row = {
        "id": "007", "loan_status": "Charged Off", "issue_d": "Dec-2016", "earliest_cr_line": "Dec-2006",
        "emp_length": "10+ years", "term": " 36 months", "home_ownership": "RENT", "verification_status": "Verified", "purpose": "car",
    }
    row |= {c: 12.0 for c in P.LENDING_RAW_NUMERIC} | changes
    other = row | {"id": "008", "loan_status": "Fully Paid", "term": " 60 months", "purpose": "house"}
    left_out = row | {"id": "009", "loan_status": "Current"}
    schema = ", ".join(f"{c} {'double' if isinstance(v, float) or v is None else 'string'}" for c, v in row.items())
    return spark.createDataFrame([tuple(r[c] for c in row) for r in (row, other, left_out)], schema)


def test_lending_job(spark):
    got = {r.row_id: r for r in P.lending_features(lending(spark)).collect()}
    assert set(got) == {"007", "008"} and (got["007"].target, got["008"].target) == (1, 0)
    row = got["007"]
    assert row.emp_length_num == 10 and row.credit_age_months == pytest.approx(3653 / 30.4375, rel=1e-6)
    assert row.annual_inc == pytest.approx(math.log(13), rel=1e-6)
    assert row.income_to_payment_ratio == pytest.approx(math.log1p(1 / 12), rel=1e-6)
    assert row.revol_to_income_ratio == pytest.approx(math.log1p(12), rel=1e-6) and row.new_dti == 24
    assert (got["007"].term_60months, got["008"].term_60months, got["008"].purpose_house) == (0, 1, 1)


def test_lending_zero_income(spark):
    row = P.lending_features(lending(spark, annual_inc=0.0)).first()
    assert row.revol_to_income_ratio == 0 and row.new_dti is None and row.income_to_payment_ratio == 0
    row = P.lending_features(lending(spark, annual_inc=0.0, revol_bal=0.0)).first()
    assert math.isnan(row.revol_to_income_ratio)
    row = P.lending_features(lending(spark, annual_inc=None)).first()
    assert row.annual_inc == 0 and row.new_dti is None


def test_taiwan_job(spark):
    names = ["ID", "LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE", "PAY_0", "BILL_AMT1", "PAY_AMT1", "default.payment.next.month"]
    rows = [(1, "1e+05", 1, 0, 0, 30, -2, 5, 6, 1), (2, "200", 2, 5, 3, 31, 8, 5, 6, 0), (3, "300", 2, None, None, 32, 0, 5, 6, 0)]
    raw = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType() if n == "LIMIT_BAL" else T.IntegerType()) for n in names]))
    got = P.taiwan_features(raw).orderBy("row_id").collect()
    assert [r.LIMIT_BAL for r in got] == [100000.0, 200.0, 300.0] and [r.PAY_0 for r in got] == [0, 8, 0]
    assert [r.EDUCATION_CAT_4 for r in got] == [0, 1, 1] and [r.MARRIAGE_CAT_3 for r in got] == [0, 1, 1]
    assert [r.SEX_CAT_2 for r in got] == [0, 1, 1] and [r.target for r in got] == [1, 0, 0]
    assert "EDUCATION_CAT_0" not in got[0].asDict()


def test_corporate_job(spark):
    rows = [("D", "n1", "s", "a", "2015", "Tech & Co", 1.5), ("AAA", "n2", "s", "a", "2015", "Energy", 2.5), ("CC", "n3", "s", "a", "2016", None, None)]
    raw = spark.createDataFrame(rows, "Rating string, Name string, Symbol string, `Rating Agency Name` string, Date string, Sector string, ratio double")
    got = P.corporate_features(raw).collect()
    assert sorted(r.target for r in got) == [0, 1, 1] and len({r.row_id for r in got}) == 3
    assert set(got[0].asDict()) == {"row_id", "ratio", "Sector_TechCo", "target"}


def test_jobs_of_all_datasets():
    assert sorted(P.FEATURE_JOBS) == ["corporate_credit_rating", "lending_club", "taiwan_credit", "test"]


def test_row_ids_are_unique_and_stable(spark):
    from ballast.operators.identity import with_row_ids

    rows = [("a", None), ("a", None), ("aN", ""), ("a", "N"), (None, "a"), ("", None), (None, "")] + [("same", "same")] * 40
    got = [with_row_ids(spark.createDataFrame(rows, "x string, y string").repartition(n), "id").collect() for n in (1, 6)]
    for found in got:
        assert len({r.id for r in found}) == len(rows)
    assert {(r.id, r.x, r.y) for r in got[0]} == {(r.id, r.x, r.y) for r in got[1]}
    assert {r.id.split("#")[1] for r in got[0] if r.x == "same"} == {str(i) for i in range(1, 41)}
    assert with_row_ids(spark.createDataFrame([], "x string"), "id").count() == 0


def test_rows_that_occur_once_are_not_joined(spark):
    from ballast.operators.identity import row_digest, with_row_ids

    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "a int, b string")
    named = with_row_ids(df, "id")
    assert "Join" not in named._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in named.collect()} == {tuple(r) for r in df.withColumn("id", row_digest(["a", "b"])).collect()}


@pytest.mark.parametrize("sent", [0, 100])
def test_row_ids_whatever_is_told_of_repeats(spark, monkeypatch, sent):
    """Digests that share their short form are told apart, with few repeats and with many."""
    from ballast.operators import identity

    df = spark.createDataFrame([(i % 40,) for i in range(60)], "a int").repartition(3)
    monkeypatch.setattr(identity, "SENT_KEYS", sent)
    monkeypatch.setattr(identity.F, "xxhash64", lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(7)))
    got = identity.with_row_ids(df, "id").collect()
    plain = {r.a: r.id for r in df.distinct().withColumn("id", identity.row_digest(["a"])).collect()}
    assert sorted((r.a, r.id) for r in got) == sorted(
        (a, f"{d}#{i}") if a < 20 else (a, d) for a, d in plain.items() for i in ((1, 2) if a < 20 else (1,))
    )


def test_profile(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", NAN), ("a", None), ("a", 4.0)], "k string, v double")
    assert {(r.k, r.n, r.share) for r in O.value_share(df, "k").collect()} == {("a", 3, 0.75), ("b", 1, 0.25)}
    assert [tuple(r) for r in O.null_profile(df).collect()] == [("v", 1, 25.0), ("k", 0, 0.0)]
    row = O.describe(df).first()
    assert (row.n, row.missing, row.mean, row.q25, row.q75) == (2, 2, 2.5, 1.0, 4.0)


def test_five_thousand_levels(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("one"))
    levels = C.category_levels(df, ["k", "one"])
    assert len(levels["k"]) == 5000 and levels["one"] == ["x"]
    with pytest.raises(ValueError, match="levels"):
        C.category_levels(df, ["k", "one"], 4999)


def test_registry_counts_cells_before_they_are_laid_out(spark):
    rows = [(1, float("nan"), "a", None), (2, float("inf"), None, None), (None, None, "nan", None)]
    df = spark.createDataFrame(rows, "id bigint, `x.y` double, t string, empty int")
    cells = long_form(df, dataset="d").groupBy("dataset", "column_name").agg(F.count("*").alias("n"), F.count("value").alias("present"))
    counts = long_counts(df, dataset="d")
    assert sorted(counts.collect()) == sorted(cells.collect())
    assert counts.columns == cells.columns
    assert long_counts(df.limit(0), dataset="d").count() == 0
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # what is laid out is one row a column
