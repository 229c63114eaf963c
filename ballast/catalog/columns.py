"""Projections, filters, column operators and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.catalog.bindings import (
    SQL_CORPORATE,
    SQL_LENDING,
    SQL_LOANS,
    SQL_TAIWAN,
    corporate_raw,
    lending_raw,
    loans,
    table,
    taiwan_raw,
)
from ballast.catalog.registry import query, r6, rounded
from ballast.functions import dates as D
from ballast.functions import numeric as N
from ballast.functions import text as X
from ballast.operators import columns as C
from ballast.plans.features import DEFAULT_RATINGS, lending_ratios


def over(view: str, body: str) -> str:
    return f"with raw as ({view}) {body}"


@query(
    "filter_in",
    over(SQL_LOANS, "select row_id, loan_status from raw where loan_status in ('Charged Off', 'Fully Paid')"),
)
def _(spark, sf_dir):
    rows = loans(spark, sf_dir)
    return rows.where(F.col("loan_status").isin("Charged Off", "Fully Paid")).select("row_id", "loan_status")


@query(
    "binarize_target",
    over(SQL_CORPORATE, 'select "Rating" as rating, case when "Rating" in (\'D\', \'C\', \'CC\') then 1 else 0 end as target, count(*) as n from raw group by all'),
)
def _(spark, sf_dir):
    target = F.when(F.col("Rating").isin(DEFAULT_RATINGS), 1).otherwise(0)
    return corporate_raw(spark, sf_dir).groupBy(F.col("Rating").alias("rating"), target.alias("target")).agg(F.count("*").alias("n"))


@query("rename_target", over(SQL_TAIWAN, 'select "ID" as id, "default.payment.next.month" as target from raw'))
def _(spark, sf_dir):
    renamed = C.rename_target(taiwan_raw(spark, sf_dir), "default.payment.next.month")
    return renamed.select(F.col("ID").alias("id"), "target")


@query("select_numeric", "select l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def _(spark, sf_dir):
    return C.select_numeric(table(spark, sf_dir, "lineitem"))


@query("select_by_pattern", over(SQL_TAIWAN, 'select "PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6" from raw'))
def _(spark, sf_dir):
    return C.select_by_pattern(taiwan_raw(spark, sf_dir), r"^PAY_[0-6]")


@query("drop_columns", "select c_nationkey, c_acctbal, c_mktsegment from customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").drop("c_custkey", "c_name")


@query(
    "cast_by_class",
    "select "
    + ", ".join(f"cast({c} as int) as {c}" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    + ", "
    + ", ".join(f"round(cast(cast({c} as float) as double), 3) as {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + ", l_returnflag, l_linestatus, l_shipdate from lineitem",
)
def _(spark, sf_dir):
    return rounded(C.cast_by_class(table(spark, sf_dir, "lineitem")), 3)


@query("cast_sci_numeric", over(SQL_TAIWAN, f'select "ID" as id, {r6("cast(\"LIMIT_BAL\" as double)", "limit_bal")} from raw'))
def _(spark, sf_dir):
    number = N.cast_sci_numeric(F.col("LIMIT_BAL")).alias("limit_bal")
    return rounded(taiwan_raw(spark, sf_dir).select(F.col("ID").alias("id"), number))


@query(
    "group_category",
    over(
        SQL_TAIWAN,
        'select case when "EDUCATION" <= 3 then cast("EDUCATION" as string) else \'4\' end as education,'
        ' case when "MARRIAGE" <= 2 then cast("MARRIAGE" as string) else \'3\' end as marriage, count(*) as n from raw group by all',
    ),
)
def _(spark, sf_dir):
    keys = [N.cap_category(F.col("EDUCATION"), 3).alias("education"), N.cap_category(F.col("MARRIAGE"), 2).alias("marriage")]
    return taiwan_raw(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))


@query(
    "clamp_nonpositive",
    over(SQL_TAIWAN, 'select case when "PAY_0" <= 0 then 0 else "PAY_0" end as delay, count(*) as n from raw group by all'),
)
def _(spark, sf_dir):
    return taiwan_raw(spark, sf_dir).groupBy(N.clamp_nonpositive(F.col("PAY_0")).alias("delay")).agg(F.count("*").alias("n"))


@query(
    "one_hot_drop_first",
    'select c_custkey, cast(c_mktsegment = \'BUILDING\' as int) as "c_mktsegment_BUILDING",'
    ' cast(c_mktsegment = \'FURNITURE\' as int) as "c_mktsegment_FURNITURE",'
    ' cast(c_mktsegment = \'HOUSEHOLD\' as int) as "c_mktsegment_HOUSEHOLD",'
    ' cast(c_mktsegment = \'MACHINERY\' as int) as "c_mktsegment_MACHINERY" from customer',
)
def _(spark, sf_dir):
    return C.one_hot_drop_first(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("sanitize_columns", over(SQL_TAIWAN, 'select "ID" as "ID", "default.payment.next.month" as defaultpaymentnextmonth from raw'))
def _(spark, sf_dir):
    named = taiwan_raw(spark, sf_dir).select("ID", C.quoted("default.payment.next.month"))
    return C.sanitize_columns(named)


PARTS = "select id, annual_inc / 12 as m, installment, revol_bal, dti from raw"


def ieee_sql(a: str, b: str) -> str:
    return (
        f"case when ({a}) is null or ({b}) is null then null when ({b}) = 0 then case when ({a}) = 0 then 'nan'::double"
        f" when ({a}) > 0 then 'inf'::double else '-inf'::double end else ({a}) / ({b}) end"
    )


INCOME = ieee_sql("m", "installment")
REVOLVING = ieee_sql("revol_bal", "m")
NEW_DTI = ieee_sql("dti * m + installment", "m")


def kind_sql(x: str) -> str:
    return f"case when {x} is null then 'null' when isnan({x}) then 'nan' when isinf({x}) then 'inf' else 'finite' end"


def kind(x):
    return (
        F.when(x.isNull(), "null").when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").otherwise("finite")
    )


def finite(x):
    return F.when(kind(x) == "finite", x)


@query(
    "ratio",
    over(
        SQL_LENDING,
        f"select id, {kind_sql('r1')} as income_kind, case when {kind_sql('r1')} = 'finite' then round(r1, 4) end as income,"
        f" {kind_sql('r2')} as revolving_kind, case when {kind_sql('r2')} = 'finite' then round(r2, 4) end as revolving,"
        f" {kind_sql('r3')} as dti_kind, case when {kind_sql('r3')} = 'finite' then round(r3, 4) end as new_dti"
        f" from (select id, {INCOME} as r1, {REVOLVING} as r2, {NEW_DTI} as r3 from ({PARTS}))",
    ),
)
def _(spark, sf_dir):
    made = lending_ratios(lending_raw(spark, sf_dir))
    income, revolving, dti = (F.col(c) for c in ("income_to_payment_ratio", "revol_to_income_ratio", "new_dti"))
    return rounded(
        made.select(
            "id",
            kind(income).alias("income_kind"),
            finite(income).alias("income"),
            kind(revolving).alias("revolving_kind"),
            finite(revolving).alias("revolving"),
            kind(dti).alias("dti_kind"),
            finite(dti).alias("new_dti"),
        ),
        4,
    )


@query(
    "inf_to_null",
    over(SQL_LENDING, f"select kind, count(*) as n from (select {kind_sql('r')} as kind from (select case when isinf(r) then null else r end as r from (select {REVOLVING} as r from ({PARTS})))) group by kind"),
)
def _(spark, sf_dir):
    made = lending_ratios(lending_raw(spark, sf_dir))
    return made.groupBy(kind(N.inf_to_null(F.col("revol_to_income_ratio"))).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "inf_to_nan",
    over(SQL_LENDING, f"select kind, count(*) as n from (select {kind_sql('r')} as kind from (select case when isinf(r) then 'nan'::double else r end as r from (select {REVOLVING} as r from ({PARTS})))) group by kind"),
)
def _(spark, sf_dir):
    made = lending_ratios(lending_raw(spark, sf_dir)).select("revol_to_income_ratio", F.lit(0).alias("target"))
    cleaned = C.clean_features(made)
    return cleaned.groupBy(kind(F.col("revol_to_income_ratio")).alias("kind")).agg(F.count("*").alias("n"))


@query("fill_null_zero", over(SQL_LENDING, f"select id, {r6('coalesce(annual_inc, 0)', 'annual_inc')} from raw"))
def _(spark, sf_dir):
    return rounded(lending_raw(spark, sf_dir).select("id", N.fill_null_zero(F.col("annual_inc")).alias("annual_inc")))


@query(
    "log1p",
    over(
        SQL_LENDING,
        f"select id, {kind_sql('v')} as kind, case when {kind_sql('v')} = 'finite' then round(v, 6) end as logged from (select id,"
        " case when x < -1 then 'nan'::double when x = -1 then '-inf'::double else ln(1 + x) end as v"
        " from (select id, coalesce(annual_inc, 0) as x from raw))",
    ),
)
def _(spark, sf_dir):
    logged = N.ieee_log1p(N.fill_null_zero(F.col("annual_inc")))
    made = lending_raw(spark, sf_dir).select("id", logged.alias("v"))
    return rounded(made.select("id", kind(F.col("v")).alias("kind"), finite(F.col("v")).alias("logged")))


@query(
    "split_xy",
    over(SQL_LOANS, "select count(loan_amnt) as features_rows, sum(target) as positives, 'annual_inc,loan_amnt,nation' as feature_names from raw"),
)
def _(spark, sf_dir):
    df = loans(spark, sf_dir).select("row_id", "loan_amnt", "annual_inc", "nation", "target")
    features, target = C.split_xy(df)
    names = F.lit(",".join(sorted(features)))
    return df.agg(F.count(features[0]).alias("features_rows"), F.sum(target).alias("positives")).withColumn("feature_names", names)


@query(
    "parse_month",
    over(SQL_LENDING, "select id, cast(try_strptime(earliest_cr_line, '%b-%Y') as date) as opened, cast(try_strptime(issue_d, '%b-%Y') as date) as issued from raw"),
)
def _(spark, sf_dir):
    raw = lending_raw(spark, sf_dir)
    return raw.select(
        "id", D.parse_month(F.col("earliest_cr_line")).alias("opened"), D.parse_month(F.col("issue_d")).alias("issued")
    )


@query(
    "months_between_days",
    over(
        SQL_LENDING,
        "select id, round(date_diff('day', cast(try_strptime(earliest_cr_line, '%b-%Y') as date),"
        " cast(try_strptime(issue_d, '%b-%Y') as date)) / 30.4375::double, 6) as months from raw",
    ),
)
def _(spark, sf_dir):
    months = D.months_between_days(D.parse_month(F.col("issue_d")), D.parse_month(F.col("earliest_cr_line")))
    return rounded(lending_raw(spark, sf_dir).select("id", months.alias("months")))


@query(
    "extract_int",
    over(SQL_LENDING, r"select emp_length, try_cast(nullif(regexp_extract(emp_length, '(\d+)', 1), '') as double) as years, count(*) as n from raw group by all"),
)
def _(spark, sf_dir):
    years = X.extract_int(F.col("emp_length")).alias("years")
    return lending_raw(spark, sf_dir).groupBy("emp_length", years).agg(F.count("*").alias("n"))
