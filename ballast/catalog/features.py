"""The three feature jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ballast.catalog.bindings import (
    CORPORATE,
    SQL_CORPORATE,
    SQL_LENDING,
    SQL_TAIWAN,
    corporate_raw,
    lending_raw,
    taiwan_raw,
)
from ballast.catalog.columns import INCOME, NEW_DTI, REVOLVING, over
from ballast.catalog.registry import ORACLES, long_counts, long_sql, query, rounded
from ballast.plans.features import (
    FEATURE_JOBS,
    LENDING_RAW_NUMERIC,
)

DIGITS = 3


def f32(expression: str, alias: str) -> str:
    """A 32-bit value, compared to three decimals."""
    return f'round(cast(cast({expression} as float) as double), {DIGITS}) as "{alias}"'


def dummies(column: str, values: list[str], clean: dict[str, str] | None = None) -> str:
    return ", ".join(
        f"case when {column} = '{v}' then 1 else 0 end as \"{column}_{(clean or {}).get(v, v)}\"" for v in values
    )


def log_sql(x: str) -> str:
    return f"case when ({x}) < -1 then 'nan'::double when ({x}) = -1 then '-inf'::double else ln(1 + ({x})) end"


def finite_sql(x: str) -> str:
    return f"case when isinf({x}) then null else ({x}) end"


PLAIN = [c for c in LENDING_RAW_NUMERIC if c != "annual_inc"]
LENDING_SQL = over(
    SQL_LENDING,
    ", parts as (select *, annual_inc / 12 as m from raw where loan_status in ('Charged Off', 'Fully Paid')),"
    f" made as (select *, {finite_sql(INCOME)} as income, {finite_sql(REVOLVING)} as revolving, {finite_sql(NEW_DTI)} as debt from parts)"
    " select id as row_id, "
    + ", ".join(f32(c, c) for c in PLAIN)
    + ", "
    + ", ".join(
        [
            f32(log_sql("coalesce(annual_inc, 0)"), "annual_inc"),
            f32(r"try_cast(nullif(regexp_extract(emp_length, '(\d+)', 1), '') as double)", "emp_length_num"),
            f32(
                "date_diff('day', cast(try_strptime(earliest_cr_line, '%b-%Y') as date),"
                " cast(try_strptime(issue_d, '%b-%Y') as date)) / 30.4375::double",
                "credit_age_months",
            ),
            f32("debt", "new_dti"),
            f32(log_sql("coalesce(income, 0)"), "income_to_payment_ratio"),
            f32(log_sql("coalesce(revolving, 0)"), "revol_to_income_ratio"),
            dummies("term", [" 60 months"], {" 60 months": "60months"}),
            dummies("home_ownership", ["OWN", "RENT"]),
            dummies("verification_status", ["Source Verified", "Verified"], {"Source Verified": "SourceVerified"}),
            dummies("purpose", ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
            "case when loan_status = 'Charged Off' then 1 else 0 end as target",
        ]
    )
    + " from made",
)


@query("lending_features", LENDING_SQL)
def _(spark, sf_dir):
    return rounded(FEATURE_JOBS["lending_club"](lending_raw(spark, sf_dir)), DIGITS)


CARDS = ", ".join(
    [f32('"LIMIT_BAL"', "LIMIT_BAL"), '"AGE"']
    + [f32(f'case when "PAY_{i}" <= 0 then 0 else "PAY_{i}" end', f"PAY_{i}") for i in (0, 2, 3, 4, 5, 6)]
    + [f32(f'"BILL_AMT{i}"', f"BILL_AMT{i}") for i in range(1, 7)]
    + [f32(f'"PAY_AMT{i}"', f"PAY_AMT{i}") for i in range(1, 7)]
)


@query(
    "taiwan_features",
    over(
        SQL_TAIWAN,
        ', grouped as (select *, case when "EDUCATION" <= 3 then cast("EDUCATION" as string) else \'4\' end as "EDUCATION_CAT",'
        ' case when "MARRIAGE" <= 2 then cast("MARRIAGE" as string) else \'3\' end as "MARRIAGE_CAT",'
        ' cast("SEX" as string) as "SEX_CAT" from raw)'
        f' select "ID" as row_id, {CARDS}, {dummies("EDUCATION_CAT", ["1", "2", "3", "4"])},'
        f' {dummies("MARRIAGE_CAT", ["1", "2", "3"])}, {dummies("SEX_CAT", ["2"])},'
        ' "default.payment.next.month" as target from grouped',
    ),
)
def _(spark, sf_dir):
    return rounded(FEATURE_JOBS["taiwan_credit"](taiwan_raw(spark, sf_dir)), DIGITS)


QUOTED = [c if c.startswith('"') else f'"{c}"' for c in CORPORATE]
RATIOS = ["currentRatio", "grossProfitMargin", "debtRatio", "effectiveTaxRate", "assetTurnover"]


@query(
    "corporate_features",
    over(
        SQL_CORPORATE,
        ", named as (select *, md5(concat(" + ", ".join(f"coalesce(concat(length(cast({c} as varchar)), ':', cast({c} as varchar)), 'N')" for c in QUOTED) + ")) as digest from raw),"
        " numbered as (select *, count(*) over (partition by digest) as copies, row_number() over (partition by digest) as copy from named)"
        " select case when copies = 1 then digest else concat(digest, '#', copy) end as row_id, "
        + ", ".join(f32(f'"{c}"', c) for c in RATIOS)
        + ", "
        + dummies('"Sector"', ["LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]).replace('""Sector"_', '"Sector_')
        + ", case when \"Rating\" in ('D', 'C', 'CC') then 1 else 0 end as target from numbered",
    ),
)
def _(spark, sf_dir):
    return rounded(FEATURE_JOBS["corporate_credit_rating"](corporate_raw(spark, sf_dir)), DIGITS)


JOB_SQL = {
    "corporate_credit_rating": "corporate_features",
    "lending_club": "lending_features",
    "taiwan_credit": "taiwan_features",
    "test": "taiwan_features",
}


# Every column each job makes, with its rows and how many of them hold a value.
@query(
    "dataset_registry",
    "select dataset, column_name, count(*) as n, count(value) as present from ("
    + " union all ".join(long_sql(ORACLES[q], dataset=d) for d, q in JOB_SQL.items())
    + ") group by all",
)
def _(spark, sf_dir):
    raw = {
        "lending_club": lending_raw,
        "taiwan_credit": taiwan_raw,
        "test": taiwan_raw,
        "corporate_credit_rating": corporate_raw,
    }
    made = [long_counts(raw[d](spark, sf_dir).transform(job), dataset=d) for d, job in FEATURE_JOBS.items()]
    return reduce(DataFrame.unionByName, made)
