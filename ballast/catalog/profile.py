"""Exploration queries and order statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.catalog.bindings import (
    LENDING,
    SQL_CORPORATE,
    SQL_EVENTS,
    SQL_LENDING,
    SQL_LOANS,
    SQL_PREDICTIONS,
    corporate_raw,
    events,
    lending_raw,
    loans,
    predictions,
    table,
)
from ballast.catalog.columns import over
from ballast.catalog.registry import query, r6, rounded
from ballast.operators import prepare as R
from ballast.operators import profile as O
from ballast.plans.features import DEFAULT_RATINGS


@query("class_counts", over(SQL_EVENTS, "select target, count(*) as n from raw group by target"))
def _(spark, sf_dir):
    return O.class_counts(events(spark, sf_dir))


@query(
    "imbalance_ratio",
    over(SQL_PREDICTIONS, "select dataset, round(max(n) / min(n), 6) as imbalance_ratio from (select dataset, target, count(*) as n from raw group by all) group by dataset"),
)
def _(spark, sf_dir):
    return rounded(O.imbalance_ratio(predictions(spark, sf_dir), keys=["dataset"]))


@query("distinct_values", over(SQL_PREDICTIONS, "select distinct technique from raw"))
def _(spark, sf_dir):
    return O.distinct_values(predictions(spark, sf_dir), "technique")


@query("value_counts", over(SQL_CORPORATE, 'select "Rating", count(*) as n from raw group by all'))
def _(spark, sf_dir):
    return O.value_counts(corporate_raw(spark, sf_dir), "Rating")


@query("value_share", over(SQL_LENDING, "select loan_status, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from raw group by all"))
def _(spark, sf_dir):
    return rounded(O.value_share(lending_raw(spark, sf_dir), "loan_status"))


@query("default_rate", over(SQL_CORPORATE, f"select {r6('count(*) filter (where \"Rating\" in (' + repr('D') + ',' + repr('C') + ',' + repr('CC') + ')) / count(*)', 'default_rate')} from raw"))
def _(spark, sf_dir):
    return rounded(O.default_rate(corporate_raw(spark, sf_dir), F.col("Rating").isin(DEFAULT_RATINGS)))



@query(
    "null_profile",
    over(
        SQL_LENDING,
        " union all ".join(
            f"select '{c}' as column_name, count(*) - count({c}) as missing, round((count(*) - count({c})) * 100 / count(*), 6) as missing_pct from raw"
            for c in LENDING
        ),
    ),
)
def _(spark, sf_dir):
    return rounded(O.null_profile(lending_raw(spark, sf_dir)))


DESCRIBED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def nearest_sql(q: float) -> str:
    return f"min(v) filter (where rn = floor((n - 1) * {q} + 0.5) + 1)"


@query(
    "describe",
    f"with long as (unpivot (select {', '.join(f'cast({c} as double) as {c}' for c in DESCRIBED)} from lineitem) on {', '.join(DESCRIBED)}"
    " into name column_name value v), ranked as (select *, row_number() over (partition by column_name order by v) as rn,"
    " count(*) over (partition by column_name) as n from long) select column_name, count(v) as n, 0 as missing,"
    ' avg(v) as mean, stddev_samp(v) as std, min(v) as "min", max(v) as "max",'
    f" {nearest_sql(0.25)} as q25, {nearest_sql(0.5)} as q50, {nearest_sql(0.75)} as q75 from ranked group by column_name",
)
def _(spark, sf_dir):
    return O.describe(table(spark, sf_dir, "lineitem"))


@query(
    "min_max_date",
    over(SQL_LENDING, "select min(d) as first_month, max(d) as last_month from (select cast(try_strptime(issue_d, '%b-%Y') as date) as d from raw)"),
)
def _(spark, sf_dir):
    return O.min_max_date(lending_raw(spark, sf_dir), "issue_d")


GAPS = ["annual_inc", "percent_bc_gt_75"]


@query(
    "median_impute",
    over(
        SQL_LENDING,
        ", middles as (select "
        + ", ".join(f"median({c}) as {c}_mid" for c in GAPS)
        + " from raw) select id, "
        + ", ".join(r6(f"coalesce({c}, {c}_mid)", c) for c in GAPS)
        + " from raw, middles",
    ),
)
def _(spark, sf_dir):
    return rounded(R.median_impute(lending_raw(spark, sf_dir).select("id", *GAPS), GAPS))


@query(
    "standard_scale",
    over(
        SQL_LOANS,
        ", stats as (select avg(loan_amnt) as m1, stddev_pop(loan_amnt) as s1, avg(annual_inc) as m2,"
        " stddev_pop(annual_inc) as s2 from raw) select row_id, "
        f"{r6('(loan_amnt - m1) / s1', 'loan_amnt')}, {r6('(annual_inc - m2) / s2', 'annual_inc')} from raw, stats",
    ),
)
def _(spark, sf_dir):
    numbers = loans(spark, sf_dir).select("row_id", "loan_amnt", "annual_inc")
    return rounded(R.standard_scale(numbers, ["loan_amnt", "annual_inc"]))
