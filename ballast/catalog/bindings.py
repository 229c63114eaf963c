"""Views of the given tables in the shape of credit data.

Column expressions are written once, in SQL both engines read, with ``{month:...}``
style helpers where the dialects differ, and used on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One stored prediction per line item; no row is left out.
TECHNIQUE = (
    "case l_suppkey % 5 when 0 then 'baseline' when 1 then 'smote' when 2 then 'random_under_sampling'"
    " when 3 then 'smote_tomek' else 'cs_svm' end"
)
PREDICTIONS = {
    "execution_id": "concat('0190', cast(1995 + l_linenumber % 3 as string), '-0000-7000-8000-000000000000')",
    "dataset": (
        "case l_orderkey % 3 when 0 then 'lending_club' when 1 then 'taiwan_credit'"
        " else 'corporate_credit_rating' end"
    ),
    # The cost-sensitive technique belongs to the linear model alone.
    "model_type": (
        "case when l_suppkey % 5 = 4 then 'svm' when l_partkey % 4 = 0 then 'random_forest'"
        " when l_partkey % 4 = 1 then 'svm' when l_partkey % 4 = 2 then 'xgboost' else 'mlp' end"
    ),
    "technique": TECHNIQUE,
    "seed": "l_linenumber",
    "target": "case when l_returnflag = 'R' then 1 else 0 end",
    "prediction": "case when l_discount > 0.05 then 1 else 0 end",
}

# The same runs, but with every seed in several executions.
OVERLAPPING = PREDICTIONS | {
    "execution_id": "concat('0190', cast(1995 + cast(l_quantity as int) % 3 as string), '-0000-7000-8000-000000000000')"
}

ORDERS_CUSTOMER = "orders join customer on o_custkey = c_custkey"
# Incomes, instalments and balances include zeros, negatives and NULL so that every
# kind of ratio occurs: finite, infinite, 0/0 and missing.
LENDING = {
    "id": "cast(o_orderkey as string)",
    "loan_status": "case o_orderstatus when 'F' then 'Charged Off' when 'O' then 'Fully Paid' else 'Current' end",
    "issue_d": "{month_text}",
    "earliest_cr_line": "case when c_nationkey = 3 then 'unknown' else concat('Jan-', cast(1960 + c_nationkey as string)) end",
    "emp_length": "case when c_nationkey = 5 then 'n/a' else o_orderpriority end",
    "loan_amnt": "o_totalprice",
    "installment": "case when c_nationkey = 9 then cast(0 as double) else o_totalprice / 36 end",
    "annual_inc": "case c_nationkey when 7 then cast(0 as double) when 8 then cast(null as double) else c_acctbal end",
    "dti": "c_nationkey * cast(1.5 as double)",
    "delinq_2yrs": "cast(o_orderkey % 3 as double)",
    "inq_last_6mths": "cast(o_orderkey % 4 as double)",
    "open_acc": "cast(o_custkey % 20 as double)",
    "pub_rec": "cast(o_orderkey % 2 as double)",
    "revol_bal": "case when o_orderpriority = '5-LOW' then cast(0 as double) else o_totalprice / 10 end",
    "revol_util": "cast(o_custkey % 100 as double)",
    "total_acc": "cast(o_custkey % 40 as double)",
    "avg_cur_bal": "c_acctbal / 2",
    "total_rev_hi_lim": "o_totalprice * 2",
    "acc_open_past_24mths": "cast(o_orderkey % 7 as double)",
    "percent_bc_gt_75": "cast(nullif(o_orderkey % 5, 0) as double)",
    "inq_fi": "cast(o_custkey % 6 as double)",
    "term": "case when o_orderpriority < '3' then ' 36 months' else ' 60 months' end",
    "home_ownership": "case c_nationkey % 3 when 0 then 'OWN' when 1 then 'RENT' else 'MORTGAGE' end",
    "verification_status": "case o_orderkey % 3 when 0 then 'Verified' when 1 then 'Source Verified' else 'Not Verified' end",
    "purpose": "c_mktsegment",
}
MONTH_TEXT = {"spark": "date_format(o_orderdate, 'MMM-yyyy')", "duckdb": "strftime(o_orderdate, '%b-%Y')"}

TAIWAN = {
    "ID": "o_orderkey",
    "LIMIT_BAL": "case when c_nationkey % 2 = 0 then '1e+05' else cast(o_totalprice as string) end",
    "SEX": "1 + c_nationkey % 2",
    "EDUCATION": "nullif(c_nationkey % 7, 6)",
    "MARRIAGE": "c_nationkey % 4",
    "AGE": "21 + c_nationkey",
    **{f"PAY_{i}": f"cast((o_orderkey + {i}) % 11 - 2 as int)" for i in (0, 2, 3, 4, 5, 6)},
    **{f"BILL_AMT{i}": f"c_acctbal * {i}" for i in range(1, 7)},
    **{f"PAY_AMT{i}": f"cast((o_orderkey * {i}) % 5000 as int)" for i in range(1, 7)},
    '"default.payment.next.month"': "case when o_orderstatus = 'F' then 1 else 0 end",
}

LINEITEM_PART = "lineitem join part on l_partkey = p_partkey"
CORPORATE = {
    "Rating": "case when l_returnflag = 'R' then case p_size % 3 when 0 then 'D' when 1 then 'C' else 'CC' end when l_linestatus = 'O' then 'AAA' else 'BBB' end",
    "Name": "p_name",
    "Symbol": "cast(l_orderkey as string)",
    '"Rating Agency Name"': "p_brand",
    '"Date"': "cast(l_linenumber as string)",
    "Sector": "p_type",
    "currentRatio": "l_quantity",
    "grossProfitMargin": "l_extendedprice",
    "debtRatio": "l_discount",
    "effectiveTaxRate": "l_tax",
    "assetTurnover": "p_retailprice",
}

# Loans in numbers only, as the sampling operators take them.
LOANS = {
    "row_id": "o_orderkey",
    "target": "case when o_orderstatus = 'F' then 1 else 0 end",
    "loan_amnt": "o_totalprice",
    "annual_inc": "c_acctbal",
    "purpose": "c_mktsegment",
    "emp_length": "o_orderpriority",
    "nation": "c_nationkey",
    "loan_status": "case o_orderstatus when 'F' then 'Charged Off' when 'O' then 'Fully Paid' else 'Current' end",
}
EVENTS = {
    "row_id": "event_id",
    "user_id": "user_id",
    "value": "value",
    "target": "case when event_type = 'error' then 1 else 0 end",
}
EMBEDDINGS = {
    "row_id": "vec_id",
    "x": "{vector}",
    "target": "case when label = 0 then 1 else 0 end",
}
VECTOR = {"spark": "cast(embedding as array<double>)", "duckdb": "cast(embedding as double[])"}
LABELLED = {"row_id": "doc_id", "quality": "quality", "target": "toxic"}


def _expressions(columns: dict[str, str], engine: str) -> list[str]:
    out = []
    for name, expression in columns.items():
        text = expression.replace("{month_text}", MONTH_TEXT[engine]).replace("{vector}", VECTOR[engine])
        alias = name.replace('"', "`") if engine == "spark" else name
        out.append(f"{text} as {alias}")
    return out


def select_sql(columns: dict[str, str], source: str) -> str:
    """The view as DuckDB SQL."""
    return f"select {', '.join(_expressions(columns, 'duckdb'))} from {source}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*_expressions(columns, "spark"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions of three executions."""
    return _view(table(spark, sf_dir, "lineitem"), PREDICTIONS)


def overlapping_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions of three executions that share their seeds."""
    return _view(table(spark, sf_dir, "lineitem"), OVERLAPPING)


def orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


def lending_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(orders_customer(spark, sf_dir), LENDING)


def taiwan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(orders_customer(spark, sf_dir), TAIWAN)


def corporate_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return _view(lineitem.join(part, lineitem.l_partkey == part.p_partkey), CORPORATE)


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(orders_customer(spark, sf_dir), LOANS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "events"), EVENTS)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "embeddings"), EMBEDDINGS)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "labels"), LABELLED)


SQL_PREDICTIONS = select_sql(PREDICTIONS, "lineitem")
SQL_OVERLAPPING = select_sql(OVERLAPPING, "lineitem")
SQL_LENDING = select_sql(LENDING, ORDERS_CUSTOMER)
SQL_TAIWAN = select_sql(TAIWAN, ORDERS_CUSTOMER)
SQL_CORPORATE = select_sql(CORPORATE, LINEITEM_PART)
SQL_LOANS = select_sql(LOANS, ORDERS_CUSTOMER)
SQL_EVENTS = select_sql(EVENTS, "events")
SQL_EMBEDDINGS = select_sql(EMBEDDINGS, "embeddings")
SQL_LABELLED = select_sql(LABELLED, "labels")
