"""Metrics, rankings and the end-user analyses over the stored predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.catalog.bindings import SQL_OVERLAPPING, SQL_PREDICTIONS, overlapping_predictions, predictions
from ballast.catalog.registry import ORACLES, long_form, long_sql, query, r6, rounded
from ballast.operators import metrics as M
from ballast.plans import analysis as A
from ballast.vocabulary import LABELS, METRIC_LABELS, METRICS, ORDERED, REAL_DATASETS

KEYS = "dataset, model_type, technique, seed"
COUNTS = """
    count(*) filter (where target = 1 and prediction = 1) as "TP",
    count(*) filter (where target = 0 and prediction = 0) as "TN",
    count(*) filter (where target = 0 and prediction = 1) as "FP",
    count(*) filter (where target = 1 and prediction = 0) as "FN"
"""


def share(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then 0.0 else cast({a} as double) / ({b}) end"


def cte(*parts: tuple[str, str]) -> str:
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in parts) + "\n"


P = ("predictions", SQL_PREDICTIONS)
CONFUSION = ("confusion", f"select {KEYS}, {COUNTS} from predictions group by {KEYS}")
BASE = (
    "base",
    f"""select *, {share('"TP"', '"TP" + "FN"')} as sensitivity, {share('"TN"', '"TN" + "FP"')} as specificity,
    {share('"TP"', '"TP" + "FP"')} as "precision" from confusion""",
)
SEED = (
    "per_seed",
    f"""select *, {share('2 * "precision" * sensitivity', '"precision" + sensitivity')} as f1_score,
    sqrt(sensitivity * specificity) as g_mean, (sensitivity + specificity) / 2 as balanced_accuracy from base""",
)
MEANS = ", ".join(f'avg("{m}") as {m}_mean, stddev_samp("{m}") as {m}_std' for m in METRICS)
MEAN = ("metrics", f"select dataset, model_type, technique, {MEANS} from per_seed group by dataset, model_type, technique")
PER_SEED = cte(P, CONFUSION, BASE, SEED)
METRICS_SQL = cte(P, CONFUSION, BASE, SEED, MEAN)
# Seeds occur in several executions; the newest of each dataset counts.
NEWEST_METRICS_SQL = cte(
    ("every", SQL_OVERLAPPING),
    ("predictions", "select * from every where (dataset, execution_id) in (select (dataset, max(execution_id)) from every group by dataset)"),
    CONFUSION,
    BASE,
    SEED,
    MEAN,
)
ROUND_METRICS = ", ".join(r6(f'"{m}"', f'"{m}"') for m in METRICS)
ROUND_MEANS = ", ".join(f"{r6(f'{m}_mean', f'{m}_mean')}, {r6(f'{m}_std', f'{m}_std')}" for m in METRICS)


def code_case(column: str, kind: str) -> str:
    whens = " ".join(f"when '{code}' then '{label}'" for code, label in LABELS[kind].items())
    return f"case {column} {whens} end"


def ord_case(column: str, kind: str) -> str:
    return "case " + column + "".join(f" when '{c}' then {i + 1}" for i, c in enumerate(ORDERED[kind])) + " end"


def fixed4_sql(x: str) -> str:
    return f"printf('%.4f', {x})"


def mean_std_sql(m: str) -> str:
    return f"concat({fixed4_sql(f'{m}_mean')}, ' (', coalesce({fixed4_sql(f'{m}_std')}, 'n/a'), ')')"


def trimmed_sql(x: str) -> str:
    return rf"regexp_replace({fixed4_sql(x)}, '(\.\d+?)0+$', '\1')"


TECHNIQUE_LABEL = code_case("technique", "technique")
MODEL_LABEL = code_case("model_type", "model_type")


def per_seed(spark, sf_dir):
    return M.metrics_per_seed(predictions(spark, sf_dir))


def metrics(spark, sf_dir):
    return M.metrics_mean_std(per_seed(spark, sf_dir))


@query("confusion_matrix", cte(P) + f"select {KEYS}, {COUNTS} from predictions group by {KEYS}")
def _(spark, sf_dir):
    return M.confusion_matrix(predictions(spark, sf_dir))


@query(
    "classification_metrics",
    PER_SEED.replace(KEYS, "dataset, model_type, technique")
    + f'select dataset, model_type, technique, "TP", "TN", "FP", "FN", {ROUND_METRICS} from per_seed',
)
def _(spark, sf_dir):
    confusion = M.confusion_matrix(predictions(spark, sf_dir), M.PAIR_KEYS)
    return rounded(M.classification_metrics(confusion))


@query("metrics_per_seed", PER_SEED + f'select {KEYS}, "TP", "TN", "FP", "FN", {ROUND_METRICS} from per_seed')
def _(spark, sf_dir):
    return rounded(per_seed(spark, sf_dir))


@query("metrics_mean_std", METRICS_SQL + f"select dataset, model_type, technique, {ROUND_MEANS} from metrics")
def _(spark, sf_dir):
    return rounded(metrics(spark, sf_dir))


@query("sqrt", PER_SEED + f"select {KEYS}, {r6('g_mean', 'g_mean')} from per_seed")
def _(spark, sf_dir):
    return rounded(per_seed(spark, sf_dir).select(*M.SEED_KEYS, "g_mean"))


@query("g_mean_scorer", PER_SEED.replace(KEYS, "dataset, model_type") + f"select dataset, model_type, {r6('g_mean', 'g_mean')} from per_seed")
def _(spark, sf_dir):
    return rounded(M.g_mean_score(predictions(spark, sf_dir), ["dataset", "model_type"]))


@query(
    "sort_summary",
    METRICS_SQL
    + "select dataset, model_type, technique, round(balanced_accuracy_mean, 6) as balanced_accuracy_mean from metrics"
    " order by metrics.balanced_accuracy_mean desc, dataset, model_type, technique",
)
def _(spark, sf_dir):
    ranked = A.sort_summary(metrics(spark, sf_dir))
    return rounded(ranked.select("dataset", "model_type", "technique", "balanced_accuracy_mean"))


@query(
    "sort_stability",
    PER_SEED + f"select {KEYS}, {ROUND_METRICS} from per_seed order by dataset, {ord_case('model_type', 'model_type')},"
    f" {ord_case('technique', 'technique')}, seed",
)
def _(spark, sf_dir):
    return rounded(A.sort_stability(per_seed(spark, sf_dir)).select(*M.SEED_KEYS, *METRICS))


CELLS = ", ".join(f'{mean_std_sql(m)} as "{m}"' for m in METRICS)
PLACE = "row_number() over (partition by dataset order by balanced_accuracy_mean desc, model_type, technique) as position"


@query("summary_table", METRICS_SQL + f"select dataset, {PLACE}, model_type, technique, {CELLS} from metrics")
def _(spark, sf_dir):
    return A.summary_table(metrics(spark, sf_dir))


@query(
    "summary_table_smote",
    METRICS_SQL + f"select dataset, {PLACE}, model_type, technique, {CELLS} from metrics where technique = 'smote'",
)
def _(spark, sf_dir):
    return A.summary_table(metrics(spark, sf_dir), "smote")


@query(
    "format_mean_std",
    METRICS_SQL + f"select dataset, model_type, technique, {mean_std_sql('f1_score')} as cell from metrics",
)
def _(spark, sf_dir):
    from ballast.functions.text import format_mean_std

    cell = format_mean_std(F.col("f1_score_mean"), F.col("f1_score_std"))
    return metrics(spark, sf_dir).select(*M.PAIR_KEYS, cell.alias("cell"))


@query(
    "round_to_string",
    METRICS_SQL + f"select dataset, model_type, technique, {trimmed_sql('precision_std')} as cell from metrics",
)
def _(spark, sf_dir):
    from ballast.functions.text import round_to_string

    return metrics(spark, sf_dir).select(*M.PAIR_KEYS, round_to_string(F.col("precision_std")).alias("cell"))


@query(
    "concat_label",
    cte(P) + "select concat(technique, ' / ', model_type) as technique_model, count(*) as n from predictions group by 1",
)
def _(spark, sf_dir):
    from ballast.functions.text import concat_label

    label = concat_label(F.col("technique"), F.col("model_type")).alias("technique_model")
    return predictions(spark, sf_dir).groupBy(label).agg(F.count("*").alias("n"))


@query(
    "map_labels",
    cte(P)
    + f"select technique, {TECHNIQUE_LABEL} as technique_label, model_type, {MODEL_LABEL} as model_type_label,"
    " count(*) as n from predictions group by all",
)
def _(spark, sf_dir):
    counts = predictions(spark, sf_dir).groupBy("technique", "model_type").agg(F.count("*").alias("n"))
    return A.with_labels(counts)


@query(
    "tradeoff_points",
    METRICS_SQL
    + f"select dataset, {TECHNIQUE_LABEL} as technique_label, {MODEL_LABEL} as model_type_label,"
    f" {r6('precision_mean', 'precision_mean')}, {r6('sensitivity_mean', 'sensitivity_mean')} from metrics",
)
def _(spark, sf_dir):
    return rounded(A.tradeoff_points(metrics(spark, sf_dir)))


@query(
    "stability_boxplot",
    PER_SEED
    + f""", boxes as (select dataset, technique, model_type, count(*) as n,
        quantile_cont(balanced_accuracy, 0.25) as q1, quantile_cont(balanced_accuracy, 0.5) as median,
        quantile_cont(balanced_accuracy, 0.75) as q3 from per_seed group by all),
    fenced as (select *, q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from boxes),
    tested as (select f.*, s.balanced_accuracy as v, s.balanced_accuracy between low and high as inside
        from fenced f join per_seed s using (dataset, technique, model_type))
    select dataset, technique, model_type, n, {r6('q1', 'q1')}, {r6('median', 'median')}, {r6('q3', 'q3')},
        {r6('min(v) filter (where inside)', 'whisker_low')}, {r6('max(v) filter (where inside)', 'whisker_high')},
        count(*) filter (where not inside) as outliers
    from tested group by dataset, technique, model_type, n, q1, median, q3""",
)
def _(spark, sf_dir):
    return rounded(A.stability_boxplot(per_seed(spark, sf_dir)))


BEST = """, best as (select dataset, model_type, technique as best_technique, g_mean_mean as best_g_mean,
    balanced_accuracy_mean as best_balanced_acc from metrics where technique <> 'baseline'
    qualify row_number() over (partition by dataset, model_type order by g_mean_mean desc, technique) = 1)"""
PAIRED = (
    BEST
    + """, paired as (select m.dataset, m.model_type, g_mean_mean as baseline_g_mean,
    balanced_accuracy_mean as baseline_balanced_acc, best_technique, best_g_mean, best_balanced_acc
    from metrics m left join best b on m.dataset = b.dataset and m.model_type = b.model_type
    where m.technique = 'baseline')"""
)
PAIRED_COLUMNS = (
    f"dataset, model_type, {r6('baseline_g_mean', 'baseline_g_mean')},"
    f" {r6('baseline_balanced_acc', 'baseline_balanced_acc')}, best_technique,"
    f" {r6('best_g_mean', 'best_g_mean')}, {r6('best_balanced_acc', 'best_balanced_acc')}"
)


@query(
    "best_technique",
    METRICS_SQL.rstrip()
    + BEST
    + f" select dataset, model_type, best_technique, {r6('best_g_mean', 'best_g_mean')},"
    f" {r6('best_balanced_acc', 'best_balanced_acc')} from best",
)
def _(spark, sf_dir):
    return rounded(A.best_technique(metrics(spark, sf_dir)))


@query("baseline_vs_best", METRICS_SQL.rstrip() + PAIRED + f" select {PAIRED_COLUMNS} from paired")
def _(spark, sf_dir):
    return rounded(A.baseline_vs_best(metrics(spark, sf_dir)))


@query(
    "imbalance_impact",
    METRICS_SQL.rstrip()
    + PAIRED
    + f" select {PAIRED_COLUMNS}, {r6('best_g_mean - baseline_g_mean', 'g_mean_improvement')},"
    f" {r6('best_balanced_acc - baseline_balanced_acc', 'balanced_acc_improvement')} from paired"
    " order by paired.best_g_mean - paired.baseline_g_mean desc, dataset, model_type",
)
def _(spark, sf_dir):
    return rounded(A.imbalance_impact(metrics(spark, sf_dir)))


RATIO = """, classes as (select dataset, target, count(*) as n from predictions group by all),
    ratios as (select dataset, max(n) / min(n) as imbalance_ratio from classes group by dataset)"""


@query(
    "imbalance_points",
    METRICS_SQL.rstrip()
    + RATIO
    + f" select dataset, {TECHNIQUE_LABEL} as technique_label, {MODEL_LABEL} as model_type_label,"
    f" {r6('imbalance_ratio', 'imbalance_ratio')}, {r6('balanced_accuracy_mean', 'balanced_accuracy_mean')}"
    " from metrics join ratios using (dataset)",
)
def _(spark, sf_dir):
    runs = per_seed(spark, sf_dir)
    return rounded(A.imbalance_points(M.metrics_mean_std(runs), A.imbalance_ratios(runs)))


APPROACH = """, averaged as (select dataset, model_type, technique, avg(g_mean) as g_mean, avg(f1_score) as f1_score,
    avg(balanced_accuracy) as balanced_accuracy from per_seed group by all),
    approaches as (select *, case when technique = 'cs_svm' then 'Cost-Sensitive' else 'Resampling' end as approach
        from averaged where technique <> 'baseline'),
    best as (select * from approaches
        qualify row_number() over (partition by dataset, model_type, approach order by g_mean desc, technique) = 1)"""
APPROACH_COLUMNS = (
    f"dataset, model_type, technique, {r6('g_mean', 'g_mean')}, {r6('f1_score', 'f1_score')},"
    f" {r6('balanced_accuracy', 'balanced_accuracy')}, approach"
)


@query("best_per_approach", PER_SEED.rstrip() + APPROACH + f" select {APPROACH_COLUMNS} from best")
def _(spark, sf_dir):
    return rounded(A.best_per_approach(per_seed(spark, sf_dir)))


@query(
    "cs_vs_resampling",
    PER_SEED.rstrip()
    + APPROACH
    + f" select {APPROACH_COLUMNS} from best order by dataset, {ord_case('model_type', 'model_type')}, approach",
)
def _(spark, sf_dir):
    return rounded(A.cs_vs_resampling(per_seed(spark, sf_dir)))


@query(
    "cs_vs_resampling_bars",
    PER_SEED.rstrip()
    + f""", bars as (select dataset, technique, model_type, avg(balanced_accuracy) as bar,
        coalesce(stddev_samp(balanced_accuracy), 0) as sd from per_seed group by all)
    select dataset, {TECHNIQUE_LABEL} as technique_label, {MODEL_LABEL} as model_type_label, {r6('bar', 'bar')},
        {r6('bar - sd', 'bar_low')}, {r6('bar + sd', 'bar_high')} from bars""",
)
def _(spark, sf_dir):
    return rounded(A.cs_vs_resampling_bars(per_seed(spark, sf_dir)))


HEAT = ", ".join(r6(f"{m}_mean", f'"{m}"') for m in sorted(METRICS, key=lambda m: METRIC_LABELS[m]))


@query(
    "heatmap_matrix",
    METRICS_SQL + f"select dataset, concat(technique, ' / ', model_type) as technique_model, {HEAT} from metrics order by 1, 2",
)
def _(spark, sf_dir):
    return rounded(A.heatmap_matrix(metrics(spark, sf_dir)))


@query(
    "metrics_heatmap",
    METRICS_SQL
    + f"select dataset, concat({TECHNIQUE_LABEL}, ' / ', {MODEL_LABEL}) as technique_model, {HEAT} from metrics order by 1, 2",
)
def _(spark, sf_dir):
    return rounded(A.metrics_heatmap(metrics(spark, sf_dir)))


CELL = f"concat({trimmed_sql('balanced_accuracy_mean')}, ' ± ', coalesce({trimmed_sql('balanced_accuracy_std')}, 'n/a'))"
PIVOT = ", ".join(f"max({CELL}) filter (where dataset = '{d}') as {d}" for d in REAL_DATASETS)


@query("pivot_dataset", METRICS_SQL + f"select technique, model_type, {PIVOT} from metrics group by technique, model_type")
def _(spark, sf_dir):
    return A.pivot_dataset(metrics(spark, sf_dir))


@query(
    "cross_dataset",
    METRICS_SQL + f"select technique, {MODEL_LABEL} as model, {PIVOT} from metrics group by technique, model_type order by 1, 2",
)
def _(spark, sf_dir):
    return A.cross_dataset(metrics(spark, sf_dir))


@query(
    "cross_dataset_baseline",
    METRICS_SQL
    + f"select technique, {MODEL_LABEL} as model, {PIVOT} from metrics where technique = 'baseline' group by technique, model_type order by 1, 2",
)
def _(spark, sf_dir):
    return A.cross_dataset(metrics(spark, sf_dir), "baseline")


@query(
    "union_metrics",
    PER_SEED
    + f"select dataset, model_type, {r6('avg(g_mean)', 'g_mean')} from per_seed group by all"
    + f" union all select 'all' as dataset, model_type, {r6('avg(g_mean)', 'g_mean')} from per_seed group by model_type",
)
def _(spark, sf_dir):
    runs = per_seed(spark, sf_dir)
    by_dataset = runs.groupBy("dataset", "model_type").agg(F.avg("g_mean").alias("g_mean"))
    overall = runs.groupBy("model_type").agg(F.avg("g_mean").alias("g_mean")).withColumn("dataset", F.lit("all"))
    return rounded(by_dataset.unionByName(overall))


EVERY = f"predictions as ({SQL_PREDICTIONS})"
NEWEST = (
    f"every as ({SQL_OVERLAPPING}), predictions as (select * from every"
    " where (dataset, execution_id) in (select (dataset, max(execution_id)) from every group by dataset))"
)
ANALYSES = [
    "summary_table", "tradeoff_points", "stability_boxplot", "imbalance_impact", "imbalance_points",
    "cs_vs_resampling", "cs_vs_resampling_bars", "metrics_heatmap", "cross_dataset",
]


# All cells of all analyses, each with the number of its occurrences.
@query(
    "run_all",
    "select analysis, column_name, value, count(*) as n from ("
    + " union all ".join(long_sql(ORACLES[a].replace(EVERY, NEWEST), analysis=a) for a in ANALYSES)
    + ") group by all",
)
def _(spark, sf_dir):
    tables = A.run_all(overlapping_predictions(spark, sf_dir))
    cells = reduce(DataFrame.unionByName, [long_form(rounded(t), analysis=name) for name, t in tables.items()])
    return cells.groupBy("analysis", "column_name", "value").agg(F.count("*").alias("n"))


@query("newest_metrics", NEWEST_METRICS_SQL + f"select dataset, model_type, technique, {ROUND_MEANS} from metrics")
def _(spark, sf_dir):
    newest = A.of_execution(overlapping_predictions(spark, sf_dir))
    return rounded(M.metrics_mean_std(M.metrics_per_seed(newest)))


@query("filter_eq", cte(P) + "select dataset, model_type, seed, target, prediction from predictions where technique = 'baseline'")
def _(spark, sf_dir):
    stored = predictions(spark, sf_dir).where(F.col("technique") == "baseline")
    return stored.select("dataset", "model_type", "seed", "target", "prediction")


@query("filter_ne", cte(P) + "select technique, count(*) as n from predictions where technique <> 'baseline' group by technique")
def _(spark, sf_dir):
    treated = predictions(spark, sf_dir).where(F.col("technique") != "baseline")
    return treated.groupBy("technique").agg(F.count("*").alias("n"))


@query("lit_tag", cte(P) + "select dataset, count(*) as n, 'lineitem' as origin, 42 as seed from predictions group by dataset")
def _(spark, sf_dir):
    from ballast.operators.columns import tag

    counts = predictions(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("n"))
    return tag(counts, origin="lineitem", seed=42)


@query(
    "fill_nan_zero",
    cte(P, CONFUSION)
    + f"""select {KEYS}, {r6('case when "TP" + "FP" = 0 then 0.0 else "TP" / ("TP" + "FP") end', '"precision"')} from confusion""",
)
def _(spark, sf_dir):
    from ballast.functions.numeric import fill_nan_zero, ieee_divide

    counts = M.confusion_matrix(predictions(spark, sf_dir))
    precision = fill_nan_zero(ieee_divide(F.col("TP"), F.col("TP") + F.col("FP")))
    return rounded(counts.select(*M.SEED_KEYS, precision.alias("precision")))
