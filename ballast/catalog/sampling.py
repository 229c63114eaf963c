"""Splits, folds, weights, neighbours and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.catalog.bindings import (
    SQL_EMBEDDINGS,
    SQL_EVENTS,
    SQL_LABELLED,
    embeddings,
    events,
    labelled,
)
from ballast.catalog.columns import over
from ballast.catalog.registry import ORACLES, query, r6, rounded
from ballast.operators import sampling as S
from ballast.operators.knn import knn_join, tomek_links
from ballast.operators.splitting import count_classes, stratified_kfold, stratified_split

SEED = 7


def order_sql(seed: str | int = SEED) -> str:
    return f"md5(concat('{seed}:', cast(row_id as string)))"


RANKED = f"select *, row_number() over (partition by target order by {order_sql()}) as rn, count(*) over (partition by target) as n from raw"


@query(
    "stratified_split",
    over(SQL_EVENTS, f"select row_id, target, case when rn <= floor(0.3 * n + 0.5) then 'test' else 'train' end as split from ({RANKED})"),
)
def _(spark, sf_dir):
    return stratified_split(events(spark, sf_dir), SEED).select("row_id", "target", "split")


@query(
    "stratified_kfold",
    over(SQL_EVENTS, f"select row_id, target, cast(ntile(5) over (partition by target order by {order_sql()}) - 1 as int) as fold from raw"),
)
def _(spark, sf_dir):
    return stratified_kfold(events(spark, sf_dir), SEED).select("row_id", "target", "fold")


@query(
    "random_under_sample",
    over(SQL_EVENTS, f"select row_id, target from (select *, min(n) over () as least from ({RANKED})) where rn <= least"),
)
def _(spark, sf_dir):
    return S.random_under_sample(events(spark, sf_dir), SEED).select("row_id", "target")


@query(
    "random_under_sample_labels",
    over(SQL_LABELLED, f"select row_id, target from (select *, min(n) over () as least from ({RANKED})) where rn <= least"),
)
def _(spark, sf_dir):
    return S.random_under_sample(labelled(spark, sf_dir), SEED).select("row_id", "target")


@query(
    "class_weights",
    over(
        SQL_EVENTS,
        "select row_id, target, cast(1 as double) as weight_none, round(count(*) over () / (2 * count(*) over (partition by target)), 6) as weight_balanced,"
        " cast(case when target = 1 then 5 else 1 end as double) as weight_5, cast(case when target = 1 then 10 else 1 end as double) as weight_10 from raw",
    ),
)
def _(spark, sf_dir):
    df = events(spark, sf_dir)
    counts = count_classes(df)
    names = ["weight_none", "weight_balanced", "weight_5", "weight_10"]
    weights = [S.weight_expression(counts, rule).alias(n) for rule, n in zip(S.COST_GRID, names)]
    return rounded(df.select("row_id", "target", *weights))


# Brute force is the check, not the method: every pair, then the nearest per row.
PAIRS = """pairs as (select a.row_id, a.target, b.row_id as neighbor_id, b.target as neighbor_target,
    list_distance(a.x, b.x) as distance from points a join points b on a.row_id <> b.row_id),
near as (select *, row_number() over (partition by row_id order by distance, neighbor_id) as rank from pairs)"""


@query(
    "knn_join",
    f"with points as ({SQL_EMBEDDINGS}), {PAIRS} select row_id, rank, neighbor_id, {r6('distance', 'distance')} from near where rank <= 3",
)
def _(spark, sf_dir):
    return rounded(knn_join(embeddings(spark, sf_dir), 3))


SMALL_BLOCKS = 64  # rows of a block where a query shall have many of them


@query("knn_join_blocks", ORACLES["knn_join"])
def _(spark, sf_dir):
    return rounded(knn_join(embeddings(spark, sf_dir), 3, block_rows=SMALL_BLOCKS))


@query("knn_join_levels", ORACLES["knn_join"])
def _(spark, sf_dir):
    return rounded(knn_join(embeddings(spark, sf_dir), 3, block_rows=SMALL_BLOCKS // 4, max_pivots=4))


LINKS = f"""with points as ({SQL_EMBEDDINGS}), {PAIRS}, first as (select * from near where rank = 1)
select a.row_id as low_id, b.row_id as high_id, {r6('a.distance', 'distance')} from first a
join first b on a.neighbor_id = b.row_id and b.neighbor_id = a.row_id
where a.row_id < b.row_id and a.target <> b.target"""


@query("tomek_links", LINKS)
def _(spark, sf_dir):
    return rounded(tomek_links(embeddings(spark, sf_dir)))


@query("tomek_links_blocks", LINKS)
def _(spark, sf_dir):
    return rounded(tomek_links(embeddings(spark, sf_dir), block_rows=SMALL_BLOCKS))


# Two numbers per event keep brute force out of reach and pruning at work.
@query("knn_join_events")
def _(spark, sf_dir):
    points = events(spark, sf_dir).select("row_id", F.array("value", F.col("user_id").cast("double")).alias("x"))
    return rounded(knn_join(points, 3))


MADE = f"""with points as ({SQL_EMBEDDINGS}),
sizes as (select count(*) filter (where target = 0) as most, count(*) filter (where target = 1) as n from points),
few as (select * from points where target = 1),
pairs as (select a.row_id, b.row_id as neighbor_id, a.x as x, b.x as y, list_distance(a.x, b.x) as distance
    from few a join few b on a.row_id <> b.row_id),
near as (select *, row_number() over (partition by row_id order by distance, neighbor_id) as rank from pairs),
bases as (select row_id, (most - n) // n + case when row_number() over (order by md5(concat('{SEED}:extra:', cast(row_id as string))))
    <= (most - n) % n then 1 else 0 end as copies from few, sizes),
copies as (select row_id, unnest(range(copies)) as copy from bases),
drawn as (select row_id, copy, md5(concat('{SEED}:', cast(row_id as string), ':', cast(copy as string))) as digest from copies),
made as (select d.row_id as base_id, d.copy, n.neighbor_id,
    cast(concat('0x', substr(digest, 9, 8)) as bigint) / 4294967296 as fraction, n.x, n.y
    from drawn d join near n on n.row_id = d.row_id and n.rank = 1 + cast(concat('0x', substr(digest, 1, 8)) as bigint) % 3)"""


@query(
    "smote",
    MADE
    + f""", longer as (select base_id, copy, neighbor_id, fraction, unnest(range(len(x))) as dim,
        unnest(x) as a, unnest(y) as b from made)
    select base_id, copy, neighbor_id, dim, {r6('a + fraction * (b - a)', 'value')} from longer""",
)
def _(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    counts = count_classes(points)
    made = S.smote_samples(points.where("target = 1"), counts[0] - counts[1], SEED)
    return rounded(made.select("base_id", "copy", "neighbor_id", F.posexplode("x").alias("dim", "value")))


@query(
    "smote_balance",
    MADE
    + """ select target, count(*) as n, 0 as synthetic from points group by target
    union all select 1 as target, count(*) as n, 1 as synthetic from made""",
)
def _(spark, sf_dir):
    filled = S.smote(embeddings(spark, sf_dir), SEED)
    return filled.groupBy("target", F.col("synthetic").cast("int").alias("synthetic")).agg(F.count("*").alias("n"))


FILLED = """, filled as (select cast(row_id as string) as row_id, target, x from points
    union all select concat(cast(base_id as string), '#', cast(copy as string)), 1,
        [p[1] + fraction * (p[2] - p[1]) for p in list_zip(x, y)] from made)"""


@query(
    "smote_tomek",
    MADE
    + FILLED
    + """, all_pairs as (select a.row_id, a.target, b.row_id as other, list_distance(a.x, b.x) as distance
        from filled a join filled b on a.row_id <> b.row_id),
    first as (select * from all_pairs qualify row_number() over (partition by row_id order by distance, other) = 1),
    linked as (select a.row_id from first a join first b on a.other = b.row_id and b.other = a.row_id where a.target <> b.target)
    select row_id, target from filled where row_id not in (select row_id from linked)""",
)
def _(spark, sf_dir):
    return S.smote_tomek(embeddings(spark, sf_dir), SEED).select("row_id", "target")


@query("smote_tomek_blocks", ORACLES["smote_tomek"])
def _(spark, sf_dir):
    return S.smote_tomek(embeddings(spark, sf_dir), SEED, block_rows=SMALL_BLOCKS).select("row_id", "target")
