"""Running windows over long sessions: work inside buckets of time, with one row a bucket carried over.

A window over a whole session orders all of its rows in one task.  Here a session is cut into buckets of about
BUCKET_ROWS rows; each is ordered by itself, and what a row needs of the rows before its bucket comes from one summary a
bucket (its last row, its sums), put in order in a small window.  Frames of a bounded reach get the rows beside a block's edges
copied instead (`with_halo`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 100_000


def with_buckets(rows: DataFrame, keys: list[str], at: str = "us", rows_each: int | None = None) -> DataFrame:
    """rows plus __bucket, which ascends with the number `at` inside the keys: equal spans of `at`, so many that one holds `rows_each`
    rows (BUCKET_ROWS) on average.  Spark joins the table of spans, a row for each key, by its measured size."""
    most = rows_each or BUCKET_ROWS
    wide = rows.groupBy(*keys).agg(F.min(at).alias("__first"), F.greatest(F.ceil((F.max(at) - F.min(at) + 1) * most / F.count("*")), F.lit(1)).alias("__width"))
    return rows.join(wide, keys).withColumn("__bucket", F.floor((F.col(at) - F.col("__first")) / F.col("__width"))).drop("__first", "__width")


def along(
    rows: DataFrame, keys: list[str], order: list[str], lags: dict[str, str] = {}, leads: dict[str, str] = {}, sums: dict[str, Column] = {},  # noqa: B006
    back: dict[str, str] = {}, ahead: dict[str, str] = {}, rows_each: int | None = None,  # noqa: B006
) -> DataFrame:
    """rows plus, by name, what windows over the keys in `order` (columns without nulls, a number first) would give:

    lags, leads: a column of the row before or after; sums: the sum of an expression up to and with the row; back, ahead: the last
    known value of a column up to the row, and the first from the row on."""
    rows = with_buckets(rows, keys, order[0], rows_each)
    group, rank = [*keys, "__bucket"], F.struct(*order)
    here = Window.partitionBy(*group).orderBy(*order)
    here_down = Window.partitionBy(*group).orderBy(*map(F.desc, order))
    up, down = Window.partitionBy(*keys).orderBy("__bucket"), Window.partitionBy(*keys).orderBy(F.desc("__bucket"))
    before = lambda w, end: w.rowsBetween(Window.unboundedPreceding, end)
    near: dict[str, Column] = {}
    edge: dict[str, Column] = {}
    far: dict[str, Column] = {}
    out: dict[str, Column] = {}
    for k, (name, c) in enumerate(lags.items()):
        near[f"__n{k}"], edge[f"__e{k}"], far[f"__f{k}"] = F.lag(F.struct(c)).over(here), F.max_by(F.struct(c), rank), F.lag(f"__e{k}").over(up)
        out[name] = F.coalesce(f"__n{k}", f"__f{k}")[c]
    for k, (name, c) in enumerate(leads.items(), 100):
        near[f"__n{k}"], edge[f"__e{k}"], far[f"__f{k}"] = F.lead(F.struct(c)).over(here), F.min_by(F.struct(c), rank), F.lead(f"__e{k}").over(up)
        out[name] = F.coalesce(f"__n{k}", f"__f{k}")[c]
    for k, (name, c) in enumerate(sums.items(), 200):
        near[f"__n{k}"], edge[f"__e{k}"], far[f"__f{k}"] = F.sum(c).over(before(here, 0)), F.sum(c), F.sum(f"__e{k}").over(before(up, -1))
        out[name] = F.coalesce(f"__n{k}", F.lit(0)) + F.coalesce(f"__f{k}", F.lit(0))
    for k, (name, c) in enumerate(back.items(), 300):
        near[f"__n{k}"], edge[f"__e{k}"] = F.last(c, ignorenulls=True).over(before(here, 0)), F.max_by(c, F.when(F.col(c).isNotNull(), rank))
        far[f"__f{k}"] = F.last(f"__e{k}", ignorenulls=True).over(before(up, -1))
        out[name] = F.coalesce(f"__n{k}", f"__f{k}")
    for k, (name, c) in enumerate(ahead.items(), 400):
        # Backwards, as a frame that ends with the group is summed anew for each row.
        near[f"__n{k}"], edge[f"__e{k}"] = F.last(c, ignorenulls=True).over(before(here_down, 0)), F.min_by(c, F.when(F.col(c).isNotNull(), rank))
        far[f"__f{k}"] = F.last(f"__e{k}", ignorenulls=True).over(before(down, -1))
        out[name] = F.coalesce(f"__n{k}", f"__f{k}")
    edges = rows.groupBy(*group).agg(*(c.alias(n) for n, c in edge.items()))
    carried = edges.select(*group, *(c.alias(n) for n, c in far.items()))
    both = rows.select("*", *(c.alias(n) for n, c in near.items())).join(carried, group)
    kept = [c for c in rows.columns if c != "__bucket" and c not in out]
    return both.select(*kept, *(c.alias(n) for n, c in out.items()))


def with_halo(rows: DataFrame, at: Column, width: Column | int, back: Column | int, ahead: Column | int) -> DataFrame:
    """rows plus __block, floor(at / width), and __own: each row once in its block (__own true), and copies (__own false) in the other
    blocks that have places less than `ahead` before it or less than `back` after it.

    For every own row a block then holds all rows from `back` before it to `ahead` after it, so frames inside the block are whole."""
    block = lambda x: F.floor(x / width)
    rows = rows.withColumn("__home", block(at)).withColumn("__block", F.explode(F.sequence(block(at - ahead), block(at + back))))
    return rows.withColumn("__own", F.col("__block") == F.col("__home")).drop("__home")


def quantile(rows: DataFrame, keys: list[str], value: str, q: float, name: str, accuracy: int = 10_000) -> DataFrame:
    """keys and the exact quantile of a column, between ranks by interpolation, as percentile() gives it, null without values.

    percentile() holds all distinct values of a group at once.  Here a sketch of bounded size finds two values that the
    quantile lies between for certain; the second pass counts what is below, and orders only the values between them, about
    6 / accuracy of the group; groups of no more than `accuracy` values are ordered whole."""
    some = rows.select(*keys, F.col(value).cast("double").alias("__v"))
    near = [max(q - 3 / accuracy, 0.0), min(q + 3 / accuracy, 1.0)]
    ends = some.groupBy(*keys).agg(F.percentile_approx("__v", near, accuracy).alias("__ends"), F.count("__v").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    few = F.col("__n") <= accuracy  # a share of 1 / accuracy is less than one value
    low = F.when(few | F.lit(near[0] == 0.0), F.col("__low")).otherwise(F.col("__ends")[0])
    high = F.when(few | F.lit(near[1] == 1.0), F.col("__high")).otherwise(F.col("__ends")[1])
    every = ends.select(*keys)
    ends = ends.select(*keys, low.alias("__from"), high.alias("__to"), ((F.col("__n") - 1) * q).alias("__rank"))
    placed = some.join(ends, keys).filter(F.col("__v") <= F.col("__to"))
    # All that is below is one value, null, which comes first.
    counts = placed.groupBy(*keys, F.when(F.col("__v") >= F.col("__from"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__here"), F.first("__rank").alias("__rank"))
    so_far = F.sum("__here").over(Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("__end", so_far)
    holds = lambda r: F.max(F.when((r >= F.col("__end") - F.col("__here")) & (r < F.col("__end")), F.col("__v")))
    below, above = F.floor("__rank"), F.ceil("__rank")
    both = ranked.groupBy(*keys).agg(holds(below).alias("__a"), holds(above).alias("__b"), F.first("__rank").alias("__rank"))
    share = F.col("__rank") - F.floor("__rank")
    found = both.select(*keys, F.when(share == 0, F.col("__a")).otherwise(F.col("__a") * (1 - share) + F.col("__b") * share).alias(name))
    return every.join(found, keys, "left")
