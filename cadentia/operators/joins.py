"""As-of and interval joins.

Both work on integer microseconds `us` and on time buckets, so a session that holds a large part of all
rows is shared by many tasks: an as-of join orders rows inside (session, bucket) and carries one row per
bucket over; an interval join meets rows and intervals bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def _meet(left: DataFrame, right: DataFrame, keys: list[str], payload: list[str], bucket_us: int, ahead: bool) -> DataFrame:
    """left (keys, us, ord, ...) plus back, the last right row at or before each row, and if `ahead` also ahead, the first one after it.

    Both tables are ordered together in (keys, bucket); the least and greatest right row of each bucket, one row a bucket, are
    carried to the buckets beside it.  Frames only look back, in one order or the other, so that their cost is linear."""
    bucket = F.floor(F.col("us") / F.lit(bucket_us)).alias("__bucket")
    extra = [c for c in left.columns if c not in {*keys, "us", "ord"}]
    hits = right.select(*keys, "us", "ord", bucket, F.lit(0).alias("__side"), F.struct("us", "ord", *payload).alias("__hit"))
    rows = left.select(*keys, "us", "ord", bucket, F.lit(1).alias("__side"), F.lit(None).cast(hits.schema["__hit"].dataType).alias("__hit"), F.struct(F.lit(0).alias("__own"), *extra).alias("__left"))
    rows = rows.unionByName(hits, allowMissingColumns=True)
    rank = F.when(F.col("__side") == 0, F.struct("us", "ord"))
    edges = rows.groupBy(*keys, "__bucket").agg(F.max_by("__hit", rank).alias("last"), F.min_by("__hit", rank).alias("first"))
    beside = Window.partitionBy(*keys)
    seen = lambda c, order, end: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, end))
    far = [seen("last", beside.orderBy("__bucket"), -1).alias("__far_back")]
    near = [seen("__hit", Window.partitionBy(*keys, "__bucket").orderBy("us", "__side", "ord"), 0).alias("__back")]
    if ahead:
        far.append(seen("first", beside.orderBy(F.col("__bucket").desc()), -1).alias("__far_ahead"))
        near.append(seen("__hit", Window.partitionBy(*keys, "__bucket").orderBy(F.desc("us"), F.desc("__side"), F.desc("ord")), 0).alias("__ahead"))
    both = rows.select("*", *near).filter("__side = 1").join(edges.select(*keys, "__bucket", *far), [*keys, "__bucket"])
    found = [F.coalesce(f"__{c}", f"__far_{c}").alias(f"__{c}") for c in (["back", "ahead"] if ahead else ["back"])]
    return both.select(*keys, "us", "ord", *(F.col("__left")[c].alias(c) for c in extra if c != "hit"), *found)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str] = ["session_id"], bucket_us: int = DAY, payload: list[str] = ["value"]) -> DataFrame:  # noqa: B006
    """left (keys, us, ord, ...) plus hit, the latest right row at or before each row: hit.us, hit.ord and its `payload`, or null.

    Of right rows with one time the last by ord counts.  A column hit of left is replaced."""
    return _meet(left, right, keys, payload, bucket_us, False).withColumnRenamed("__back", "hit")


def asof_nearest(left: DataFrame, right: DataFrame, tolerance_us: int | None = None, keys: list[str] = ["session_id"], bucket_us: int = DAY, payload: list[str] = ["value"]) -> DataFrame:  # noqa: B006
    """left (keys, us, ord, ...) plus hit, the nearest right row; ties go to the earlier one; of equal earlier times the last
    by ord, of equal later times the first.  Rows without one inside the tolerance are dropped.  A column hit of left is replaced."""
    both = _meet(left, right, keys, payload, bucket_us, True)
    back, ahead = F.col("__back"), F.col("__ahead")
    hit = F.when(back.isNull() | (ahead["us"] - F.col("us") < F.col("us") - back["us"]), ahead).otherwise(back)
    out = both.withColumn("hit", hit).drop("__back", "__ahead").filter("hit IS NOT NULL")
    return out if tolerance_us is None else out.filter(F.abs(F.col("hit.us") - F.col("us")) <= tolerance_us)


def within(samples: DataFrame, intervals: DataFrame, keys: list[str] = ["session_id"], bucket_us: int = DAY, how: str = "inner") -> DataFrame:  # noqa: B006
    """samples joined with the intervals (keys, idx, low_us, high_us, ...) that hold them, both ends included."""
    spread = intervals.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low_us") / F.lit(bucket_us)), F.floor(F.col("high_us") / F.lit(bucket_us)))))
    own = samples.withColumn("bucket", F.floor(F.col("us") / F.lit(bucket_us)))
    held = [own[k] == spread[k] for k in [*keys, "bucket"]] + [own["us"].between(spread["low_us"], spread["high_us"])]
    joined = own.join(spread, held, how)
    for k in [*keys, "bucket"]:
        joined = joined.drop(spread[k])
    return joined.drop("bucket")


def label_samples(samples: DataFrame, intervals: DataFrame, keys: list[str] = ["session_id"], bucket_us: int = DAY) -> DataFrame:  # noqa: B006
    """samples (with a unique `ord` in the keys) plus label: of the intervals that hold a row, the last by idx; else ''."""
    named = within(samples, intervals, keys, bucket_us).groupBy(*keys, "ord").agg(F.max_by("label", "idx").alias("label"))
    return samples.join(named, [*keys, "ord"], "left").withColumn("label", F.coalesce("label", F.lit("")))


def overlap(left: DataFrame, right: DataFrame, keys: list[str], low: tuple[str, str], high: tuple[str, str]) -> DataFrame:
    """left joined with right where the spans [low[0], high[0]] and [low[1], high[1]] have a point in common, ends included; names must differ.

    Spans meet in buckets whose width is, for each key, the mean length of its spans or their mean distance, if that is more: so
    a span lies in few of them, and a bucket has few spans that do not overlap.  A pair is reported by the bucket in which the
    later of its spans begins.  Spans that end before they begin meet nothing."""
    sides = []
    for rows, a, b in ((left, low[0], high[0]), (right, low[1], high[1])):
        sides.append(rows.filter(F.col(b) >= F.col(a)).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b")))
    named = [f"__{k}" for k in keys]
    wide = sides[0].unionByName(sides[1]).groupBy(*named).agg(F.greatest(F.avg(F.col("__b") - F.col("__a")), (F.max("__b") - F.min("__a")) / F.count("*"), F.lit(1e-6)).alias("__width"))
    bucket = lambda x: F.floor(F.col(x) / F.col("__width"))
    spread = []
    for rows, a, b, name in ((left, low[0], high[0], "__left"), (right, low[1], high[1], "__right")):
        at = rows.filter(F.col(b) >= F.col(a)).join(wide, [rows[k] == wide[f"__{k}"] for k in keys]).withColumn(name, F.explode(F.sequence(bucket(a), bucket(b))))
        spread.append(at.drop(*named))
    a, b = spread[0], spread[1].drop("__width").withColumnsRenamed({k: f"__{k}" for k in keys})
    met = a.join(b, [*(a[k] == b[f"__{k}"] for k in keys), F.col("__left") == F.col("__right")])
    both = (F.col(low[0]) <= F.col(high[1])) & (F.col(high[0]) >= F.col(low[1]))
    owner = F.floor(F.greatest(low[0], low[1]) / F.col("__width")) == F.col("__left")
    return met.filter(both & owner).drop(*named, "__left", "__right", "__width")


def held(points: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """points joined with the spans (keys, low, high, ...) that hold the number `at`, both ends included.

    For each key, time is cut into buckets of the spans' mean length; a span is copied into the few it touches and a point
    lies in one, so points meet no span of their key but those beside them.  The table of spans alone tells the width."""
    named = [f"__{k}" for k in keys]
    wide = spans.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.greatest(F.avg(F.col(high) - F.col(low)), F.lit(1e-6)).alias("__width"))
    bucket = lambda x: F.floor(F.col(x) / F.col("__width"))
    spread = spans.filter(F.col(high) >= F.col(low)).join(wide, [spans[k] == wide[f"__{k}"] for k in keys]).drop(*named)
    spread = spread.withColumn("__bucket", F.explode(F.sequence(bucket(low), bucket(high)))).drop("__width").withColumnsRenamed({k: f"__{k}" for k in keys})
    own = points.join(wide, [points[k] == wide[f"__{k}"] for k in keys]).withColumn("__place", bucket(at)).drop(*named, "__width")
    met = own.join(spread, [*(own[k] == spread[f"__{k}"] for k in keys), F.col("__place") == F.col("__bucket"), F.col(at).between(F.col(low), F.col(high))])
    return met.drop(*named, "__place", "__bucket")


def visible(intervals: DataFrame, views: DataFrame) -> DataFrame:
    """intervals joined with the views (session_id, view_idx, from_us, to_us) that show some of them: begun before the view ends, and
    ended after it begins."""
    met = overlap(intervals, views.select("session_id", "view_idx", "from_us", "to_us"), ["session_id"], ("low_us", "from_us"), ("high_us", "to_us"))
    return met.filter("low_us < to_us AND high_us > from_us")


def overlapping(intervals: DataFrame) -> DataFrame:
    """Pairs a_idx < b_idx of a session's intervals that overlap strictly."""
    a = intervals.select("session_id", F.col("idx").alias("a_idx"), F.col("low_us").alias("a_low"), F.col("high_us").alias("a_high"))
    b = intervals.select("session_id", F.col("idx").alias("b_idx"), F.col("low_us").alias("b_low"), F.col("high_us").alias("b_high"))
    met = overlap(a, b, ["session_id"], ("a_low", "b_low"), ("a_high", "b_high"))
    return met.filter("a_idx < b_idx AND a_low < b_high AND a_high > b_low").select("session_id", "a_idx", "b_idx")
