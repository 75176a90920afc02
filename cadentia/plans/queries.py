"""One query per operator over the driver's tables, and its SQL.

Times are integer microseconds; doubles are rounded on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadentia.functions import scalars
from cadentia.operators import alignment, applied, beats, boxes, intervals, joins, offsets, rates, records, segments, sync, waveforms
from cadentia.plans import tables as t
from cadentia.sources import sensors, sessions

HOURS = 3_600_000_000
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def on_signals(views: str, rest: str) -> str:
    named = {"A": t.ANCHORS, "I": t.INTERVALS}
    return "WITH " + ", ".join([t.SIGNALS, *(named[v] for v in views)]) + " " + rest


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query(on_signals("AI", """
SELECT i.session_id, i.idx, i.label, s.sensor_id, count(*) AS n, round(avg(s.value), 6) AS mean_value
FROM signals s JOIN intervals i ON s.session_id = i.session_id AND s.us BETWEEN i.low_us AND i.high_us
JOIN anchors a ON a.session_id = s.session_id AND s.us BETWEEN a.anchor_us AND a.anchor_us + a.duration_us GROUP BY ALL"""))
def segment_means(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    held = joins.within(sync.clip_to_session(s, t.anchors(s)), t.intervals(s))
    return rounded(held.groupBy("session_id", "idx", "label", "sensor_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


@query(on_signals("AI", "SELECT s.session_id, s.ord, i.idx FROM signals s JOIN intervals i ON s.session_id = i.session_id AND s.us BETWEEN i.low_us AND i.high_us"))
def slice_by_interval(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return joins.within(s, t.intervals(s)).select("session_id", "ord", "idx")


@query(on_signals("A", "SELECT s.session_id, s.ord FROM signals s JOIN anchors a USING (session_id) WHERE us BETWEEN anchor_us AND anchor_us + duration_us"))
def clip_to_session(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return sync.clip_to_session(s, t.anchors(s)).select("session_id", "ord")


@query(on_signals("A", "SELECT session_id, ord, round((us - anchor_us) / 1e6, 6) AS video_sec FROM signals JOIN anchors USING (session_id)"))
def video_time(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return rounded(sync.video_time(s, t.anchors(s)).select("session_id", "ord", "video_sec"))


FILLED = """grid AS (SELECT * FROM (SELECT DISTINCT session_id, us FROM signals) JOIN (SELECT DISTINCT session_id, sensor_id FROM signals) USING (session_id)),
firsts AS (SELECT session_id, us, sensor_id, arg_min(value, ord) AS value FROM signals GROUP BY ALL),
filled AS (
  SELECT g.session_id, g.us, g.sensor_id, coalesce(last_value(f.value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(f.value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
  FROM grid g LEFT JOIN firsts f USING (session_id, us, sensor_id) WINDOW w AS (PARTITION BY session_id, sensor_id ORDER BY us))"""


@query("WITH " + t.SIGNALS + ", " + FILLED + " SELECT * FROM filled")
def fill_signals(spark, sf_dir):
    return sync.fill_signals(t.signals(spark, sf_dir))


@query("WITH " + t.SIGNALS + ", " + FILLED + " SELECT session_id, us, round(avg(value), 6) AS averaged FROM filled GROUP BY ALL")
def with_average(spark, sf_dir):
    return rounded(sync.with_average(sync.fill_signals(t.signals(spark, sf_dir))))


@query("WITH " + t.SIGNALS + ", " + FILLED + """ SELECT session_id, us, max(value) FILTER (sensor_id = 'click') AS click, max(value) FILTER (sensor_id = 'view') AS view,
  max(value) FILTER (sensor_id = 'signup') AS signup FROM filled GROUP BY ALL""")
def wide_signals(spark, sf_dir):
    return sync.wide(sync.fill_signals(t.signals(spark, sf_dir)), ["click", "view", "signup"])


@query("WITH " + t.SIGNALS + " SELECT session_id, sensor_id, us, arg_min(coalesce(aux, -1), ord) AS aux FROM signals GROUP BY ALL")
def dedupe_aux(spark, sf_dir):
    return sync.dedupe_aux(t.signals(spark, sf_dir)).withColumn("aux", F.coalesce("aux", F.lit(-1)))


@query("WITH " + t.SIGNALS + ", " + FILLED + """, own AS (SELECT DISTINCT session_id, us, sensor_id FROM signals WHERE aux IS NOT NULL),
rows AS (SELECT f.*, o.us IS NOT NULL AS own, bool_or(o.us IS NOT NULL) OVER (PARTITION BY f.session_id, f.sensor_id) AS sensor_aux,
  bool_or(o.us IS NOT NULL) OVER (PARTITION BY f.session_id, f.us) AS any_now, bool_or(o.us IS NOT NULL) OVER (PARTITION BY f.session_id) AS any_aux
  FROM filled f LEFT JOIN own o ON o.session_id = f.session_id AND o.us = f.us AND o.sensor_id = f.sensor_id),
kept AS (SELECT *, CASE WHEN sensor_aux THEN own WHEN any_aux THEN NOT any_now ELSE value IS NOT NULL END AS keep FROM rows),
marked AS (SELECT *, bool_or(keep) OVER (PARTITION BY session_id, sensor_id) AS has_rows FROM kept)
SELECT session_id, us, sensor_id, value FROM marked WHERE CASE WHEN has_rows THEN keep ELSE value IS NOT NULL END""")
def native_rows(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return sync.native_rows(sync.fill_signals(s), sync.dedupe_aux(s))


NEAREST = f"""hits AS (
  SELECT l.session_id, l.ord, l.us, l.value AS reference, r.ord AS hit_ord, r.value AS estimate,
    row_number() OVER (PARTITION BY l.ord ORDER BY abs(r.us - l.us), r.us, CASE WHEN r.us <= l.us THEN -r.ord ELSE r.ord END) AS place
  FROM signals l JOIN signals r ON l.session_id = r.session_id AND l.sensor_id = 'view' AND r.sensor_id = 'click' AND abs(r.us - l.us) <= {6 * HOURS}),
pairs AS (SELECT * FROM hits WHERE place = 1)"""


def _nearest(spark, sf_dir, tolerance=6 * HOURS):
    s = t.signals(spark, sf_dir)
    left, right = s.filter("sensor_id = 'view'"), s.filter("sensor_id = 'click'")
    return joins.asof_nearest(left.select("session_id", "us", "ord", "value"), right, tolerance)


@query("WITH " + t.SIGNALS + ", " + NEAREST + " SELECT session_id, ord, hit_ord, estimate FROM pairs")
def asof_nearest(spark, sf_dir):
    return _nearest(spark, sf_dir).select("session_id", "ord", F.col("hit.ord").alias("hit_ord"), F.col("hit.value").alias("estimate"))


@query("WITH " + t.SIGNALS + ", " + NEAREST + """ SELECT session_id, count(*) AS n, round(avg(abs(estimate - reference)), 6) AS mae, round(sqrt(avg((estimate - reference) ** 2)), 6) AS rmse,
  round(avg(estimate - reference), 6) AS bias, round(corr(estimate, reference), 6) AS r FROM pairs GROUP BY session_id HAVING count(*) > 2""")
def agreement(spark, sf_dir):
    pairs = _nearest(spark, sf_dir).select("session_id", F.col("value").alias("reference"), F.col("hit.value").alias("estimate"))
    return rounded(beats.agreement(pairs).filter("n > 2"))


@query("WITH " + t.SIGNALS + """ SELECT l.session_id, l.ord, arg_max(r.ord, struct_pack(a := r.us, b := r.ord)) AS hit_ord FROM signals l JOIN signals r
  ON l.session_id = r.session_id AND r.us <= l.us AND r.sensor_id = 'click' WHERE l.sensor_id = 'view' GROUP BY ALL""")
def asof_backward(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return joins.asof_backward(s.filter("sensor_id = 'view'"), s.filter("sensor_id = 'click'")).select("session_id", "ord", F.col("hit.ord").alias("hit_ord")).filter("hit_ord IS NOT NULL")


@query(on_signals("AI", "SELECT s.session_id, s.ord, coalesce(arg_max(i.label, i.idx), '') AS label FROM signals s LEFT JOIN intervals i ON s.session_id = i.session_id AND s.us BETWEEN i.low_us AND i.high_us GROUP BY ALL"))
def label_samples(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return joins.label_samples(s, t.intervals(s)).select("session_id", "ord", "label")


@query(on_signals("AI", f""", wide AS (SELECT session_id, idx, low_us, high_us + {24 * HOURS} AS high_us FROM intervals)
SELECT a.session_id, a.idx AS a_idx, b.idx AS b_idx FROM wide a JOIN wide b ON a.session_id = b.session_id AND a.idx < b.idx AND a.low_us < b.high_us AND a.high_us > b.low_us"""))
def overlapping(spark, sf_dir):
    return joins.overlapping(t.intervals(t.signals(spark, sf_dir)).withColumn("high_us", F.col("high_us") + 24 * HOURS))


#: Every interval, ended after a third of its length, so that there is room between them.
ROOMY = ", roomy AS (SELECT session_id, idx, label, start_sec, start_sec + (end_sec - start_sec) / 3 AS end_sec FROM intervals)"


def _roomy(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return s, t.intervals(s).withColumn("end_sec", F.col("start_sec") + (F.col("end_sec") - F.col("start_sec")) / 3)


@query(on_signals("AI", ROOMY + """ SELECT session_id, idx, round(coalesce(max(end_sec) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS low_sec,
  round(coalesce(min(start_sec) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1728000), 6) AS high_sec FROM roomy WINDOW w AS (PARTITION BY session_id ORDER BY start_sec, idx)"""))
def neighbour_limits(spark, sf_dir):
    s, own = _roomy(spark, sf_dir)
    return rounded(intervals.neighbour_limits(own, t.anchors(s).select("session_id", (F.col("duration_us") / 1e6).alias("duration_sec"))))


@query(on_signals("AI", """SELECT session_id, idx, part, label || '_part' || part AS label, round(start_sec + (part - 1) * (end_sec - start_sec) / 4, 8) AS start_sec,
  round(least(end_sec, start_sec + part * (end_sec - start_sec) / 4), 8) AS end_sec FROM intervals, (SELECT unnest([1, 2, 3, 4])::INT AS part) WHERE (end_sec - start_sec) / 4 >= 0.01"""))
def subdivide_count(spark, sf_dir):
    return rounded(intervals.subdivide(t.intervals(t.signals(spark, sf_dir)), count=4), 8)


@query(on_signals("AI", """, n AS (SELECT *, ceil((end_sec - start_sec) / 36000)::INT AS parts FROM intervals),
p AS (SELECT *, unnest(range(1, greatest(parts, 1) + 1))::INT AS part FROM n)
SELECT session_id, idx, part, CASE WHEN parts < 2 THEN label ELSE label || '_part' || part END AS label, round(CASE WHEN parts < 2 THEN start_sec ELSE start_sec + (part - 1) * 36000 END, 8) AS start_sec,
  round(CASE WHEN parts < 2 THEN end_sec ELSE least(end_sec, start_sec + part * 36000) END, 8) AS end_sec FROM p WHERE parts < 2 OR least(end_sec, start_sec + part * 36000) - (start_sec + (part - 1) * 36000) >= 0.01"""))
def subdivide_seconds(spark, sf_dir):
    return rounded(intervals.subdivide(t.intervals(t.signals(spark, sf_dir)), seconds=36000.0), 8)


@query(on_signals("AI", """, c AS (SELECT i.session_id, i.idx, min((s.us - a.anchor_us) / 1e6) AS at_sec FROM intervals i JOIN anchors a USING (session_id) JOIN signals s ON s.session_id = i.session_id AND s.sensor_id = 'error'
  WHERE (s.us - a.anchor_us) / 1e6 - start_sec >= 0.5 AND end_sec - (s.us - a.anchor_us) / 1e6 >= 0.5 GROUP BY ALL)
SELECT i.session_id, i.idx, label, part, round(CASE WHEN part = 1 THEN at_sec ELSE start_sec END, 6) AS start_sec, round(CASE WHEN part = 0 AND at_sec IS NOT NULL THEN at_sec ELSE end_sec END, 6) AS end_sec
FROM intervals i LEFT JOIN c ON c.session_id = i.session_id AND c.idx = i.idx, (SELECT unnest([0, 1])::INT AS part) WHERE part = 0 OR at_sec IS NOT NULL"""))
def split_at(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    cuts = s.filter("sensor_id = 'error'").join(t.anchors(s), "session_id").select("session_id", ((F.col("us") - F.col("anchor_us")) / 1e6).alias("at_sec"))
    return rounded(intervals.split_at(t.intervals(s), cuts))


@query(on_signals("AI", ROOMY + """, c AS (SELECT s.session_id, s.ord AS cand, round(least((us - anchor_us) / 1e6, (us - anchor_us) / 1e6 + k * 3600 - 180000), 3) AS start_sec, round(greatest((us - anchor_us) / 1e6, (us - anchor_us) / 1e6 + k * 3600 - 180000), 3) AS end_sec
  FROM signals s JOIN anchors USING (session_id) WHERE sensor_id = 'click')
SELECT session_id, cand, start_sec, end_sec FROM c WHERE end_sec - start_sec >= 0.5 AND NOT EXISTS (SELECT 1 FROM roomy i WHERE i.session_id = c.session_id AND c.start_sec < i.end_sec AND c.end_sec > i.start_sec)"""))
def validate_new(spark, sf_dir):
    s, own = _roomy(spark, sf_dir)
    at = (F.col("us") - F.col("anchor_us")) / 1e6
    cand = s.filter("sensor_id = 'click'").join(t.anchors(s), "session_id").select("session_id", F.col("ord").alias("cand"), at.alias("a_sec"), (at + F.col("k") * 3600 - 180000).alias("b_sec"))
    return intervals.validate_new(cand, own)


@query(on_signals("AI", ROOMY + """, o AS (SELECT * FROM roomy), e AS (SELECT session_id, idx, start_sec - 40000.0 AS a, end_sec + 20000.0 AS b FROM o WHERE idx % 2 = 0),
f AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.session_id = e.session_id AND o.idx <> e.idx AND e.a < o.end_sec AND e.b > o.start_sec)),
g AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f h WHERE h.session_id = f.session_id AND h.idx < f.idx AND f.a < h.b AND f.b > h.a))
SELECT o.session_id, o.idx, label, round(coalesce(a, start_sec), 6) AS start_sec, round(coalesce(b, end_sec), 6) AS end_sec FROM o LEFT JOIN g ON g.session_id = o.session_id AND g.idx = o.idx"""))
def resize(spark, sf_dir):
    _, own = _roomy(spark, sf_dir)
    edits = own.filter("idx % 2 = 0").select("session_id", "idx", (F.col("start_sec") - 40000).alias("new_start"), (F.col("end_sec") + 20000).alias("new_end"))
    return rounded(intervals.resize(own, edits))


@query(on_signals("AI", """, r AS (SELECT session_id, idx, CASE WHEN label = 'L1' THEN 'L2' ELSE label END AS label FROM intervals)
SELECT session_id, label, count(*) AS n, min(idx) AS first_idx, row_number() OVER (PARTITION BY session_id ORDER BY min(idx))::INT AS place FROM r GROUP BY session_id, label"""))
def rename_and_count_labels(spark, sf_dir):
    return intervals.label_library(intervals.rename_label(t.intervals(t.signals(spark, sf_dir)), "L1", "L2"))


@query("WITH " + t.SIGNALS + """, d AS (SELECT session_id, (us - lag(us) OVER (PARTITION BY session_id ORDER BY us)) / 1e6 AS step FROM signals)
SELECT session_id, round(1 / quantile_cont(step, 0.5), 9) AS rate_hz FROM d WHERE step > 0 GROUP BY session_id""")
def sampling_rate(spark, sf_dir):
    return rounded(beats.sampling_rate(t.signals(spark, sf_dir)), 9)


@query("WITH " + t.SIGNALS + """, e AS (SELECT session_id, sensor_id, min(value) AS low, max(value) AS high FROM signals GROUP BY ALL)
SELECT session_id, ord, round(CASE WHEN high > low THEN (value - low) / (high - low) ELSE 0 END, 6) AS scaled FROM signals JOIN e USING (session_id, sensor_id)""")
def normalise(spark, sf_dir):
    return rounded(beats.normalise(t.signals(spark, sf_dir)).select("session_id", "ord", "scaled"))


@query("WITH " + t.SIGNALS + " SELECT session_id, sensor_id, round(mad(value), 6) AS mad FROM signals GROUP BY ALL")
def median_deviation(spark, sf_dir):
    return rounded(beats.mad(t.signals(spark, sf_dir)))


@query("WITH " + t.SIGNALS + """ SELECT session_id, sensor_id, round(min(value) - CASE WHEN max(value) > min(value) THEN 0.05 * (max(value) - min(value)) ELSE greatest(0.05 * abs(max(value)), 0.5) END, 6) AS low,
  round(max(value) + CASE WHEN max(value) > min(value) THEN 0.05 * (max(value) - min(value)) ELSE greatest(0.05 * abs(max(value)), 0.5) END, 6) AS high FROM signals GROUP BY ALL""")
def value_bounds(spark, sf_dir):
    return rounded(beats.value_bounds(t.signals(spark, sf_dir)))


def _ibi(spark, sf_dir):
    """Per user, intervals from 500 ms on by value; their running sum is the time."""
    rows = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), F.floor(500 + F.col("value") * 4).alias("ibi_ms").cast("double").alias("ibi_ms"))
    order = Window.partitionBy("session_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return beats.accept_intervals(rows.withColumn("us", (F.sum("ibi_ms").over(order) * 1000).cast("long")))


IBI = """ibi AS (SELECT user_id AS session_id, event_id AS ord, floor(500 + value * 4)::DOUBLE AS ibi_ms FROM events),
timed AS (SELECT *, sum(ibi_ms) OVER (PARTITION BY session_id ORDER BY ord)::BIGINT * 1000 AS us, quantile_cont(ibi_ms, 0.5) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS local_ms FROM ibi),
acc AS (SELECT *, ibi_ms BETWEEN 300 AND 2000 AND ibi_ms / local_ms BETWEEN 0.6 AND 1.6 AS accepted FROM timed)"""


@query("WITH " + IBI + " SELECT session_id, ord, us, local_ms, accepted FROM acc")
def accept_intervals(spark, sf_dir):
    return _ibi(spark, sf_dir).select("session_id", "ord", "us", "local_ms", "accepted")


@query("WITH " + IBI + """, p AS (SELECT *, quantile_cont(ibi_ms, 0.9) OVER (PARTITION BY session_id ORDER BY us RANGE BETWEEN 4999999 PRECEDING AND 5000000 FOLLOWING) AS local FROM acc)
SELECT session_id, ord, round(local, 6) AS local FROM p WHERE ibi_ms >= 0.7 * local""")
def strong_peaks(spark, sf_dir):
    return rounded(beats.strong_peaks(_ibi(spark, sf_dir).withColumnRenamed("ibi_ms", "prominence"), 0.7).select("session_id", "ord", "local"))


@query("WITH " + IBI + """, p AS (SELECT *, row_number() OVER w AS place, sum(CASE WHEN accepted THEN 0 ELSE 1 END) OVER w AS rej FROM acc WINDOW w AS (PARTITION BY session_id ORDER BY us, ord)),
g AS (SELECT *, row_number() OVER w AS k, CASE WHEN place - lag(place) OVER w = 1 THEN (ibi_ms - lag(ibi_ms) OVER w) ** 2 END AS sq FROM p WHERE accepted WINDOW w AS (PARTITION BY session_id ORDER BY us, ord)),
m AS (SELECT session_id, us, k, stddev_samp(ibi_ms) OVER f AS sdnn_ms, sqrt(avg(sq) OVER (PARTITION BY session_id ORDER BY k ROWS BETWEEN 28 PRECEDING AND CURRENT ROW)) AS rmssd_ms, count(*) OVER f AS accepted_intervals,
  min(us - (ibi_ms * 1000)::BIGINT) OVER f AS from_us FROM g WINDOW f AS (PARTITION BY session_id ORDER BY k ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
e AS (SELECT session_id, min(us) FILTER (k >= 10) AS low, max(us) AS high FROM m GROUP BY session_id),
t AS (SELECT session_id, unnest(range((ceil(low / 1e6))::BIGINT, (floor(high / 1e6))::BIGINT + 1)) * 1000000 AS at_us FROM e),
x AS (SELECT t.session_id, t.at_us, m.* EXCLUDE (session_id) FROM t ASOF JOIN m ON t.session_id = m.session_id AND t.at_us >= m.us),
y AS (SELECT x.*, coalesce(h.rej, 0) AS hi FROM x ASOF LEFT JOIN p h ON x.session_id = h.session_id AND x.at_us >= h.us),
z AS (SELECT y.*, coalesce(l.rej, 0) AS lo FROM y ASOF LEFT JOIN p l ON y.session_id = l.session_id AND y.from_us >= l.us)
SELECT session_id, at_us, round(sdnn_ms, 5) AS sdnn_ms, round(rmssd_ms, 5) AS rmssd_ms, accepted_intervals, (hi - lo)::BIGINT AS rejected_intervals, round(accepted_intervals / (accepted_intervals + hi - lo), 5) AS quality_fraction FROM z""")
def hrv(spark, sf_dir):
    return rounded(beats.hrv(_ibi(spark, sf_dir), 30, 10), 5)


@query("WITH " + t.CAMERAS + " SELECT session_id, coalesce(min(duration_sec) FILTER (limits AND duration_sec > 0), max(duration_sec) FILTER (duration_sec > 0), 0) AS common_sec FROM cameras GROUP BY session_id")
def common_duration(spark, sf_dir):
    return sync.common_duration(t.cameras(spark, sf_dir))


@query("WITH " + t.CAMERAS + " SELECT session_id, coalesce(arg_min(corrected_us, camera_index) FILTER (corrected_us IS NOT NULL), arg_min(start_us, camera_index)) - 1250000 AS anchor_us FROM corrected GROUP BY session_id")
def signal_anchor(spark, sf_dir):
    cameras = sync.correct_camera_start(t.cameras(spark, sf_dir))
    return sync.signal_anchor(cameras, cameras.select("session_id").distinct().withColumn("offset_sec", F.lit(1.25)))


@query("WITH " + t.CAMERAS + """, e AS (SELECT session_id, min(corrected_us) AS low, max(corrected_us) AS high FROM corrected GROUP BY session_id HAVING max(corrected_us) - min(corrected_us) > 1000000)
SELECT session_id, (high - low) / 1e6 AS spread_sec, string_agg(printf('%04d', camera_index), ',' ORDER BY camera_index) FILTER (abs(corrected_us - low) <= 1) AS earliest,
  string_agg(printf('%04d', camera_index), ',' ORDER BY camera_index) FILTER (abs(corrected_us - high) <= 1) AS latest FROM corrected JOIN e USING (session_id) GROUP BY session_id, low, high""")
def coherence_warnings(spark, sf_dir):
    return sync.coherence_warnings(sync.correct_camera_start(t.cameras(spark, sf_dir)), 1_000_000)


@query("WITH " + t.CAMERAS + """, s AS (SELECT *, max(sync_sec) OVER w - sync_sec AS ts FROM cameras WINDOW w AS (PARTITION BY session_id)), l AS (SELECT *, duration_sec - ts AS left_sec FROM s),
g AS (SELECT *, coalesce(min(left_sec) FILTER (limits AND left_sec > 0) OVER (PARTITION BY session_id), greatest(max(left_sec) OVER (PARTITION BY session_id), 0)) AS target FROM l),
m AS (SELECT *, CASE WHEN target > 0 THEN left_sec - target ELSE 0 END AS te FROM g) SELECT session_id, camera_index, CASE WHEN ts > 0.01 THEN ts ELSE 0 END AS trim_start, CASE WHEN te > 0.1 THEN te ELSE 0 END AS trim_end FROM m""")
def trim_plan(spark, sf_dir):
    return sync.trim_plan(t.cameras(spark, sf_dir))


POOL = """checked AS (SELECT session_id, max((face_coverage >= 0.95 AND abs(video_hr - reference_hr) <= 1)::INT) = 1 AS trusted FROM curves GROUP BY session_id),
pooled AS (SELECT session_id, lag_idx, avg(corr) AS corr, count(*) AS n, trusted FROM curves JOIN checked USING (session_id) WHERE face_coverage >= 0.95 AND (NOT trusted OR abs(video_hr - reference_hr) <= 1) GROUP BY ALL)"""


def _pooled(spark, sf_dir):
    return alignment.pool_with_fallback(t.curves(spark, sf_dir), 1.0, 0.95)


@query("WITH " + t.CURVES + ", " + POOL + " SELECT session_id, lag_idx, round(corr, 9) AS corr, n, trusted FROM pooled")
def pool_with_fallback(spark, sf_dir):
    return rounded(_pooled(spark, sf_dir), 9)


@query("WITH " + t.CURVES + ", " + POOL + """, c AS (SELECT session_id, lag_idx, round(corr, 9) AS corr FROM pooled),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session_id ORDER BY lag_idx) AS run FROM (SELECT *, coalesce((corr <> lag(corr) OVER (PARTITION BY session_id ORDER BY lag_idx))::INT, 1) AS ch FROM c)),
g AS (SELECT session_id, run, min(lag_idx) AS low, max(lag_idx) AS high, first(corr) AS corr FROM r GROUP BY ALL),
h AS (SELECT *, lag(corr) OVER w AS b, lead(corr) OVER w AS a FROM g WINDOW w AS (PARTITION BY session_id ORDER BY run))
SELECT session_id, floor((low + high) / 2)::BIGINT AS lag_idx, corr FROM h WHERE corr > b AND corr > a""")
def curve_peaks(spark, sf_dir):
    return alignment.curve_peaks(rounded(_pooled(spark, sf_dir).select("session_id", "lag_idx", "corr"), 9))


@query("WITH " + t.CURVES + ", " + POOL + """, c AS (SELECT session_id, lag_idx, round(corr, 9) AS corr, lag(round(corr, 9)) OVER w AS l, lead(round(corr, 9)) OVER w AS r FROM pooled WINDOW w AS (PARTITION BY session_id ORDER BY lag_idx)),
b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY corr DESC, lag_idx) AS p FROM c)
SELECT session_id, lag_idx, round(lag_idx + coalesce(CASE WHEN l - 2 * corr + r < 0 THEN greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * corr + r))) ELSE 0 END, 0), 4) AS lag, corr FROM b WHERE p = 1""")
def best_lag(spark, sf_dir):
    return rounded(alignment.best_lag(rounded(_pooled(spark, sf_dir).select("session_id", "lag_idx", "corr"), 9)), 9)


#: By idx modulo 6: a stored start with and without an offset key, a stored anchor with and without one, a null offset under the key,
#: and no time at all, so that the session's anchor and offset count.
STORED = """, stored AS (SELECT i.session_id, idx, start_sec, end_sec, CASE WHEN idx % 6 IN (0, 1, 4) THEN low_us END AS start_us, CASE WHEN idx % 6 IN (1, 2, 3) THEN a.anchor_us + 7000000 END AS own_anchor,
  a.anchor_us AS session_anchor, idx % 6 IN (0, 2, 4) AS has_key, CASE WHEN idx % 6 IN (0, 2) THEN 0.25 END AS key_sec FROM intervals i JOIN anchors a USING (session_id)),
timed AS (SELECT *, CASE WHEN has_key THEN coalesce(key_sec, 0) WHEN start_us IS NOT NULL OR own_anchor IS NOT NULL THEN 0 ELSE 3 END AS applied,
  CASE WHEN start_us IS NOT NULL THEN start_us + CASE WHEN has_key THEN coalesce(key_sec, 0) ELSE 0 END * 1000000
    WHEN own_anchor IS NOT NULL THEN own_anchor + round(start_sec * 1e6) + CASE WHEN has_key THEN coalesce(key_sec, 0) ELSE 0 END * 1000000
    ELSE session_anchor + round(start_sec * 1e6) + 3000000 END::BIGINT AS reference FROM stored)"""


@query(on_signals("AI", STORED + """ SELECT session_id, idx, reference - 1500000 - round(start_sec * 1e6)::BIGINT AS anchor_us, reference - 1500000 AS start_us,
  reference - 1500000 + round((end_sec - start_sec) * 1e6)::BIGINT AS end_us, 1.5::DOUBLE AS offset_sec, abs(applied - 1.5) > 0.0001 AS was_stale FROM timed""").replace(") , stored AS", "), stored AS"))
def apply_offset(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    own, at = t.intervals(s).join(t.anchors(s), "session_id"), F.col("idx") % 6
    segments = own.select(
        "session_id", "idx", "start_sec", "end_sec", F.when(at.isin(0, 1, 4), F.col("low_us")).alias("start_us"), F.when(at.isin(1, 2, 3), F.col("anchor_us") + 7_000_000).alias("anchor_us"),
        F.col("anchor_us").alias("session_anchor_us"), F.lit(3.0).alias("session_offset_sec"), at.isin(0, 2, 4).alias("has_offset"), F.when(at.isin(0, 2), F.lit(0.25)).alias("offset_sec"),
    )
    return alignment.apply_offset(segments, 1.5)


def _applied(spark, sf_dir, offset_sec):
    s = t.signals(spark, sf_dir)
    third = F.col("idx") % 3
    own = t.intervals(s).join(t.anchors(s).select("session_id", F.col("anchor_us").alias("session_anchor_us")), "session_id")
    own = own.select("session_id", "idx", "start_sec", "end_sec", F.when(third == 1, F.col("low_us")).alias("start_us"), F.when(third == 2, F.col("session_anchor_us")).alias("anchor_us"), "session_anchor_us").withColumns({"session_offset_sec": F.lit(0.25), "has_offset": F.lit(False), "offset_sec": F.lit(None).cast("double")})
    kinds = {k: s.filter(F.col("sensor_id") == k).select("session_id", "us", "ord", "value") for k in ("view", "click")}
    anchors = t.anchors(s).select("session_id", "anchor_us", F.lit(0.25).alias("offset_sec"))
    return applied.apply_to_sessions(own, anchors, anchors.select("session_id", F.lit(0).alias("place"), "offset_sec"), kinds, offset_sec)


@query(on_signals("AI", """, b AS (SELECT session_id, idx, low_us - 7200000000 + CASE WHEN idx % 3 = 0 THEN 250000 ELSE 0 END AS a, low_us - 7200000000 + CASE WHEN idx % 3 = 0 THEN 250000 ELSE 0 END + round((end_sec - start_sec) * 1e6)::BIGINT AS b FROM intervals)
SELECT s.session_id, idx, sensor_id AS kind, ord FROM signals s JOIN b ON s.session_id = b.session_id AND us BETWEEN a AND b WHERE sensor_id IN ('view', 'click')"""))
def applied_slices(spark, sf_dir):
    """Signals cut anew two hours earlier."""
    return _applied(spark, sf_dir, 7200.0)["slices"].select("session_id", "idx", "kind", "ord")


@query(on_signals("AI", """, n AS (SELECT session_id, count(*) AS updated FROM intervals GROUP BY session_id)
SELECT a.session_id, anchor_us - 1250000 AS anchor_us, 1.5::DOUBLE AS offset_sec, 2::BIGINT AS applied, updated FROM anchors a JOIN n ON n.session_id = a.session_id"""))
def applied_sessions(spark, sf_dir):
    """Anchors, lengths of the histories and reports after an offset."""
    done = _applied(spark, sf_dir, 1.5)
    counts = done["history"].groupBy("session_id").agg(F.count("*").alias("applied"))
    return done["anchors"].join(counts, "session_id").join(done["report"].select("session_id", "updated"), "session_id")


SEGMENTED = """sc AS (SELECT l_suppkey AS session_id, l_orderkey % 7 AS segment_idx, l_linenumber AS win_idx, l_quantity::INT AS lag_idx, l_discount AS corr, 1 - l_tax AS face_coverage, (60 + l_linenumber)::DOUBLE AS video_hr FROM lineitem),
ok AS (SELECT *, face_coverage >= 0.95 AND abs(video_hr - 62) <= 1 AS fine FROM sc)"""


@query("WITH " + SEGMENTED + """, w AS (SELECT session_id, segment_idx, count(DISTINCT win_idx) FILTER (fine) AS accepted, count(DISTINCT win_idx) AS windows FROM ok GROUP BY ALL),
c AS (SELECT session_id, segment_idx, lag_idx, round(avg(corr), 9) AS corr FROM ok WHERE fine GROUP BY ALL),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session_id, segment_idx ORDER BY lag_idx) AS run FROM (SELECT *, coalesce((corr <> lag(corr) OVER (PARTITION BY session_id, segment_idx ORDER BY lag_idx))::INT, 1) AS ch FROM c)),
g AS (SELECT session_id, segment_idx, run, min(lag_idx) AS low, max(lag_idx) AS high, first(corr) AS corr FROM r GROUP BY ALL),
h AS (SELECT *, lag(corr) OVER w AS b, lead(corr) OVER w AS a FROM g WINDOW w AS (PARTITION BY session_id, segment_idx ORDER BY run)),
p AS (SELECT session_id, segment_idx, (low + high) // 2 AS peak FROM h WHERE corr > b AND corr > a), n AS (SELECT session_id, segment_idx, arg_min(peak, struct_pack(d := abs(peak - 25), p := peak)) AS nearest_peak FROM p GROUP BY ALL),
m AS (SELECT session_id, segment_idx, max(corr) AS corr FROM c GROUP BY ALL),
bl AS (SELECT session_id, segment_idx, lag_idx, corr, lag(corr) OVER w AS l, lead(corr) OVER w AS r FROM c WINDOW w AS (PARTITION BY session_id, segment_idx ORDER BY lag_idx)),
bb AS (SELECT session_id, segment_idx, round(lag_idx + coalesce(CASE WHEN l - 2 * corr + r < 0 THEN greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * corr + r))) ELSE 0 END, 0), 4) AS best,
  row_number() OVER (PARTITION BY session_id, segment_idx ORDER BY corr DESC, lag_idx) AS place FROM bl)
SELECT w.*, CASE WHEN nearest_peak IS NOT NULL THEN m.corr END AS corr, nearest_peak, CASE WHEN nearest_peak IS NOT NULL THEN bb.best END AS best
FROM w LEFT JOIN m USING (session_id, segment_idx) LEFT JOIN n USING (session_id, segment_idx) LEFT JOIN bb ON bb.session_id = w.session_id AND bb.segment_idx = w.segment_idx AND place = 1""")
def pool_report(spark, sf_dir):
    """Line items as windows of segments; equal window numbers of a segment are one window."""
    rows = t.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session_id"), (F.col("l_orderkey") % 7).alias("segment_idx"), F.col("l_linenumber").alias("win_idx"), F.col("l_quantity").cast("int").alias("lag_idx"), F.col("l_discount").alias("corr"), (1 - F.col("l_tax")).alias("face_coverage"), (60 + F.col("l_linenumber")).cast("double").alias("video_hr"), F.lit(62.0).alias("reference_hr"))
    at = rows.select("session_id", F.lit(25.0).alias("at_lag")).distinct()
    return rounded(applied.pool_report(rows, at, 1.0, 0.95), 9)


@query("""WITH n AS (SELECT user_id // 10 AS session_id, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT session_id, 16 - 4 * (session_id % 3) AS lag_idx, 1.0::DOUBLE AS corr FROM n WHERE n >= 240""")
def pooled_window_lag(spark, sf_dir):
    """Events of ten users each as a pulse at 8 Hz, against itself up to a second later: windows, their curves, the pooled lag."""
    rows = t.signals(spark, sf_dir).filter("value IS NOT NULL").withColumn("session_id", F.floor(F.col("session_id") / 10))
    pulses = rates.sample_index(rows).select("session_id", F.lit(0).cast("long").alias("segment_idx"), F.col("k").alias("frame_idx"), "value")
    references = pulses.select("session_id", "segment_idx", (F.col("frame_idx") / 8 + F.col("session_id") % 3 * 0.5).alias("t_sec"), "value")
    clips = pulses.groupBy("session_id", "segment_idx").agg((F.count("*") / 8).alias("duration_sec")).filter("duration_sec >= 30")
    curves = waveforms.window_correlations(pulses, references, intervals.analysis_windows(clips), 8.0, 2.0, 0.125)
    pooled = alignment.pool_curves(curves, None)
    return rounded(alignment.best_lag(pooled.select("session_id", "lag_idx", F.round("corr", 9).alias("corr"))).select("session_id", "lag_idx", "corr"), 6)


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'f' || o_custkey WHEN 1 THEN (o_custkey % 60) || ':' || (o_orderkey % 60) WHEN 2 THEN (o_custkey % 9) || ':02:03.5' WHEN 3 THEN (o_custkey % 90) || ',25' ELSE o_orderstatus || 'x' END AS s FROM orders)
SELECT o_orderkey, round(CASE o_orderkey % 5 WHEN 0 THEN substr(s, 2)::DOUBLE / 60 WHEN 1 THEN split_part(s, ':', 1)::DOUBLE * 60 + split_part(s, ':', 2)::DOUBLE WHEN 2 THEN split_part(s, ':', 1)::DOUBLE * 3600 + 123.5 WHEN 3 THEN replace(s, ',', '.')::DOUBLE END, 6) AS sec FROM x""")
def parse_time_text(spark, sf_dir):
    c = lambda x: F.col(x).cast("string")
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat(F.lit("f"), c("o_custkey"))).when(k == 1, F.concat((F.col("o_custkey") % 60).cast("string"), F.lit(":"), (F.col("o_orderkey") % 60).cast("string"))).when(k == 2, F.concat((F.col("o_custkey") % 9).cast("string"), F.lit(":02:03.5"))).when(k == 3, F.concat((F.col("o_custkey") % 90).cast("string"), F.lit(",25"))).otherwise(F.concat("o_orderstatus", F.lit("x")))
    return t.table(spark, sf_dir, "orders").select("o_orderkey", F.round(scalars.parse_time_text(text, F.lit(60.0)), 6).alias("sec"))


@query("""WITH x AS (SELECT o_orderkey, floor(o_totalprice / 10)::BIGINT AS s, round(o_totalprice * 1000)::BIGINT AS ms FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS short, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS full FROM x""")
def format_times(spark, sf_dir):
    return t.table(spark, sf_dir, "orders").select("o_orderkey", scalars.format_hms(F.col("o_totalprice") / 10).alias("short"), scalars.format_hms_ms(F.col("o_totalprice")).alias("full"))


@query("SELECT l_orderkey, l_linenumber, ceil(l_partkey * 1000 / (60000 / 1001.0::DOUBLE) - 1e-6)::BIGINT AS ms, l_partkey AS frame FROM lineitem")
def frame_times(spark, sf_dir):
    fps = F.lit(60000 / 1001)
    ms = scalars.frame_to_ms(F.col("l_partkey"), fps)
    return t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ms.cast("long").alias("ms"), scalars.ms_to_frame(ms, fps).cast("long").alias("frame"))


@query("SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g') AS key, printf('%04d', p_size) || '_' || replace(p_name, ' ', '_') AS folder FROM part")
def safe_names(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_partkey", scalars.trace_key(F.concat_ws("/", "p_name", "p_brand")).alias("key"), scalars.segment_folder(F.col("p_size"), F.col("p_name")).alias("folder"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_linenumber * 4.0 AS y, 20 + l_discount * 100 AS w, 30 + l_tax * 100 AS h FROM lineitem),
i AS (SELECT *, greatest(0, least(x + w, 65) - greatest(x, 25)) * greatest(0, least(y + h, 50) - greatest(y, 10)) AS common FROM b) SELECT l_orderkey, l_linenumber, round(common / (w * h + 1600 - common), 6) AS iou FROM i""")
def box_overlap(spark, sf_dir):
    x, y, w, h = F.col("l_quantity"), F.col("l_linenumber") * 4.0, 20 + F.col("l_discount") * 100, 30 + F.col("l_tax") * 100
    return t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scalars.iou(x, y, w, h, *map(F.lit, (25.0, 10.0, 40.0, 40.0))), 6).alias("iou"))


@query("WITH " + t.CAMERAS + """, s AS (SELECT *, least(30, duration_sec / 100) AS span FROM cameras WHERE duration_sec > 0), w AS (SELECT *, unnest(range(0, floor((duration_sec / 100 - span) / 15 + 1e-9)::BIGINT + 1))::INT AS win_idx FROM s)
SELECT session_id, camera_index AS segment_idx, win_idx, win_idx * 15.0::DOUBLE AS win_start, round(win_idx * 15 + span, 6) AS win_end FROM w""")
def analysis_windows(spark, sf_dir):
    rows = t.cameras(spark, sf_dir).filter("duration_sec > 0").select("session_id", F.col("camera_index").alias("segment_idx"), (F.col("duration_sec") / 100).alias("duration_sec"))
    return rounded(intervals.analysis_windows(rows))


@query(on_signals("", """, k AS (SELECT * EXCLUDE (k), row_number() OVER w - 1 AS k FROM signals WINDOW w AS (PARTITION BY session_id ORDER BY us, ord))
SELECT a.session_id, a.k AS start, (a.us + b.us) // 2 AS at_us FROM k a JOIN k b ON a.session_id = b.session_id AND b.k = a.k + 9 WHERE a.k % 2 = 0""").replace(") , k AS", "), k AS"))
def hr_windows(spark, sf_dir):
    return rates.hr_windows(rates.sample_index(t.signals(spark, sf_dir)), 1.0, None, 10.0, 2.0)


@query(on_signals("", """, n AS (SELECT session_id, count(*) AS n, min(us) AS first_us FROM signals GROUP BY session_id HAVING count(*) >= 10),
g AS (SELECT DISTINCT session_id, us FROM signals WHERE sensor_id = 'signup')
SELECT session_id, greatest(0, least(round_even((us - first_us) / 1e6 * (1 / 86400.0::DOUBLE), 0)::BIGINT - 5, n - 10)) AS start, us AS at_us FROM g JOIN n USING (session_id)""").replace(") , n AS", "), n AS"))
def hr_target_windows(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return rates.hr_windows(rates.sample_index(s), 1 / 86400, s.filter("sensor_id = 'signup'"), 864_000.0, 86_400.0)


@query(None)
def heart_rate(spark, sf_dir):
    """Events of ten users each taken as samples at 8 Hz: windows, rates and the harmonic correction."""
    indexed = rates.sample_index(t.signals(spark, sf_dir).withColumn("session_id", F.floor(F.col("session_id") / 10)))
    return rates.resolve_harmonics(rates.hr_features(indexed, rates.hr_windows(indexed, 8.0), 8.0))


@query(on_signals("", """, b AS (SELECT session_id, us, lead(us) OVER (PARTITION BY session_id ORDER BY us) AS next_us FROM (SELECT DISTINCT session_id, us FROM signals WHERE sensor_id = 'signup')),
p AS (SELECT s.session_id, (row_number() OVER (PARTITION BY s.session_id ORDER BY s.us, s.ord) - 1) // 5 AS block, 2 * pi() * (s.us - b.us) / (next_us - b.us)::DOUBLE AS turn FROM signals s JOIN b ON s.session_id = b.session_id AND s.us >= b.us AND s.us < next_us WHERE s.sensor_id = 'view'),
m AS (SELECT session_id, block, CASE WHEN count(*) = 5 THEN atan2(avg(sin(turn)), avg(cos(turn))) END AS angle FROM p GROUP BY ALL),
d AS (SELECT *, angle - lag(angle) OVER (PARTITION BY session_id ORDER BY block) AS step FROM m),
w AS (SELECT session_id, CASE WHEN angle IS NOT NULL THEN sum(coalesce(step - 2 * pi() * floor(step / (2 * pi()) + 0.5), 0)) OVER (PARTITION BY session_id ORDER BY block) END AS way FROM d)
SELECT session_id, count(way) AS blocks, CASE WHEN count(way) >= 2 THEN round((max(way) - min(way)) / (2 * pi()), 6) END AS drift_beats FROM w GROUP BY session_id""").replace(") , b AS", "), b AS"))
def phase_drift(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return rounded(rates.phase_drift(rates.pulse_phases(s.filter("sensor_id = 'view'"), s.filter("sensor_id = 'signup'")), 5))


@query(on_signals("AI", """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY start_sec, idx) AS index, label, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, round(end_sec - start_sec, 6) AS duration_sec,
printf('%04d', row_number() OVER (PARTITION BY session_id ORDER BY start_sec, idx)) || '_' || label AS folder FROM intervals"""))
def segment_manifest(spark, sf_dir):
    return rounded(records.manifest(t.intervals(t.signals(spark, sf_dir))))


@query("WITH " + t.CAMERAS + " SELECT session_id, arg_max(offset_sec, camera_index) AS offset_sec, count(*) AS applied FROM cameras GROUP BY session_id")
def current_offsets(spark, sf_dir):
    return records.current_offsets(t.cameras(spark, sf_dir).select("session_id", F.col("camera_index").alias("place"), "offset_sec"))


@query("""WITH f AS (SELECT p_partkey AS k, p_size AS session_id, p_brand || '/' || p_partkey AS path, p_size * 100 AS size FROM part),
old AS (SELECT session_id, path, size + (k % 11 = 0)::INT AS size, CASE k % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'alignment' ELSE 'odd' END AS category FROM f WHERE k % 7 <> 0), new AS (SELECT * FROM f WHERE k % 5 <> 0)
SELECT session_id, path, CASE WHEN o.category IN ('video', 'alignment') THEN o.category WHEN path LIKE 'Brand#1%' THEN 'alignment' END AS category,
CASE WHEN n.size IS NULL THEN 'missing' WHEN o.size IS NULL THEN 'foreign' WHEN n.size <> o.size THEN 'changed' ELSE 'same' END AS status, coalesce(n.size, o.size)::INT AS size FROM old o FULL JOIN new n USING (session_id, path)""")
def reconcile_artifacts(spark, sf_dir):
    k = F.col("p_partkey")
    files = t.table(spark, sf_dir, "part").select(k.alias("k"), F.col("p_size").cast("int").alias("session_id"), F.concat_ws("/", "p_brand", k.cast("string")).alias("path"), (F.col("p_size") * 100).cast("int").alias("size"))
    kind = F.when(F.col("k") % 3 == 0, "video").when(F.col("k") % 3 == 1, "alignment").otherwise("odd")
    old = files.filter("k % 7 <> 0").withColumn("size", (F.col("size") + (F.col("k") % 11 == 0).cast("int"))).withColumn("category", kind)
    return records.reconcile_artifacts(old, files.filter("k % 5 <> 0"), ["video", "alignment"], F.when(F.col("path").startswith("Brand#1"), "alignment"))


@query(on_signals("AI", """, x AS (SELECT s.session_id, round((us - anchor_us) / 1e6, 6) AS video_time_sec, min(us) AS us, arg_min(value, ord) FILTER (sensor_id = 'view') AS "view", arg_min(value, ord) FILTER (sensor_id = 'click') AS click
  FROM signals s JOIN anchors a ON s.session_id = a.session_id WHERE value IS NOT NULL AND sensor_id IN ('view', 'click') GROUP BY 1, 2)
SELECT x.*, coalesce((SELECT arg_max(label, idx) FROM intervals i WHERE i.session_id = x.session_id AND x.us BETWEEN low_us AND high_us), '') AS label FROM x""").replace(") , x AS", "), x AS"))
def plotted_table(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return records.plotted_table(sync.video_time(s, t.anchors(s)), t.intervals(s), ["view", "click"])


@query("""WITH f AS (SELECT p_size::BIGINT AS session_id, p_size * 100 AS size, CASE p_partkey % 6 WHEN 0 THEN 'Cam' || p_partkey || '_a_FINAL.mp4' WHEN 1 THEN 'cam2_' || p_partkey || '_concat.MOV' WHEN 2 THEN 'ppg_alignment/' || p_partkey || '/t.json'
  WHEN 3 THEN 'sub/cam1_' || p_partkey || '_final.mp4' WHEN 4 THEN 'Odd' || p_partkey || '.mkv' ELSE 'cam1_' || p_partkey || '_final.csv' END AS path, p_partkey AS k FROM part)
SELECT session_id, path, size::BIGINT AS size, CASE WHEN k % 6 = 0 THEN 'full' WHEN k % 6 = 1 THEN 'intermediate' WHEN k % 6 = 2 THEN 'alignment' WHEN k % 12 = 4 THEN 'full' ELSE 'intermediate' END AS category FROM f WHERE k % 6 IN (0, 1, 2, 4)""")
def classify_artifacts(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    names = [F.concat(F.lit("Cam"), k, F.lit("_a_FINAL.mp4")), F.concat(F.lit("cam2_"), k, F.lit("_concat.MOV")), F.concat(F.lit("ppg_alignment/"), k, F.lit("/t.json")), F.concat(F.lit("sub/cam1_"), k, F.lit("_final.mp4")), F.concat(F.lit("Odd"), k, F.lit(".mkv")), F.concat(F.lit("cam1_"), k, F.lit("_final.csv"))]
    files = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("session_id"), (F.col("p_size") * 100).cast("long").alias("size"), F.get(F.array(*names), (F.col("p_partkey") % 6).cast("int")).alias("path"))
    odd = files.filter("k % 6 = 4")
    cams = odd.select("session_id", F.when(F.col("k") % 12 == 4, F.upper("path")).alias("final_name"), F.when(F.col("k") % 12 == 10, F.col("path")).alias("intermediate_name"))
    return records.classify_artifacts(files, cams)


@query("SELECT o_custkey AS session_id, o_orderkey AS segment FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0")
def valid_traces(spark, sf_dir):
    k = F.col("o_orderkey")
    videos = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), k.alias("camera"), k.cast("string").alias("file"), F.floor("o_totalprice").alias("size"), F.col("o_orderdate").alias("mtime"), k.alias("segment"))
    settings = F.create_map(F.lit("method"), F.when(F.col("segment") % 7 == 0, "CHROM").otherwise("POS"), F.lit("fps"), F.lit("30"))
    traces = videos.withColumn("size", F.col("size") + (F.col("segment") % 5 == 0).cast("int")).withColumn("settings", settings).withColumn("version", F.when(F.col("segment") % 3 == 0, 1).otherwise(2))
    return records.valid_traces(traces, videos.drop("segment"), {"fps": 30, "method": "POS", "centred": False}, 2).select("session_id", "segment")


@query("WITH " + t.CURVES + """, l AS (SELECT session_id, lag_idx, round(avg(corr), 9) AS corr FROM curves GROUP BY ALL),
b AS (SELECT session_id, max(corr) AS best, max(corr) FILTER (lag_idx = 20) AS applied FROM l GROUP BY session_id)
SELECT b.session_id, (SELECT count(DISTINCT (video_hr)) FROM curves c WHERE c.session_id = b.session_id) AS windows, round(applied, 4) AS correlation, round((SELECT min(lag_idx) FROM l WHERE l.session_id = b.session_id AND l.corr = best) * 0.02::DOUBLE - 0.5, 6) AS best_offset_sec, round(best, 4) AS best_correlation FROM b""")
def estimate_record(spark, sf_dir):
    c = t.curves(spark, sf_dir).withColumn("segment_idx", F.lit(0)).withColumn("window_idx", F.col("video_hr").cast("long"))
    return records.estimate_record(c, 20, 0.02, -0.5).drop("segments")


@query("SELECT event_id, coalesce((props->>'k')::DOUBLE, 0) AS offset_sec FROM events")
def read_offset(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select("event_id", sessions.offset_of("props", "k").alias("offset_sec"))


@query("WITH " + t.CAMERAS + " SELECT session_id, camera_index, 'Camera ' || (camera_index + 1) AS label, duration_sec, mode AS time_correction_mode, offset_sec AS time_correction_offset_sec, limits AS limits_common_duration, 0.0::DOUBLE AS fps FROM cameras")
def session_documents(spark, sf_dir):
    """Cameras written to session documents and read back."""
    c = t.cameras(spark, sf_dir)
    rows = c.select("session_id", "camera_index", "duration_sec", F.col("mode").alias("time_correction_mode"), F.col("offset_sec").alias("time_correction_offset_sec"), F.col("limits").alias("limits_common_duration"))
    written = sessions.session_documents(c.select("session_id").distinct(), rows)
    return sessions.parse_sessions(written)[1].select("session_id", F.col("camera_index").cast("long").alias("camera_index"), "label", "duration_sec", "time_correction_mode", "time_correction_offset_sec", "limits_common_duration", "fps")


@query("WITH " + t.SIGNALS + """ SELECT session_id, us, arg_min(value, ord) FILTER (sensor_id = 'view') AS "view", arg_min(value, ord) FILTER (sensor_id = 'click') AS click,
  arg_min(k, ord) FILTER (sensor_id = 'view') AS aux__view__k, arg_min(k, ord) FILTER (sensor_id = 'click') AS aux__click__k FROM signals WHERE sensor_id IN ('view', 'click') GROUP BY ALL""")
def merge_sensors(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    return segments.merge_sensors(s.withColumn("aux", F.create_map(F.lit("k"), F.col("k"))), ["view", "click"], ["k"])


@query("WITH " + t.SIGNALS + """, a AS (SELECT session_id, us // 86400000000 AS us, avg(value) AS reference FROM signals WHERE sensor_id = 'view' GROUP BY ALL),
b AS (SELECT session_id, us // 86400000000 AS us, avg(value) AS estimate FROM signals WHERE sensor_id = 'click' GROUP BY ALL) SELECT session_id, us, round(reference, 6) AS reference, round(estimate, 6) AS estimate FROM a FULL JOIN b USING (session_id, us)""")
def comparison_view(spark, sf_dir):
    """Daily means of two sensors."""
    s = t.signals(spark, sf_dir).withColumn("us", F.floor(F.col("us") / t.DAY).cast("long"))
    mean = lambda sensor, name: s.filter(F.col("sensor_id") == sensor).groupBy("session_id", "us").agg(F.avg("value").alias(name))
    return rounded(segments.comparison_view(mean("view", "reference"), mean("click", "estimate")))


@query(on_signals("AI", """, c AS (SELECT l.session_id, l.us, l.ord, r.sensor_id, r.value, row_number() OVER (PARTITION BY l.ord, r.sensor_id ORDER BY abs(r.us - l.us), r.us DESC, r.ord) AS p FROM signals l JOIN signals r USING (session_id) WHERE l.sensor_id = 'signup' AND r.sensor_id IN ('view', 'click'))
SELECT c.session_id, c.ord, c.sensor_id, c.value, (SELECT arg_min(label, idx) FROM intervals i WHERE i.session_id = c.session_id AND c.us BETWEEN low_us AND high_us) AS label FROM c WHERE p = 1""").replace(") , c AS", "), c AS"))
def values_at(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    times = s.filter("sensor_id = 'signup'").select("session_id", "us", "ord")
    return segments.values_at(s.filter("sensor_id IN ('view', 'click')"), t.intervals(s), times).select("session_id", "ord", "sensor_id", "value", "label")


@query(on_signals("AI", """SELECT s.session_id, idx, ord, round((us - low_us) / 1e6, 6) AS t_sec, value FROM signals s JOIN intervals i ON s.session_id = i.session_id AND us BETWEEN low_us - 7200000000 AND high_us + 7200000000"""))
def segment_reference(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    own = t.intervals(s).select("session_id", "idx", F.col("low_us").alias("start_us"), F.col("high_us").alias("end_us"))
    return rounded(segments.segment_reference(s.select("session_id", "us", "ord", "value"), own, 7200.0))


@query(on_signals("AI", """SELECT s.session_id, idx, ord, value, idx % 3 = 0 AS own FROM signals s JOIN intervals i ON s.session_id = i.session_id AND us BETWEEN low_us AND high_us"""))
def segment_signal(spark, sf_dir):
    """Segments with a stored slice, with a start and end, and with seconds only."""
    s = t.signals(spark, sf_dir)
    own, third = t.intervals(s).join(t.anchors(s), "session_id"), F.col("idx") % 3
    stored = joins.within(s.select("session_id", "us", "ord", "value"), t.intervals(s).filter("idx % 3 = 0"))
    plain = own.select("session_id", "idx", F.when(third != 2, F.col("low_us")).alias("start_us"), F.when(third != 2, F.col("high_us")).alias("end_us"), "start_sec", "end_sec", "anchor_us")
    return segments.segment_signal(plain, stored, s.select("session_id", "us", "ord", "value")).select("session_id", "idx", "ord", "value", "own")


@query("""WITH o AS (SELECT o_custkey AS session_id, o_orderkey AS k FROM orders)
SELECT session_id, k AS idx, CASE WHEN k % 11 = 0 THEN 'excluded' WHEN k % 7 = 0 THEN 'no time' WHEN k % 5 = 0 THEN 'no trace' WHEN k % 3 = 0 THEN 'no reference' WHEN k % 2 = 0 THEN 'estimated' ELSE 'ready' END AS status FROM o""")
def pool_candidates(spark, sf_dir):
    rows = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("idx"))
    timed = rows.withColumn("start_us", F.when(F.col("idx") % 7 != 0, F.col("idx")))
    return segments.pool_candidates(timed, rows.filter("idx % 5 != 0"), rows.filter("idx % 3 != 0"), rows.filter("idx % 11 = 0"), rows.filter("idx % 2 = 0")).select("session_id", "idx", "status")


@query("WITH " + t.CURVES + """, c AS (SELECT session_id, lag_idx, round(avg(corr), 9) AS corr FROM curves GROUP BY ALL), n AS (SELECT *, lead(lag_idx) OVER w AS nl, lead(corr) OVER w AS nc FROM c WINDOW w AS (PARTITION BY session_id ORDER BY lag_idx)),
a AS (SELECT DISTINCT session_id, 10 + session_id % 7 + 0.25::DOUBLE AS at_lag FROM c)
SELECT a.session_id, a.at_lag, round(corr + (at_lag - lag_idx) / (nl - lag_idx) * (nc - corr), 6) AS corr FROM a LEFT JOIN n ON n.session_id = a.session_id AND at_lag >= lag_idx AND at_lag < nl""")
def corr_at(spark, sf_dir):
    c = rounded(t.curves(spark, sf_dir).groupBy("session_id", "lag_idx").agg(F.avg("corr").alias("corr")), 9)
    return rounded(segments.corr_at(c, c.select("session_id", (10 + F.col("session_id") % 7 + 0.25).alias("at_lag")).distinct()))


@query(on_signals("AI", """, l AS (SELECT DISTINCT session_id, unnest([' L3', 'L1', 'L3', '']) AS label, unnest([0, 1, 2, 3]) AS place FROM signals),
c AS (SELECT session_id, trim(label) AS label, min(place)::BIGINT AS ord, false AS kept FROM l WHERE trim(label) <> '' GROUP BY 1, 2),
u AS (SELECT session_id, label, min(idx) AS ord, true AS kept FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = i.session_id AND c.label = i.label) GROUP BY 1, 2)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY kept, ord)::INT AS place, label, kept FROM (FROM c UNION ALL FROM u)""").replace(") , l AS", "), l AS"))
def apply_labels(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    library = s.select("session_id").distinct().select("session_id", F.posexplode(F.array(*map(F.lit, (" L3", "L1", "L3", "")))).alias("place", "label"))
    return segments.apply_labels(library, t.intervals(s))


def _relations(spark, sf_dir):
    """Items of an order as relations of four cameras."""
    left, right = F.array(*map(F.lit, (0, 0, 0, 1, 1, 2, 2))), F.array(*map(F.lit, (1, 2, 3, 2, 3, 3, 3)))
    at = (F.col("l_linenumber") - 1).cast("int")
    return t.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.get(left, at).alias("left"), F.get(right, at).alias("right"), F.col("l_quantity").cast("double").alias("offset_sec"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS session_id, unnest([0, 1, 2, 3]) AS camera_index FROM lineitem),
r AS (SELECT l_orderkey AS session_id, l_linenumber AS camera_index, min(l_quantity)::DOUBLE AS o FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)
SELECT c.session_id, c.camera_index, CASE WHEN c.camera_index = 0 THEN 0 ELSE o END AS offset_sec FROM c LEFT JOIN r USING (session_id, camera_index)""")
def reference_offsets(spark, sf_dir):
    r = _relations(spark, sf_dir)
    return offsets.reference_offsets(r, r.select("session_id", F.explode(F.array(*map(F.lit, range(4)))).alias("camera_index")))


def _tree_sql() -> str:
    """Offsets of every spanning tree of at most four cameras (edges e1, e2, e3), its residuals over all relations, and the best."""
    rounds, last = [], "t0"
    for k in range(3):
        found = []
        for c in range(1, 4):
            ways = [f"CASE WHEN e{e}_b = {c} THEN (CASE e{e}_a WHEN 0 THEN 0 WHEN 1 THEN o1 WHEN 2 THEN o2 ELSE o3 END) + e{e}_o WHEN e{e}_a = {c} THEN (CASE e{e}_b WHEN 0 THEN 0 WHEN 1 THEN o1 WHEN 2 THEN o2 ELSE o3 END) - e{e}_o END" for e in (1, 2, 3)]
            found.append(f"coalesce(o{c}, {', '.join(ways)}) AS o{c}")
        rounds.append(f"t{k + 1} AS (SELECT * EXCLUDE (o1, o2, o3), {', '.join(found)} FROM {last})")
        last = f"t{k + 1}"
    edge = lambda e: f"e{e}.k AS k{e}, e{e}.a AS e{e}_a, e{e}.b AS e{e}_b, e{e}.o AS e{e}_o"
    at = lambda c: f"(CASE r.{c} WHEN 0 THEN 0 WHEN 1 THEN o1 WHEN 2 THEN o2 ELSE o3 END)"
    return f"""WITH r AS (SELECT l_orderkey AS session_id, ([0, 0, 0, 1, 1, 2, 2])[l_linenumber] AS a, ([1, 2, 3, 2, 3, 3, 3])[l_linenumber] AS b, l_quantity::DOUBLE AS o FROM lineitem),
n AS (SELECT session_id, greatest(max(b), 0) + 1 AS size FROM r GROUP BY session_id),
e AS (SELECT r.*, size, row_number() OVER (PARTITION BY session_id ORDER BY a, b, o) AS k FROM r JOIN n USING (session_id)),
t0 AS (SELECT e1.session_id, e1.size, {edge(1)}, {edge(2)}, {edge(3)}, NULL::DOUBLE AS o1, NULL::DOUBLE AS o2, NULL::DOUBLE AS o3
  FROM e e1 LEFT JOIN e e2 ON e2.session_id = e1.session_id AND e2.k > e1.k AND e1.size >= 3 LEFT JOIN e e3 ON e3.session_id = e1.session_id AND e3.k > e2.k AND e1.size = 4
  WHERE (e1.size < 3 OR e2.k IS NOT NULL) AND (e1.size < 4 OR e3.k IS NOT NULL)),
{", ".join(rounds)},
g AS (SELECT t.session_id, t.size, k1, k2, k3, o1, o2, o3, round(quantile_cont(abs({at("b")} - {at("a")} - r.o), 0.5), 9) AS md, round(avg(abs({at("b")} - {at("a")} - r.o)), 9) AS mn, round(max(abs({at("b")} - {at("a")} - r.o)), 9) AS mx
  FROM t3 t JOIN r ON r.session_id = t.session_id WHERE (size < 2 OR o1 IS NOT NULL) AND (size < 3 OR o2 IS NOT NULL) AND (size < 4 OR o3 IS NOT NULL) GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY md, mn, mx, k1, k2, k3) AS place FROM g),
c AS (SELECT session_id, unnest(range(size)) AS camera_index FROM n)
SELECT c.session_id, c.camera_index, CASE c.camera_index WHEN 0 THEN CASE WHEN w.place IS NOT NULL THEN 0 END WHEN 1 THEN o1 WHEN 2 THEN o2 ELSE o3 END::DOUBLE AS offset_sec,
  md AS median_residual, mn AS mean_residual, mx AS max_residual, w.place IS NOT NULL AS connected FROM c LEFT JOIN w ON w.session_id = c.session_id AND place = 1"""


@query(_tree_sql())
def reconciled_offsets(spark, sf_dir):
    return offsets.reconciled_offsets(_relations(spark, sf_dir), unconnected="null")


ENVELOPES = "WITH " + t.SIGNALS + f""", e AS (SELECT session_id, us // {t.DAY} AS day, value, row_number() OVER (PARTITION BY session_id, us // {t.DAY} ORDER BY us, ord) - 1 AS k FROM signals WHERE value IS NOT NULL),
c AS (SELECT a.session_id, a.day, a.k - b.k AS lag, round(sum(a.value * b.value), 9) AS p FROM e a JOIN e b ON a.session_id = b.session_id AND b.day = a.day + 1 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY session_id, day ORDER BY p DESC, lag) AS place FROM c)
SELECT session_id, day AS \"left\", day + 1 AS \"right\", round(lag * {offsets.HOP_SEC}::DOUBLE, 6) AS offset_sec FROM b WHERE place = 1"""


@query(ENVELOPES)
def envelope_offset_rows(spark, sf_dir):
    """As envelope_offset, from rows in blocks."""
    s = t.signals(spark, sf_dir).filter("value IS NOT NULL").withColumn("camera", F.floor(F.col("us") / t.DAY))
    hop = F.row_number().over(Window.partitionBy("session_id", "camera").orderBy("us", "ord")) - 1
    rows = s.select("session_id", "camera", hop.alias("hop"), "value")
    days = rows.select("session_id", F.col("camera").alias("left")).distinct()
    pairs = days.join(days.select("session_id", (F.col("left") - 1).alias("left")), ["session_id", "left"])
    return rounded(offsets.envelope_offset_rows(rows, pairs.select("session_id", "left", (F.col("left") + 1).alias("right"), F.lit(0.0).alias("left_start_sec"), F.lit(0.0).alias("right_start_sec")), block=4_096))


@query(ENVELOPES)
def envelope_offset(spark, sf_dir):
    """Pairs of consecutive days of a user, a day's envelope being its values in order of time."""
    s = t.signals(spark, sf_dir).filter("value IS NOT NULL").withColumn("day", F.floor(F.col("us") / t.DAY))
    days = s.groupBy("session_id", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("us", "ord", "value"))), lambda x: x["value"]).alias("env"))
    after = days.select("session_id", (F.col("day") - 1).alias("day"), F.col("env").alias("right_env"))
    rows = days.join(after, ["session_id", "day"])
    return rounded(offsets.envelope_offset(rows.select("session_id", F.col("day").alias("left"), (F.col("day") + 1).alias("right"), F.col("env").alias("left_env"), "right_env", F.lit(0.0).alias("left_start_sec"), F.lit(0.0).alias("right_start_sec"))))


def _detections(spark, sf_dir):
    """Line items as boxes, suppliers as clips."""
    k = F.col("l_orderkey")
    return t.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip_id"), (k % 300).alias("frame_idx"), ((k % 300) / 30).alias("t_sec"), (F.col("l_partkey") % 90).alias("x"), (F.floor("l_extendedprice") % 60).alias("y"), (10 + F.col("l_quantity")).alias("w"), (12 + F.col("l_quantity")).alias("h"), F.col("l_discount").alias("score"))


@query("""WITH d AS (SELECT l_suppkey AS clip_id, l_orderkey % 300 AS frame_idx, (l_partkey % 90)::DOUBLE AS x, (floor(l_extendedprice)::BIGINT % 60)::DOUBLE AS y, (10 + l_quantity)::DOUBLE AS w, (12 + l_quantity)::DOUBLE AS h, l_discount::DOUBLE AS score FROM lineitem),
g AS (SELECT clip_id, frame_idx, list([{'x': x, 'y': y, 'w': w, 'h': h, 'score': score}] ORDER BY score DESC, x, y, w, h) AS boxes FROM d GROUP BY ALL),
k AS (SELECT clip_id, frame_idx, list_reduce(list_prepend([]::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, score DOUBLE)[], boxes), lambda kept, b: CASE WHEN len(list_filter(kept, lambda o:
  greatest(0, least(o.x + o.w, b[1].x + b[1].w) - greatest(o.x, b[1].x)) * greatest(0, least(o.y + o.h, b[1].y + b[1].h) - greatest(o.y, b[1].y))
  > 0.3::DOUBLE * (o.w * o.h + b[1].w * b[1].h - greatest(0, least(o.x + o.w, b[1].x + b[1].w) - greatest(o.x, b[1].x)) * greatest(0, least(o.y + o.h, b[1].y + b[1].h) - greatest(o.y, b[1].y))))) > 0
  THEN kept ELSE list_concat(kept, b) END) AS kept FROM g)
SELECT clip_id, frame_idx, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.score AS score FROM (SELECT clip_id, frame_idx, unnest(kept) AS b FROM k)""")
def suppress_boxes(spark, sf_dir):
    return boxes.suppress(_detections(spark, sf_dir))


@query(None)
def track_boxes(spark, sf_dir):
    return boxes.track_boxes(_detections(spark, sf_dir))


@query(None)
def follow_face(spark, sf_dir):
    return boxes.follow_face(_detections(spark, sf_dir), 30.0, centred=True)


@query("""WITH d AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) || md5(o_totalprice::VARCHAR) || md5(o_orderdate::VARCHAR) AS h FROM orders),
p AS (SELECT o_orderkey, ('0x' || substr(h, 1 + 6 * i, 2))::INT AS b, ('0x' || substr(h, 3 + 6 * i, 2))::INT AS g, ('0x' || substr(h, 5 + 6 * i, 2))::INT AS r FROM d, (SELECT unnest(range(16))::INT AS i)),
y AS (SELECT *, b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE AS luma FROM p),
s AS (SELECT *, round_even((r - luma) * 0.713::DOUBLE + 128, 0) BETWEEN 133 AND 173 AND round_even((b - luma) * 0.564::DOUBLE + 128, 0) BETWEEN 77 AND 127 AS skin FROM y),
n AS (SELECT *, count(*) FILTER (skin) OVER (PARTITION BY o_orderkey) >= 0.15 * 16 AS enough FROM s)
SELECT o_orderkey, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM n WHERE skin OR NOT enough GROUP BY o_orderkey""")
def roi_mean_rgb(spark, sf_dir):
    """Sixteen pixels from each order's digests."""
    digests = F.concat(*(F.md5(F.col(c).cast("string")) for c in ("o_orderkey", "o_totalprice", "o_orderdate")))
    return rounded(t.table(spark, sf_dir, "orders").select("o_orderkey", boxes.roi_mean_rgb(F.unhex(digests)).alias("c")).select("o_orderkey", "c.*"))


@query("WITH " + t.SIGNALS + " SELECT session_id, ord, (us - lag(us) OVER (PARTITION BY session_id ORDER BY us, ord)) / 1000 AS rr_ms FROM signals WHERE sensor_id <> 'error'")
def rr_intervals(spark, sf_dir):
    return beats.rr_intervals(t.signals(spark, sf_dir).filter("sensor_id <> 'error'").select("session_id", "us", "ord")).drop("us")


@query("WITH " + t.SIGNALS + " SELECT session_id, ord, value * 10 AS value FROM signals WHERE value * 10 BETWEEN 1 AND 1000")
def reference_hrv(spark, sf_dir):
    return beats.reference_hrv(t.signals(spark, sf_dir).select("session_id", "ord", (F.col("value") * 10).alias("value")))


@query(on_signals("AI", """, q AS (SELECT DISTINCT s.session_id, (us - anchor_us) / 1e6 AS at_sec FROM signals s JOIN anchors a USING (session_id))
SELECT q.session_id, at_sec, min(start_sec) FILTER (start_sec > at_sec + 1e-3) AS next_sec, max(start_sec) FILTER (start_sec < at_sec - 1e-3) AS previous_sec
FROM q LEFT JOIN intervals i ON i.session_id = q.session_id GROUP BY ALL""").replace(") , q AS", "), q AS"))
def next_interval(spark, sf_dir):
    s = t.signals(spark, sf_dir)
    times = s.join(t.anchors(s), "session_id").select("session_id", ((F.col("us") - F.col("anchor_us")) / 1e6).alias("at_sec"))
    return intervals.next_interval(t.intervals(s), times)


@query(on_signals("AI", f""", v AS (SELECT session_id, unnest(range(20)) AS view_idx, anchor_us FROM anchors)
SELECT i.session_id, view_idx, idx FROM v JOIN intervals i ON i.session_id = v.session_id AND high_us > anchor_us + view_idx * {t.DAY} AND low_us < anchor_us + (view_idx + 1) * {t.DAY}""").replace(") , v AS", "), v AS"))
def visible(spark, sf_dir):
    """Intervals that each day of a session shows."""
    s = t.signals(spark, sf_dir)
    days = t.anchors(s).select("session_id", "anchor_us", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("view_idx"))
    views = days.select("session_id", "view_idx", (F.col("anchor_us") + F.col("view_idx") * t.DAY).alias("from_us"), (F.col("anchor_us") + (F.col("view_idx") + 1) * t.DAY).alias("to_us"))
    return joins.visible(t.intervals(s), views).select("session_id", "view_idx", "idx")


@query(on_signals("A", f"""SELECT s.session_id, sensor_id, round(min(value) - CASE WHEN max(value) > min(value) THEN 0.05 * (max(value) - min(value)) ELSE greatest(0.05 * abs(max(value)), 0.5) END, 6) AS low,
  round(max(value) + CASE WHEN max(value) > min(value) THEN 0.05 * (max(value) - min(value)) ELSE greatest(0.05 * abs(max(value)), 0.5) END, 6) AS high
  FROM signals s JOIN anchors a ON a.session_id = s.session_id AND us BETWEEN anchor_us AND anchor_us + {5 * t.DAY} WHERE value IS NOT NULL GROUP BY ALL"""))
def visible_bounds(spark, sf_dir):
    """Bounds of what five days of each session show."""
    s = t.signals(spark, sf_dir)
    return rounded(beats.value_bounds(s.join(t.anchors(s), "session_id"), F.col("anchor_us"), F.col("anchor_us") + 5 * t.DAY))


@query("WITH " + t.SIGNALS + " SELECT session_id, sensor_id, us, ord, value, CASE WHEN sensor_id = 'view' THEN aux END AS aux FROM signals WHERE sensor_id IN ('view', 'click', 'error')")
def union_signals(spark, sf_dir):
    """Frames of which one alone has aux."""
    s = t.signals(spark, sf_dir)
    of = lambda k, *more: s.filter(F.col("sensor_id") == k).select("session_id", "sensor_id", "us", "ord", "value", *more)
    return sync.union_signals([of("click"), of("view", "aux"), of("error")])


@query("WITH " + t.SIGNALS + f" SELECT session_id, sensor_id, us // {HOURS} AS us, min(ord) AS ord, arg_min(k, ord) AS k FROM signals GROUP BY ALL")
def dedupe_ts(spark, sf_dir):
    """Samples of one hour as samples of one time."""
    return sync.dedupe_ts(t.signals(spark, sf_dir).select("session_id", "sensor_id", F.floor(F.col("us") / HOURS).alias("us"), "ord", "k"))


@query(on_signals("AI", f""", c AS (SELECT s.session_id, us, idx, ord, row_number() OVER (PARTITION BY s.session_id, us ORDER BY idx, ord) AS place
  FROM signals s JOIN intervals i ON s.session_id = i.session_id AND us BETWEEN low_us AND high_us + {24 * HOURS}) SELECT session_id, us, idx, ord FROM c WHERE place = 1""").replace(") , c AS", "), c AS"))
def stitch_slices(spark, sf_dir):
    """Slices that reach a day into the next segment."""
    s = t.signals(spark, sf_dir)
    return sync.stitch_slices(joins.within(s.select("session_id", "us", "ord"), t.intervals(s).withColumn("high_us", F.col("high_us") + 24 * HOURS)).select("session_id", "us", "idx", "ord"))


@query("WITH " + t.CURVES + ", " + POOL + """, c AS (SELECT session_id, lag_idx, round(corr, 9) AS corr FROM pooled),
top AS (SELECT session_id, arg_max(lag_idx, struct_pack(c := corr, l := -lag_idx)) AS best, max(corr) AS corr FROM c GROUP BY session_id),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session_id ORDER BY lag_idx) AS run FROM (SELECT *, coalesce((corr <> lag(corr) OVER (PARTITION BY session_id ORDER BY lag_idx))::INT, 1) AS ch FROM c)),
g AS (SELECT session_id, run, min(lag_idx) AS low, max(lag_idx) AS high, first(corr) AS corr FROM r GROUP BY ALL),
h AS (SELECT *, lag(corr) OVER w AS b, lead(corr) OVER w AS a FROM g WINDOW w AS (PARTITION BY session_id ORDER BY run)),
o AS (SELECT top.session_id, max(h.corr) AS other FROM top JOIN h ON h.session_id = top.session_id AND h.corr > b AND h.corr > a AND abs((low + high) // 2 - best) > 5 GROUP BY ALL)
SELECT top.session_id, round(CASE WHEN other > 0 THEN corr / other ELSE -1 END, 6) AS ratio FROM top LEFT JOIN o USING (session_id)""")
def peak_ratio(spark, sf_dir):
    """-1 stands for an infinite ratio."""
    ratio = alignment.peak_ratio(rounded(_pooled(spark, sf_dir).select("session_id", "lag_idx", "corr"), 9), 5)
    return rounded(ratio.withColumn("ratio", F.when(F.col("ratio") == float("inf"), -1.0).otherwise(F.col("ratio"))))


@query("SELECT o_custkey AS session_id, o_orderkey AS src_ord, o_orderstatus || '_' || row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS sensor_id FROM orders")
def sensor_ids(spark, sf_dir):
    files = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("src_ord"))
    return sensors.assign_sensor_ids(files).select("session_id", "src_ord", "sensor_id")


@query(f"""WITH x AS (SELECT o_orderkey, o_orderpriority AS label FROM orders),
d AS (SELECT DISTINCT label, CASE label WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 ELSE {t.crc32_sql("label")} END AS place FROM x)
SELECT o_orderkey, (['red', 'green', 'blue', 'black'])[place % 4 + 1] AS color FROM x JOIN d USING (label)""")
def label_colors(spark, sf_dir):
    library, palette = F.array(*map(F.lit, ("1-URGENT", "5-LOW"))), F.array(*map(F.lit, ("red", "green", "blue", "black")))
    return t.table(spark, sf_dir, "orders").select("o_orderkey", scalars.label_color(F.col("o_orderpriority"), library, palette).alias("color"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 90)::DOUBLE AS x, (floor(l_extendedprice)::BIGINT % 60)::DOUBLE AS y, (10 + l_quantity)::DOUBLE AS w, (12 + l_quantity)::DOUBLE AS h FROM lineitem),
e AS (SELECT *, greatest(0, round_even(x - w * 0.25, 0)) AS l, greatest(0, round_even(y - h * 0.25 * 1.3, 0)) AS o, least(120, round_even(x + w + w * 0.25, 0)) AS r, least(90, round_even(y + h + h * 0.25, 0)) AS u FROM b)
SELECT l_orderkey, l_linenumber, l::INT AS x, o::INT AS y, (r - l)::INT AS w, (u - o)::INT AS h FROM e""")
def expanded_regions(spark, sf_dir):
    d = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 90).cast("double").alias("x"), (F.floor("l_extendedprice") % 60).cast("double").alias("y"), (10 + F.col("l_quantity")).cast("double").alias("w"), (12 + F.col("l_quantity")).cast("double").alias("h"))
    return d.select("l_orderkey", "l_linenumber", scalars.expanded_region(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 120, 90, 0.25).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("WITH " + t.CAMERAS + """, d AS (SELECT session_id, coalesce(arg_min(corrected_us, camera_index) FILTER (corrected_us IS NOT NULL), arg_min(start_us, camera_index)) - 1250000 AS own FROM corrected GROUP BY session_id)
SELECT session_id, CASE WHEN session_id % 3 = 0 THEN session_id * 1000000 ELSE own END AS anchor_us FROM d""")
def effective_anchor(spark, sf_dir):
    cameras = sync.correct_camera_start(t.cameras(spark, sf_dir))
    sessions = cameras.select("session_id").distinct()
    stored = sessions.select("session_id", F.when(F.col("session_id") % 3 == 0, F.col("session_id") * 1_000_000).alias("stored_us"))
    return sync.effective_anchor(cameras, stored, sessions.withColumn("offset_sec", F.lit(1.25)))


@query("WITH " + t.CAMERAS + """ SELECT session_id, camera_index, CASE mode WHEN 'true' THEN clock WHEN 'reference' THEN clock - (reference_sec * 1000000)::BIGINT WHEN 'offset' THEN start_us + (offset_sec * 1000000)::BIGINT END AS corrected_us
FROM (SELECT *, start_us // 86400000000 * 86400000000 + (camera_index * 7919 % 86400) * 1000000 AS clock FROM cameras)""")
def clock_entries(spark, sf_dir):
    """Corrected starts from times of day as typed."""
    typed = t.cameras(spark, sf_dir).withColumn("clock_ms", F.col("camera_index").cast("long") * 7919 % 86400 * 1000)
    return sync.correct_camera_start(sync.clock_entries(typed)).select("session_id", "camera_index", "corrected_us")


@query("""SELECT o_custkey AS session_id, count(*) AS cameras, min(f) AS least, max(f) AS most, coalesce(min(f) <> max(f) OR (count(f) < count(*) AND count(f) > 0), false) AS differ
FROM (SELECT o_custkey, CASE WHEN o_orderkey % 13 <> 0 THEN 100 + o_orderkey % 2 END AS f FROM orders) GROUP BY ALL""")
def frame_counts(spark, sf_dir):
    k = F.col("o_orderkey")
    return sync.frame_counts(t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.when(k % 13 != 0, 100 + k % 2).alias("frame_count")))


@query("WITH " + t.SIGNALS + " SELECT ord, row_number() OVER (ORDER BY session_id, sensor_id, us, ord) AS place FROM signals")
def in_time_order(spark, sf_dir):
    """Places from the order of the parts and the rows in them."""
    rows = sync.in_time_order(t.signals(spark, sf_dir)).select("ord", F.monotonically_increasing_id().alias("at"))
    parts = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("first") + 1).alias("shift"))
    return rows.withColumn("part", F.shiftright("at", 33)).join(starts, "part").select("ord", (F.col("at") + F.col("shift")).alias("place"))
