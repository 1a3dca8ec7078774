"""Queries of joins on a time line, windows and repairs (JN, WN, parts of AG and AL)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.operators import intervals as iv
from trackloom.plans.tracks import EV, NR, RUNS, normal, runs
from trackloom.sources.tables import events, table

r3 = lambda c: F.round(c, 3)
HOUR = 3600.0


def _ev(spark, sf):
    return events(spark, sf)


def _run(spark, sf):
    """Runs in seconds as (track, run_id, rs, re)."""
    return runs(spark, sf).select("track", "run_id", (F.col("start") * HOUR).alias("rs"), (F.col("end") * HOUR).alias("re"))


def _sessions(spark, sf):
    """(track = user_id, sid, s, e): events of a user closer than 6 hours, e = last + 60 s."""
    w = Window.partitionBy("track").orderBy("t", "event_id")
    e = _ev(spark, sf).select(F.col("user_id").alias("track"), "event_id", "t")
    e = e.withColumn("sid", F.sum(F.when(F.col("t") - F.lag("t").over(w) <= 6 * HOUR, 0).otherwise(1)).over(w).cast("int"))
    return e.groupBy("track", "sid").agg(F.min("t").alias("s"), (F.max("t") + 60).alias("e"))


SESS = EV.replace("AS track", "AS kind") + """,
se AS (SELECT user_id AS track, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id)::INT AS sid, t FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 21600 THEN 0 ELSE 1 END AS n FROM ev)),
ses AS (SELECT track, sid, min(t) AS s, max(t) + 60 AS e FROM se GROUP BY track, sid)"""
RUNSEC = RUNS + ',\nrs AS (SELECT track, run_id, "start" * 3600 AS rs, "end" * 3600 AS re FROM runs)'


def nearest_asof(spark, sf):
    e = _ev(spark, sf)
    points = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("track"), "event_id", "t", (F.col("t") - 7200).alias("lo"), (F.col("t") + 7200).alias("hi"))
    marks = e.filter("event_type = 'click'").select(F.col("user_id").alias("track"), F.col("t").alias("m"))
    return iv.nearest(points, marks, ["track"], "event_id", 3 * HOUR).select("event_id", r3("mark").alias("mark"), "found")


def gap_centre_snap(spark, sf):
    b = runs(spark, sf).select("track", "run_id", (F.col("start") * HOUR + 900).alias("b"))
    return iv.snap_to_gaps(b, _run(spark, sf), ["track"], "run_id", 2 * HOUR).select("track", "run_id", r3("snapped").alias("snapped"), "found")


def interval_coverage(spark, sf):
    bins = _run(spark, sf).select("track").distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("bin"))
    bins = bins.withColumn("s", F.col("bin") * 6 * HOUR).withColumn("e", F.col("s") + 6 * HOUR)
    return iv.coverage(bins, _run(spark, sf).select("track", "rs", "re"), ["track"], "bin", 6 * HOUR).select("track", "bin", F.round("coverage", 4).alias("coverage"))


def point_in_interval(spark, sf):
    spans = _run(spark, sf).withColumnRenamed("rs", "s").withColumnRenamed("re", "e")
    points = _ev(spark, sf).select(F.col("event_type").alias("track"), "event_id", "t", "value")
    half = iv.points_in(spans, points, ["track"], 4 * HOUR).groupBy("track", "run_id").agg(F.count("*").alias("n_half_open"))
    closed = iv.points_in(spans, points, ["track"], 4 * HOUR, closed=True).groupBy("track", "run_id").agg(F.count("*").alias("n_closed"), F.count_if(F.col("value") > 50).alias("n_strong"))
    return closed.join(half, ["track", "run_id"])


def stabbing_first(spark, sf):
    sess = _sessions(spark, sf)
    wide = sess.withColumn("e", F.col("e") + 2 * HOUR)
    points = _ev(spark, sf).select(F.col("user_id").alias("track"), "event_id", (F.col("t") + HOUR).alias("t"))
    return iv.stab_first(points, wide, ["track"], ["event_id"], ["sid"], 6 * HOUR).select("event_id", "sid")


def interval_clip(spark, sf):
    x = iv.clip(_sessions(spark, sf).withColumnRenamed("s", "rs").withColumnRenamed("e", "re"), F.lit(100 * HOUR), F.lit(200 * HOUR))
    return x.select("track", "sid", r3("rs").alias("rs"), r3("re").alias("re"))


def in_window(spark, sf):
    return _sessions(spark, sf).filter((F.col("s") < 200 * HOUR) & (F.col("e") > 100 * HOUR)).select("track", "sid")


def band_filter(spark, sf):
    e = _ev(spark, sf)
    band = _run(spark, sf).groupBy("track").agg(F.min("rs").alias("lo"), F.max("re").alias("hi"))
    x = e.withColumnRenamed("event_type", "track").join(F.broadcast(band), "track").filter((F.col("t") >= F.col("lo") - 0.25) & (F.col("t") <= F.col("hi") + 0.25))
    return x.select("event_id")


def positional_zip(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    a = c.select("conv_id", "turn", F.posexplode("w").alias("k", "word"))
    b = c.select("conv_id", F.col("turn") - 1, F.posexplode("w").alias("k", "below")).toDF("conv_id", "turn", "k", "below")
    z = a.join(b, ["conv_id", "turn", "k"])
    return z.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.count_if(F.col("word") == F.col("below")).alias("n_equal"))


def char_lookup(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("ws"))
    w = b.select("item_id", F.posexplode("ws").alias("wi", "w"))
    order = Window.partitionBy("item_id").orderBy("wi").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("c0", F.coalesce(F.sum(F.length("w")).over(order), F.lit(0)))
    chars = w.filter(F.length("w") > 0).select("item_id", "wi", "c0", F.posexplode(F.split("w", "")).alias("ci", "ch")).filter("ch <> ''")
    return chars.select("item_id", (F.col("c0") + F.col("ci")).cast("int").alias("pos"), "wi", "ci", "ch")


def label_fallback(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("source") == "src0", None).otherwise(F.col("source")).alias("src"))
    l = table(spark, sf, "labels")
    x = d.join(l, "doc_id", "left")
    named = F.coalesce(F.when(F.col("toxic") == 1, F.lit("toxic")), F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string"))), F.col("src"), F.col("lang"))
    return x.select("doc_id", named.alias("label"))


def min_gap_repair(spark, sf):
    return iv.min_gap(runs(spark, sf), ["track"], "run_id", "start", 5.0).select("track", "run_id", r3("repaired").alias("b"))


def running_max(spark, sf):
    w = Window.partitionBy("track").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    return normal(spark, sf).select("track", "f", F.max("y").over(w).alias("m"))


def forward_fill(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = _ev(spark, sf).withColumn("k", F.row_number().over(w))
    e = e.withColumn("v", F.when(F.col("k") % 3 == 0, F.col("t"))).withColumn("seed", F.lit(0.0))
    return iv.forward_fill(e, ["user_id"], "k", "v", "seed").select("event_id", r3("value").alias("value"), "filled")


def line_spans(spark, sf):
    e = _ev(spark, sf).withColumn("u", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    e = e.withColumn("line", F.floor(F.col("t") / 86400).cast("int"))
    x = iv.line_spans(e, ["user_id"], 1.5)
    return x.select("user_id", "line", r3("start").alias("start"), r3("end").alias("end"), r3("last").alias("last"))


def shared_notes(spark, sf):
    e = _ev(spark, sf).select("user_id", "event_id", (F.floor(F.col("t") / 7200) * 7200.0).alias("t"), F.lit(720 * HOUR).alias("end"))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    return iv.share_notes(e, ["user_id"], "k", "t", "end").select("event_id", r3("start").alias("start"), r3("stop").alias("stop"))


def known_neighbours(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = _ev(spark, sf).withColumn("k", F.row_number().over(w)).withColumn("v", F.when(F.col("k") % 4 == 1, F.col("value")))
    return iv.neighbours(e, ["user_id"], "k", "v").filter("v IS NULL").select("event_id", "before", "after")


def neighbour_lines(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag("text", 1, "").over(w).alias("prev"), F.lead("text", 1, "").over(w).alias("next"))


def note_length(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    d = _ev(spark, sf).withColumn("d", F.col("t") - F.lag("t").over(w))
    return d.groupBy("user_id").agg(F.when(F.count("*") > 2, r3(F.percentile("d", 0.5) * 2)).otherwise(0.4).alias("note"))


def least_corroborated(spark, sf):
    e = _ev(spark, sf).withColumn("conf", (F.col("event_id") % 100) / 100)
    return e.orderBy("conf", F.desc("value"), "event_id").limit(6).select("event_id", "conf", "value")


def previews(spark, sf):
    w = Window.partitionBy("user_id")
    e = _ev(spark, sf)
    x = e.withColumn("k", F.row_number().over(w.orderBy("t", "event_id"))).withColumn("r", F.row_number().over(w.orderBy(F.desc("t"), F.desc("event_id"))))
    return x.filter("k <= 5 OR r <= 5").select("user_id", "event_id", "k")


def error_histogram(spark, sf):
    e = _ev(spark, sf)
    points = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("track"), "event_id", "t")
    marks = e.filter("event_type <> 'purchase'").select(F.col("user_id").alias("track"), F.col("t").alias("m"))
    d = iv.nearest(points, marks, ["track"], "event_id", 1e9).withColumn("d", F.abs(F.col("mark") - F.col("t")) / HOUR)
    edges = [0, 0.02, 0.05, 0.1, 0.2, 0.5, 10]
    bucket = F.coalesce(*[F.when((F.col("d") >= a) & (F.col("d") < b), k) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    return d.select(bucket.cast("int").alias("bucket")).filter("bucket IS NOT NULL").groupBy("bucket").count().withColumnRenamed("count", "n")


CATALOGUE = {
    "nearest_asof": (nearest_asof, f"""WITH {EV.replace("AS track", "AS kind")}, p AS (SELECT event_id, user_id, t FROM ev WHERE kind = 'purchase'), c AS (SELECT DISTINCT user_id, t AS m FROM ev WHERE kind = 'click'),
b AS (SELECT p.*, c.m AS b FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.t >= c.m), a AS (SELECT b.*, c.m AS a FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.t < c.m),
x AS (SELECT event_id, t, CASE WHEN a IS NULL OR t - b <= a - t THEN b ELSE a END AS m FROM a), y AS (SELECT *, coalesce(abs(m - t) <= 10800 AND m > t - 7200 + 0.02::DOUBLE AND m < t + 7200 - 0.02::DOUBLE, false) AS found FROM x)
SELECT event_id, round(CASE WHEN found THEN m ELSE t END, 3) AS mark, found FROM y"""),
    "gap_centre_snap": (gap_centre_snap, f"""WITH {RUNSEC}, g AS (SELECT track, (re + n) / 2 AS m FROM (SELECT *, lead(rs) OVER (PARTITION BY track ORDER BY rs) AS n FROM rs) WHERE n > re),
b AS (SELECT track, run_id, rs + 900 AS b FROM rs), x AS (SELECT b.track, run_id, b, arg_min(m, (abs(m - b), m)) AS m FROM b LEFT JOIN g ON g.track = b.track GROUP BY ALL)
SELECT track, run_id, round(CASE WHEN abs(m - b) <= 7200 THEN m ELSE b END, 3) AS snapped, coalesce(abs(m - b) <= 7200, false) AS found FROM x"""),
    "interval_coverage": (interval_coverage, f"""WITH {RUNSEC}, b AS (SELECT track, bin, bin * 21600.0::DOUBLE AS s, (bin + 1) * 21600.0::DOUBLE AS e FROM (SELECT DISTINCT track FROM rs), range(120) r(bin))
SELECT b.track, bin::INT AS bin, round(least(coalesce(sum(CASE WHEN re IS NULL THEN 0 ELSE greatest(0, least(e, re) - greatest(s, rs)) END), 0) / 21600, 1), 4) AS coverage FROM b LEFT JOIN rs ON rs.track = b.track AND s < re AND rs.rs < e GROUP BY b.track, bin"""),
    "point_in_interval": (point_in_interval, f"""WITH {RUNSEC} SELECT rs.track, run_id, count(*)::BIGINT AS n_closed, count(*) FILTER (value > 50)::BIGINT AS n_strong, count(*) FILTER (t < re)::BIGINT AS n_half_open
FROM rs JOIN ev ON ev.track = rs.track AND t >= rs.rs AND t <= re GROUP BY rs.track, run_id HAVING count(*) FILTER (t < re) > 0"""),
    "stabbing_first": (stabbing_first, f"WITH {SESS} SELECT event_id, min(sid)::INT AS sid FROM ev JOIN ses ON ses.track = user_id AND t + 3600 >= s AND t + 3600 < e + 7200 GROUP BY event_id"),
    "interval_clip": (interval_clip, f"WITH {SESS} SELECT track, sid, round(greatest(s, 360000), 3) AS rs, round(least(e, 720000), 3) AS re FROM ses WHERE greatest(s, 360000) < least(e, 720000)"),
    "in_window": (in_window, f"WITH {SESS} SELECT track, sid FROM ses WHERE s < 720000 AND e > 360000"),
    "band_filter": (band_filter, f"WITH {RUNSEC}, b AS (SELECT track, min(rs) AS lo, max(re) AS hi FROM rs GROUP BY track) SELECT event_id FROM ev JOIN b USING (track) WHERE t BETWEEN lo - 0.25::DOUBLE AND hi + 0.25::DOUBLE"),
    "positional_zip": (positional_zip, """WITH c AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), z AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
u AS (SELECT conv_id, turn, x[k] AS p, y[k] AS q FROM (SELECT *, unnest(range(1, least(len(x), len(y)) + 1)) AS k FROM z)) SELECT conv_id, turn, count(*)::BIGINT AS n, count(*) FILTER (p = q)::BIGINT AS n_equal FROM u GROUP BY conv_id, turn"""),
    "char_lookup": (char_lookup, """WITH w AS (SELECT item_id, unnest(range(len(ws)))::INT AS wi, unnest(ws) AS w FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark)),
o AS (SELECT *, coalesce(sum(length(w)) OVER (PARTITION BY item_id ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS c0 FROM w),
c AS (SELECT item_id, wi, c0, unnest(range(length(w)))::INT AS ci, w FROM o) SELECT item_id, c0 + ci AS pos, wi, ci, substr(w, ci + 1, 1) AS ch FROM c"""),
    "label_fallback": (label_fallback, "SELECT d.doc_id, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, 'q' || quality::VARCHAR, CASE WHEN source <> 'src0' THEN source END, lang) AS label FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "min_gap_repair": (min_gap_repair, f'WITH RECURSIVE {RUNS}, m(track, run_id, b) AS (SELECT track, run_id, "start" FROM runs WHERE run_id = 0 UNION ALL SELECT runs.track, runs.run_id, greatest(runs."start", m.b + 5) FROM m JOIN runs ON runs.track = m.track AND runs.run_id = m.run_id + 1) SELECT track, run_id, round(b, 3) AS b FROM m'),
    "running_max": (running_max, f"WITH {NR} SELECT track, f, max(y) OVER (PARTITION BY track ORDER BY f) AS m FROM nr"),
    "forward_fill": (forward_fill, f"""WITH {EV}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ev)
SELECT event_id, round(coalesce(last_value(CASE WHEN k % 3 = 0 THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING), 0), 3) AS value, k % 3 <> 0 AS filled FROM k"""),
    "line_spans": (line_spans, f"""WITH {EV}, l AS (SELECT user_id, floor(t / 86400)::INT AS line, min(t) AS s, max(t) AS l FROM ev GROUP BY ALL)
SELECT user_id, line, round(s, 3) AS "start", round(coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY line), l + 1.5::DOUBLE), 3) AS "end", round(l, 3) AS "last" FROM l"""),
    "shared_notes": (shared_notes, f"""WITH {EV}, q AS (SELECT event_id, user_id, floor(t / 7200) * 7200 AS t FROM ev), g AS (SELECT user_id, t, count(*) AS n, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), 2592000.0::DOUBLE) AS stop FROM q GROUP BY user_id, t),
k AS (SELECT q.*, n, stop - q.t AS room, row_number() OVER (PARTITION BY q.user_id, q.t ORDER BY event_id) - 1 AS k FROM q JOIN g ON g.user_id = q.user_id AND g.t = q.t)
SELECT event_id, round(t + room * k / n, 3) AS "start", round(t + room * (k + 1) / n, 3) AS stop FROM k"""),
    "known_neighbours": (known_neighbours, f"""WITH {EV}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ev), v AS (SELECT *, CASE WHEN k % 4 = 1 THEN value END AS v FROM k),
n AS (SELECT event_id, v, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM v)
SELECT event_id, before, after FROM n WHERE v IS NULL"""),
    "neighbour_lines": (neighbour_lines, "SELECT conv_id, turn, lag(text, 1, '') OVER w AS prev, lead(text, 1, '') OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "note_length": (note_length, f"WITH {EV}, d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM ev) SELECT user_id, CASE WHEN count(*) > 2 THEN round(quantile_cont(d, 0.5) * 2, 3) ELSE 0.4 END AS note FROM d GROUP BY user_id"),
    "least_corroborated": (least_corroborated, "SELECT event_id, (event_id % 100)::DOUBLE / 100 AS conf, value FROM events ORDER BY conf, value DESC, event_id LIMIT 6"),
    "previews": (previews, f"WITH {EV}, x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS r FROM ev) SELECT user_id, event_id, k FROM x WHERE k <= 5 OR r <= 5"),
    "error_histogram": (error_histogram, f"""WITH {EV.replace("AS track", "AS kind")}, p AS (SELECT * FROM ev WHERE kind = 'purchase'), c AS (SELECT user_id, t AS m FROM ev WHERE kind <> 'purchase'), d AS (SELECT event_id, min(abs(m - t)) / 3600 AS d FROM p JOIN c USING (user_id) GROUP BY event_id),
b AS (SELECT CASE WHEN d < 0.02 THEN 0 WHEN d < 0.05 THEN 1 WHEN d < 0.1 THEN 2 WHEN d < 0.2 THEN 3 WHEN d < 0.5 THEN 4 WHEN d < 10 THEN 5 END AS bucket FROM d) SELECT bucket::INT AS bucket, count(*)::BIGINT AS n FROM b WHERE bucket IS NOT NULL GROUP BY bucket"""),
}
