"""Queries over framed tracks and spectra (SG and GP operators)."""

from pyspark.sql import functions as F

from trackloom.operators import folds, frames as fr, gating as gp, intervals
from trackloom.plans.tracks import EV, FR, NR, RUNS, SP, hourly, normal, runs, spectra
from trackloom.sources.tables import events, table

K = ["track"]
r4 = lambda c: F.round(c, 4)


def hourly_frames(spark, sf):
    return hourly(spark, sf).select("track", "f", "x", fr.n_frames(F.col("f") * 441 + 200, 44100.0, 100.0).alias("n"))


def env_rms(spark, sf):
    return fr.frame_rms(hourly(spark, sf), K, "f", "x", 8, 4).select("track", "f", r4("rms").alias("rms"))


def env_smooth(spark, sf):
    return folds.follower(normal(spark, sf), K, "y").select("track", "f", r4("y").alias("y"))


def env_norm01(spark, sf):
    return normal(spark, sf).select("track", "f", "y")


def median_normalised(spark, sf):
    return fr.median_filter(hourly(spark, sf), K, "f", "x", 17).select("track", "f", r4("med").alias("med"), r4(F.col("x") / (F.col("med") + 1)).alias("rel"))


def hpss_masks(spark, sf):
    return fr.soft_masks(spectra(spark, sf), K, 17, "time").select("track", "f", "bin", r4("mask").alias("mask"))


def flux_flatness(spark, sf):
    x = fr.spectral_features(spectra(spark, sf), K)
    return x.select("track", "f", r4("presence").alias("presence"), r4("flux").alias("flux"), r4("flatness").alias("flatness"))


def voice_features(spark, sf):
    bank = fr.mel_bank(spark, 8, 64, 125.0, 100.0, 8000.0)
    x = fr.voice_features(spectra(spark, sf), bank, K, 8, 40)
    return x.select("track", "f", r4("presence").alias("presence"), r4("strength").alias("strength"), r4("flatness").alias("flatness"))


def feature_record(spark, sf):
    """The features of a track side by side: envelopes, gate, runs and the strength where the voice is there. Loudness is
    the hourly track, voice the spectra of the same number of frames."""
    bank = fr.mel_bank(spark, 8, 64, 125.0, 100.0, 8000.0)
    voice = fr.voice_features(spectra(spark, sf), bank, K, 8, 40)
    presence = folds.follower(voice, K, "presence").select("track", "f", F.col("y").alias("vocal_raw"))
    vocal = fr.norm01(presence, K, "vocal_raw").select("track", "f", "vocal_raw", F.col("y").alias("vocal"))
    runs = gp.phrase_runs(vocal, K, "vocal", on=0.18, off=0.10)
    x = voice.join(vocal, ["track", "f"]).withColumn("strength", fr.masked(F.col("vocal"), 0.05, F.col("strength"))).withColumn("t", F.col("f") / 100.0)
    inside = intervals.stab_first(x.select("track", "f", "t"), runs.withColumnRenamed("start", "s").withColumnRenamed("end", "e"), K, ["f"], ["run_id"], 1.0)
    x = x.join(inside.select("track", "f", "run_id"), ["track", "f"], "left")
    return x.select("track", "f", r4("vocal_raw").alias("vocal_raw"), r4("vocal").alias("vocal"), r4("strength").alias("strength"), r4("flatness").alias("flatness"), "run_id")


def mel_band_energy(spark, sf):
    bank = fr.mel_bank(spark, 8, 64, 125.0, 100.0, 8000.0)
    return fr.mel_bands(spectra(spark, sf), bank, K).select("track", "f", "band", r4("e").alias("e"))


def mel_scale(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", fr.hz_to_mel(F.col("p_retailprice")).alias("m"))
    return p.select("p_partkey", r4("m").alias("mel"), r4(fr.mel_to_hz(F.col("m"))).alias("hz"))


def dft_blocks(spark, sf):
    return fr.dft(normal(spark, sf), K, 16, 8, "y").select("track", "block", "bin", r4("mag").alias("mag"))


def gate_and_mask(spark, sf):
    x = fr.median_filter(hourly(spark, sf), K, "f", "x", 17).withColumn("gate", r4(fr.gate_level(F.col("x") / (F.col("med") + 1))))
    return x.select("track", "f", "gate", fr.masked(F.col("gate"), 0.56, F.col("x")).alias("strength"))


def activity_thresholds(spark, sf):
    return fr.activity(hourly(spark, sf), K, "x", [-40, -30, -20, -10], 1.0)


def slide_track(spark, sf):
    x = hourly(spark, sf)
    late, early = fr.slide(x, K, 7, 720).withColumnRenamed("x", "late"), fr.slide(x, K, -7, 720).withColumnRenamed("x", "early")
    return late.join(early, ["track", "f"])


def phrase_runs(spark, sf):
    return runs(spark, sf).select("track", "run_id", "start", "end", r4("mean").alias("mean"), r4("peak").alias("peak"))


def phrase_runs_events(spark, sf):
    ev = events(spark, sf).select(F.col("event_type").alias("track"), F.floor(F.col("t") / 3600).alias("h"))
    n = ev.groupBy("track", "h").count()
    spans = phrase_runs(spark, sf).withColumn("s", F.col("start")).withColumn("e", F.col("end"))
    inside = intervals.points_in(spans, n.withColumn("t", F.col("h").cast("double")), K, 24.0)
    return inside.groupBy("track", "run_id", "start", "end", "mean", "peak").agg(F.sum("count").alias("n_events"))


def act_runs(spark, sf):
    return gp.active_runs(normal(spark, sf), K, "y", 0.3, fps=1.0, min_s=3.0)


def local_peaks(spark, sf):
    return gp.local_peaks(normal(spark, sf), K, "y", 0.25)


def act_end(spark, sf):
    points = runs(spark, sf).select("track", F.col("run_id").alias("id"), (F.col("start") + 1).alias("t"))
    return gp.quiet_from(points, normal(spark, sf), K, "y", fps=1.0, threshold=0.15, gap=2.0)


def unit_gaps(spark, sf):
    from pyspark.sql import Window

    e = events(spark, sf)
    day = F.floor(F.col("t") / 86400).cast("int").alias("day")
    u = e.select("user_id", day, "event_id", F.col("t").alias("start"), (F.col("t") + F.col("value")).alias("end"))
    g = gp.gaps_within(u.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("start", "event_id"))), ["user_id", "day"], "k", 7200.0)
    return g.select("user_id", "day", F.round("gap_start", 3).alias("gap_start"), F.round("gap_end", 3).alias("gap_end"))


def autocorr_period(spark, sf):
    ac = gp.autocorrelation(normal(spark, sf), K, "y", 12, 60)
    return gp.period(ac.withColumn("ac", F.round("ac", 8)), K).select("track", "lag", r4("ac_peak").alias("ac_peak"), r4("refined").alias("refined"))


def phase_grid(spark, sf):
    periods = spark.createDataFrame([("click", 24.0), ("view", 23.5), ("purchase", 12.25)], "track string, period double")
    per = normal(spark, sf).select("track").distinct().join(F.broadcast(periods), "track", "left").fillna(24.0)
    return gp.phase(normal(spark, sf).withColumn("y", F.round("y", 6)), per, K, "y").select("track", "offset", r4("score").alias("score"))


def beat_sequence(spark, sf):
    tracks = normal(spark, sf).select("track").distinct().withColumn("phase", F.length("track").cast("double")).withColumn("period", F.lit(23.75))
    return gp.beats(tracks, K, 720.0)


#: Harmonic presence and flatness of bins 8 to 39 (v), mean rise of the log band energies (fl).
VOICE = f"""{SP}, vb AS (SELECT * FROM sx WHERE bin >= 8 AND bin < 40), w AS (SELECT *, max(f) OVER (PARTITION BY track) AS n FROM vb),
a AS (SELECT track, bin, f, s FROM w UNION ALL SELECT track, bin, -k, s FROM w, range(1, 9) r(k) WHERE f = 0 UNION ALL SELECT track, bin, n + k, s FROM w, range(1, 9) r(k) WHERE f = n),
h AS (SELECT track, bin, f, quantile_cont(s, 0.5) OVER (PARTITION BY track, bin ORDER BY f ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS h FROM a),
b AS (SELECT track, bin, f, s FROM w UNION ALL SELECT track, 8 - k, f, s FROM w, range(1, 9) r(k) WHERE bin = 8 UNION ALL SELECT track, 39 + k, f, s FROM w, range(1, 9) r(k) WHERE bin = 39),
p AS (SELECT track, bin, f, quantile_cont(s, 0.5) OVER (PARTITION BY track, f ORDER BY bin ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS p FROM b),
v AS (SELECT track, f, sqrt(sum(pow(s * (h * h / (h * h + p * p + 1e-12::DOUBLE)), 2))) AS presence, exp(avg(ln(s + 1e-10::DOUBLE))) / (avg(s) + 1e-10::DOUBLE) AS flatness FROM h JOIN p USING (track, f, bin) JOIN w USING (track, f, bin) GROUP BY track, f),
c AS (SELECT k, 700 * (pow(10, (2595 * log10(1 + 100.0::DOUBLE / 700) + (2595 * log10(1 + 8000.0::DOUBLE / 700) - 2595 * log10(1 + 100.0::DOUBLE / 700)) * k / 9) / 2595) - 1) AS hz FROM range(10) r(k)),
mb AS (SELECT x.k::INT AS band, bin::INT AS bin, greatest(least((bin * 125.0::DOUBLE - x.hz) / (m.hz - x.hz), (z.hz - bin * 125.0::DOUBLE) / (z.hz - m.hz)), 0) AS wt FROM c x JOIN c m ON m.k = x.k + 1 JOIN c z ON z.k = x.k + 2, range(64) r(bin)),
en AS (SELECT track, f, band, ln(sum(wt * s) + 1e-10::DOUBLE) AS g FROM sx JOIN mb USING (bin) WHERE wt > 0 GROUP BY track, f, band),
fl AS (SELECT track, f, avg(r) AS strength FROM (SELECT track, f, coalesce(greatest(g - lag(g) OVER (PARTITION BY track, band ORDER BY f), 0), 0) AS r FROM en) GROUP BY track, f)"""

CATALOGUE = {
    "hourly_frames": (hourly_frames, f"WITH {FR} SELECT track, f, x, round_even((f * 441 + 200)::DOUBLE / 44100.0::DOUBLE * 100.0::DOUBLE, 0)::BIGINT AS n FROM fr"),
    "env_rms": (env_rms, f"WITH {FR} SELECT track, (f / 4)::INT AS f, round(r, 4) AS rms FROM (SELECT track, f, sqrt(sum(x * x) OVER (PARTITION BY track ORDER BY f ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8) AS r FROM fr) WHERE f % 4 = 0"),
    "env_smooth": (env_smooth, f"""WITH RECURSIVE {NR}, m AS MATERIALIZED (SELECT track, list(y ORDER BY f) AS ys FROM nr GROUP BY track),
s(track, f, v) AS (SELECT track, 0, CASE WHEN ys[1] > 0 THEN (1 - exp(-1.0::DOUBLE)) * ys[1] ELSE (1 - exp(-1 / 9.0::DOUBLE)) * ys[1] END FROM m
UNION ALL SELECT m.track, s.f + 1, CASE WHEN ys[s.f + 2] > v THEN exp(-1.0::DOUBLE) * v + (1 - exp(-1.0::DOUBLE)) * ys[s.f + 2] ELSE exp(-1 / 9.0::DOUBLE) * v + (1 - exp(-1 / 9.0::DOUBLE)) * ys[s.f + 2] END FROM s JOIN m USING (track) WHERE s.f < 719)
SELECT track, f, round(v, 4) AS y FROM s"""),
    "env_norm01": (env_norm01, f"WITH {NR} SELECT track, f, y FROM nr"),
    "median_normalised": (median_normalised, f"""WITH {FR}, e AS (SELECT track, f, x FROM fr UNION ALL SELECT track, -k, x FROM fr, range(1, 9) r(k) WHERE f = 0 UNION ALL SELECT track, 719 + k, x FROM fr, range(1, 9) r(k) WHERE f = 719),
m AS (SELECT track, f, x, quantile_cont(x, 0.5) OVER (PARTITION BY track ORDER BY f ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS med FROM e)
SELECT track, f::INT AS f, round(med, 4) AS med, round(x / (med + 1), 4) AS rel FROM m WHERE f BETWEEN 0 AND 719"""),
    "hpss_masks": (hpss_masks, f"""WITH {SP}, w AS (SELECT *, max(f) OVER (PARTITION BY track) AS n FROM sx),
a AS (SELECT track, bin, f, s FROM w UNION ALL SELECT track, bin, -k, s FROM w, range(1, 9) r(k) WHERE f = 0 UNION ALL SELECT track, bin, n + k, s FROM w, range(1, 9) r(k) WHERE f = n),
h AS (SELECT track, bin, f, quantile_cont(s, 0.5) OVER (PARTITION BY track, bin ORDER BY f ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS h FROM a),
b AS (SELECT track, bin, f, s FROM w UNION ALL SELECT track, -k, f, s FROM w, range(1, 9) r(k) WHERE bin = 0 UNION ALL SELECT track, 63 + k, f, s FROM w, range(1, 9) r(k) WHERE bin = 63),
p AS (SELECT track, bin, f, quantile_cont(s, 0.5) OVER (PARTITION BY track, f ORDER BY bin ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS p FROM b)
SELECT track, f::INT AS f, bin::INT AS bin, round(h * h / (h * h + p * p + 1e-12::DOUBLE), 4) AS mask FROM h JOIN p USING (track, f, bin) JOIN w USING (track, f, bin)"""),
    "flux_flatness": (flux_flatness, f"""WITH {SP}, l AS (SELECT *, ln(s + 1e-10::DOUBLE) AS g, lag(ln(s + 1e-10::DOUBLE)) OVER (PARTITION BY track, bin ORDER BY f) AS p FROM sx)
SELECT track, f, round(sqrt(sum(s * s)), 4) AS presence, round(avg(coalesce(greatest(g - p, 0), 0)), 4) AS flux, round(exp(avg(g)) / (avg(s) + 1e-10::DOUBLE), 4) AS flatness FROM l GROUP BY track, f"""),
    "mel_band_energy": (mel_band_energy, f"""WITH {SP}, c AS (SELECT k, 700 * (pow(10, (2595 * log10(1 + 100.0::DOUBLE / 700) + (2595 * log10(1 + 8000.0::DOUBLE / 700) - 2595 * log10(1 + 100.0::DOUBLE / 700)) * k / 9) / 2595) - 1) AS hz FROM range(10) r(k)),
b AS (SELECT a.k::INT AS band, bin::INT AS bin, greatest(least((bin * 125.0::DOUBLE - a.hz) / (m.hz - a.hz), (z.hz - bin * 125.0::DOUBLE) / (z.hz - m.hz)), 0) AS w FROM c a JOIN c m ON m.k = a.k + 1 JOIN c z ON z.k = a.k + 2, range(64) r(bin))
SELECT track, f, band, round(sum(w * s), 4) AS e FROM sx JOIN b USING (bin) WHERE w > 0 GROUP BY track, f, band"""),
    "voice_features": (voice_features, f"""WITH {VOICE}
SELECT track, f::INT AS f, round(presence, 4) AS presence, round(strength, 4) AS strength, round(flatness, 4) AS flatness FROM v JOIN fl USING (track, f)"""),
    "feature_record": (feature_record, f"""WITH RECURSIVE {VOICE},
vs AS MATERIALIZED (SELECT track, list(presence ORDER BY f) AS ys FROM v GROUP BY track),
sm(track, f, y) AS (SELECT track, 0, (1 - exp(CASE WHEN ys[1] > 0 THEN -1.0::DOUBLE ELSE -1 / 9.0::DOUBLE END)) * ys[1] FROM vs
UNION ALL SELECT vs.track, sm.f + 1, y * exp(CASE WHEN ys[sm.f + 2] > y THEN -1.0::DOUBLE ELSE -1 / 9.0::DOUBLE END) + (1 - exp(CASE WHEN ys[sm.f + 2] > y THEN -1.0::DOUBLE ELSE -1 / 9.0::DOUBLE END)) * ys[sm.f + 2] FROM sm JOIN vs USING (track) WHERE sm.f + 1 < len(ys)),
vo AS (SELECT track, f, y AS vocal_raw, least(greatest(y / (quantile_cont(y, 0.99) OVER (PARTITION BY track) + 1e-12::DOUBLE), 0), 1) AS vocal FROM sm),
on_ AS (SELECT *, coalesce(last_value(CASE WHEN vocal > 0.18::DOUBLE THEN 1 WHEN vocal <= 0.10::DOUBLE THEN 0 END IGNORE NULLS) OVER (PARTITION BY track ORDER BY f ROWS UNBOUNDED PRECEDING), 0) AS active FROM vo),
o1 AS (SELECT track, min(f) AS a, max(f) AS b FROM (SELECT track, f, f - row_number() OVER (PARTITION BY track ORDER BY f) AS g FROM on_ WHERE active = 1) GROUP BY track, g),
o2 AS (SELECT *, sum(CASE WHEN (a - pb) / 100.0::DOUBLE < 0.15::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY a) AS g FROM (SELECT *, lag(b) OVER (PARTITION BY track ORDER BY a) AS pb FROM o1)),
o3 AS (SELECT track, min(a) AS a, max(b) AS b FROM o2 GROUP BY track, g HAVING (max(b) - min(a) + 1) / 100.0::DOUBLE >= 0.15::DOUBLE),
o4 AS (SELECT *, (row_number() OVER (PARTITION BY track ORDER BY a) - 1)::INT AS run_id FROM o3)
SELECT vo.track, vo.f, round(vocal_raw, 4) AS vocal_raw, round(vocal, 4) AS vocal, round(CASE WHEN vocal > 0.05::DOUBLE THEN strength ELSE 0 END, 4) AS strength, round(flatness, 4) AS flatness, run_id
FROM vo JOIN v ON v.track = vo.track AND v.f = vo.f JOIN fl ON fl.track = vo.track AND fl.f = vo.f LEFT JOIN o4 ON o4.track = vo.track AND vo.f BETWEEN o4.a AND o4.b"""),
    "mel_scale": (mel_scale, "SELECT p_partkey, round(m, 4) AS mel, round(700 * (pow(10, m / 2595) - 1), 4) AS hz FROM (SELECT p_partkey, 2595 * log10(1 + p_retailprice / 700) AS m FROM part)"),
    "dft_blocks": (dft_blocks, f"""WITH {NR}, k AS (SELECT b.k AS bin, j, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 15) AS w, 2 * pi() * b.k * j / 16 AS a FROM range(9) b(k), range(16) r(j))
SELECT track, block::INT AS block, bin::INT AS bin, round(sqrt(pow(sum(y * w * cos(a)), 2) + pow(sum(y * w * sin(a)), 2)), 4) AS mag FROM range(89) r(block) JOIN nr ON f >= block * 8 AND f < block * 8 + 16 JOIN k ON j = f - block * 8 GROUP BY track, block, bin"""),
    "gate_and_mask": (gate_and_mask, f"""WITH {FR}, e AS (SELECT track, f, x FROM fr UNION ALL SELECT track, -k, x FROM fr, range(1, 9) r(k) WHERE f = 0 UNION ALL SELECT track, 719 + k, x FROM fr, range(1, 9) r(k) WHERE f = 719),
m AS (SELECT track, f, x, quantile_cont(x, 0.5) OVER (PARTITION BY track ORDER BY f ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS med FROM e),
g AS (SELECT track, f::INT AS f, x, round(least(greatest(log10(x / (med + 1) + 1e-12::DOUBLE) / 0.4::DOUBLE + 0.5::DOUBLE, 0), 1), 4) AS gate FROM m WHERE f BETWEEN 0 AND 719)
SELECT track, f, gate, CASE WHEN gate > 0.56 THEN x ELSE 0 END AS strength FROM g"""),
    "activity_thresholds": (activity_thresholds, f"""WITH {FR}, d AS (SELECT *, 20 * log10(greatest(x, 1e-12::DOUBLE) / greatest(max(x) OVER (PARTITION BY track), 1e-12::DOUBLE)) AS db FROM fr)
SELECT track, level::INT AS level, min(f)::DOUBLE AS first_s, max(f)::DOUBLE AS last_s, count(*)::DOUBLE AS seconds FROM d, unnest([-40, -30, -20, -10]) l(level) WHERE db > level GROUP BY track, level"""),
    "slide_track": (slide_track, f"WITH {FR} SELECT track, f, coalesce(lag(x, 7) OVER w, 0) AS late, coalesce(lead(x, 7) OVER w, 0) AS early FROM fr WINDOW w AS (PARTITION BY track ORDER BY f)"),
    "phrase_runs": (phrase_runs, f'WITH {RUNS} SELECT runs.track, run_id, "start", "end", round(avg(y), 4) AS mean, round(max(y), 4) AS peak FROM runs JOIN nr ON nr.track = runs.track AND f BETWEEN a AND b GROUP BY ALL'),
    "phrase_runs_events": (phrase_runs_events, f"""WITH {RUNS}, p AS (SELECT runs.track, run_id, "start", "end", a, b, round(avg(y), 4) AS mean, round(max(y), 4) AS peak FROM runs JOIN nr ON nr.track = runs.track AND f BETWEEN a AND b GROUP BY ALL)
SELECT p.track, run_id, "start", "end", mean, peak, count(*)::BIGINT AS n_events FROM p JOIN ev ON ev.track = p.track AND floor(ev.t / 3600) >= "start" AND floor(ev.t / 3600) < "end" GROUP BY ALL"""),
    "act_runs": (act_runs, f"""WITH {NR}, i AS (SELECT track, f, f - row_number() OVER (PARTITION BY track ORDER BY f) AS g FROM nr WHERE y > 0.3)
SELECT track, min(f)::DOUBLE AS "start", (max(f) + 1)::DOUBLE AS "end" FROM i GROUP BY track, g HAVING max(f) - min(f) + 1 >= 3"""),
    "local_peaks": (local_peaks, f"""WITH {NR}, c AS (SELECT *, sum(n) OVER (PARTITION BY track ORDER BY f) AS g FROM (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY track ORDER BY f) THEN 0 ELSE 1 END AS n FROM nr)),
q AS (SELECT track, g, min(f) AS a, max(f) AS b, min(y) AS y FROM c GROUP BY track, g), z AS (SELECT *, lag(y) OVER w AS l, lead(y) OVER w AS r FROM q WINDOW w AS (PARTITION BY track ORDER BY g))
SELECT track, ((a + b) // 2)::INT AS f, y FROM z WHERE y > l AND y > r AND y >= 0.25"""),
    "act_end": (act_end, f"""WITH {RUNS}, qi AS (SELECT track, f, f - row_number() OVER (PARTITION BY track ORDER BY f) AS g FROM nr WHERE y <= 0.15),
q AS (SELECT track, min(f) AS qs, max(f) + 1 AS qe FROM qi GROUP BY track, g)
SELECT runs.track, run_id AS id, "start" + 1 AS t, min(greatest(qs, a + 1)) FILTER (qe - greatest(qs, a + 1) >= 2)::DOUBLE AS t_end FROM runs LEFT JOIN q ON q.track = runs.track GROUP BY ALL"""),
    "unit_gaps": (unit_gaps, f"""WITH {EV}, u AS (SELECT user_id, floor(t / 86400)::INT AS day, t + value AS e, lead(t) OVER (PARTITION BY user_id, floor(t / 86400)::INT ORDER BY t, event_id) AS n FROM ev)
SELECT user_id, day, round(e, 3) AS gap_start, round(n, 3) AS gap_end FROM u WHERE n - e >= 7200"""),
    "autocorr_period": (autocorr_period, f"""WITH {NR}, d AS (SELECT track, f, y - avg(y) OVER (PARTITION BY track) AS d FROM nr), z AS (SELECT track, sum(d * d) AS z FROM d GROUP BY track),
a AS (SELECT a.track, lag, round(sum(a.d * b.d) / max(z.z), 8) AS ac FROM d a JOIN range(12, 60) r(lag) ON true JOIN d b ON b.track = a.track AND b.f = a.f + lag JOIN z ON z.track = a.track GROUP BY a.track, lag),
n AS (SELECT *, lag(ac) OVER w AS p, lead(ac) OVER w AS q FROM a WINDOW w AS (PARTITION BY track ORDER BY lag)), b AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ac DESC, lag) AS k FROM n)
SELECT track, lag::INT AS lag, round(ac, 4) AS ac_peak, round(lag + coalesce(CASE WHEN p - 2 * ac + q <> 0 THEN 0.5 * (p - q) / (p - 2 * ac + q) END, 0), 4) AS refined FROM b WHERE k = 1"""),
    "phase_grid": (phase_grid, f"""WITH {NR}, p AS (SELECT DISTINCT track, CASE track WHEN 'view' THEN 23.5::DOUBLE WHEN 'purchase' THEN 12.25::DOUBLE ELSE 24.0::DOUBLE END AS period FROM nr),
g AS (SELECT track, period, o, m, round_even(o + m * period, 0)::INT AS f FROM p, range(24) r(o), range(60) q(m) WHERE o < ceil(period) AND m <= floor((719 - o) / period)),
s AS (SELECT track, o, sum(y) AS score FROM g JOIN nr USING (track, f) GROUP BY track, o), b AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, o) AS k FROM s)
SELECT track, o::INT AS "offset", round(score, 4) AS score FROM b WHERE k = 1"""),
    "beat_sequence": (beat_sequence, f"WITH {EV}, p AS (SELECT DISTINCT track, length(track)::DOUBLE AS ph FROM ev) SELECT track, k::INT AS k, ph + k * 23.75::DOUBLE AS t FROM p, range(60) r(k) WHERE ph + k * 23.75::DOUBLE < 720"),
}
