"""Queries over text: scans, words, units, apportionment, sets and reports (IO, TX, AG, SO)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import text as tx
from trackloom.functions.units import CUT, GLIDES, PAIRS, SMALL_VOWELS, line_weights, parse_lines, unresolved
from trackloom.operators import apportion as ap
from trackloom.operators.sequences import MatchingBlocks
from trackloom.sources.tables import events, table


def _lines(spark, sf):
    """(doc_id, i, line): non-blank lines of documents with right ends trimmed, densely numbered."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    d = d.withColumn("line", F.rtrim("line")).filter("line <> ''")
    return d.withColumn("i", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).cast("int")).select("doc_id", "i", "line")


def _words(spark, sf):
    """(conv_id, turn, wi, w, m): words of conversation turns and their syllables."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.posexplode(tx.words(F.col("text"))).alias("wi", "w"))
    return c.withColumn("m", tx.latin_syllables(F.col("w")))


def read_lines(spark, sf):
    return _lines(spark, sf).select("doc_id", "i", F.length("line").cast("long").alias("n"))


def words_of_lines(spark, sf):
    x = _lines(spark, sf)
    return x.select("doc_id", "i", F.size(tx.words(F.col("line"))).cast("long").alias("n_words"), F.size(tx.single_split(F.col("line"))).cast("long").alias("n_tokens"))


def line_stats(spark, sf):
    w = _words(spark, sf)
    per = w.groupBy("conv_id", "turn").agg(F.count("*").alias("n_words"), F.sum("m").alias("morae"), F.max("role").alias("role"))
    return per.groupBy("conv_id").agg(F.count("*").alias("n_lines"), F.sum("n_words").alias("n_words"), F.sum("morae").alias("morae"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


def class_totals(spark, sf):
    w = _words(spark, sf)
    g = w.groupBy("role").agg(F.count("*").alias("n"), F.sum("m").alias("morae"), F.countDistinct("w").alias("n_distinct"), F.count_if(F.col("m") > 3).alias("n_long"))
    return g.withColumn("long_share", F.round(F.col("n_long") / F.col("n"), 4))


def repeat_lines(spark, sf):
    g = _lines(spark, sf).groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "i")).alias("f")).filter("n > 1")
    return g.select(F.md5("line").alias("line_md5"), "n", F.col("f.doc_id").alias("first_doc"), F.col("f.i").alias("first_i"))


def unique_lines(spark, sf):
    return _lines(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("line").alias("n_unique"))


def latin_syllables(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("w")).filter(F.col("w").rlike("^[a-z]+$")).distinct()
    return w.select("w", tx.latin_syllables(F.col("w")).alias("n"))


def script_runs(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.posexplode(tx.words(F.col("text"))).alias("wi", "w"))
    x = w.select("doc_id", tx.runs_of(F.col("w")).alias("r"), tx.kind(F.substring("w", 1, 1)).alias("k"))
    return x.groupBy("doc_id").agg(F.sum(F.size("r")).alias("n_runs"), F.count_if(F.col("k") == "latin").alias("n_latin"), F.count_if(F.col("k") == "other").alias("n_other"))


def strip_and_tag(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(tx.words(F.col("text"))).alias("wi", "w"))
    return b.select("item_id", "wi", tx.strip_marks(F.col("w")).alias("bare"), tx.tag(F.concat(F.lit("m/"), "w", F.lit(" v1"))).alias("tag"))


def fold_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.md5(tx.fold(F.col("text"))).alias("folded"))


def script_weights(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(tx.words(F.col("text"))).alias("wi", "w"))
    x = b.select("item_id", tx.script_chunks(F.col("w")).alias("c"), tx.mora_weight(F.col("w")).alias("m"))
    return x.groupBy("item_id").agg(F.sum("c").alias("chunks"), F.round(F.sum("m"), 1).alias("morae"))


def apportion_tokens(spark, sf):
    x = ap.largest_remainder(_words(spark, sf), ["conv_id", "turn"], "wi", "m", F.col("turn") * 7 + 3)
    return x.select("conv_id", "turn", "wi", "n")


def prefix_weights(spark, sf):
    return ap.prefix_sum(_words(spark, sf), ["conv_id", "turn"], "wi", "m", "cum").select("conv_id", "turn", "wi", "cum")


def syllable_map(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", tx.words(F.col("text")).alias("ws"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    lines = c.withColumn("toks", F.lead("ws").over(w)).select("conv_id", "turn", "toks", F.posexplode("ws").alias("wi", "w"))
    lines = lines.withColumn("chunks", tx.script_chunks(F.col("w"))).withColumn("m", tx.mora_weight(F.col("w")))
    line = Window.partitionBy("conv_id", "turn")
    lines = lines.withColumn("method", F.when(F.col("toks").isNull(), "generated").when(F.sum("chunks").over(line) == F.size("toks"), "chunks").otherwise("ratio"))
    x = ap.largest_remainder(lines, ["conv_id", "turn"], "wi", "m", F.coalesce(F.size("toks"), F.lit(0)))
    x = x.withColumn("n", F.when(F.col("method") == "ratio", F.col("n")).when(F.col("method") == "chunks", F.col("chunks")).otherwise(1))
    x = ap.prefix_sum(x, ["conv_id", "turn"], "wi", "n", "cum").withColumn("from", F.col("cum") - F.col("n"))
    syl = F.when(F.col("method") == "generated", F.array(tx.strip_marks(F.col("w")))).otherwise(F.slice("toks", F.col("from").cast("int") + 1, F.col("n").cast("int")))
    return x.select("conv_id", "turn", "wi", "method", F.col("n").cast("long").alias("n"), F.array_join(syl, " ").alias("syl"))


def map_stats(spark, sf):
    x = syllable_map(spark, sf)
    return x.groupBy("method").agg(F.countDistinct("conv_id", "turn").alias("n_lines"), F.count_if(F.col("n") == 0).alias("n_sparse"))


def flatten_units(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(tx.words(F.col("text"))).alias("wi", "w"))
    b = b.withColumn("cls", F.when(F.col("w").rlike("[.,]"), "punct").otherwise("latin")).withColumn("m", tx.latin_syllables(F.col("w")))
    return ap.flatten_units(b, "cls", "m").select("item_id", "wi", "part", "flat_morae")


def mora_slots(spark, sf):
    return ap.slots(_words(spark, sf), "m").select("conv_id", "turn", "wi", "k")


def char_coverage(spark, sf):
    chars = lambda c: F.explode(F.array_distinct(F.split(c, ""))).alias("c")
    has = table(spark, sf, "documents").select("source", chars(F.col("text"))).distinct()
    need = table(spark, sf, "benchmark").select(chars(F.col("text"))).filter("c <> ''").distinct()
    # both sides are bounded by the characters that there are
    x = has.select("source").distinct().crossJoin(F.broadcast(need)).join(has.withColumn("hit", F.lit(1)), ["source", "c"], "left")
    missing = F.col("hit").isNull()
    return x.groupBy("source").agg(F.count_if(missing).alias("n_missing"), F.count_if(missing & (F.ascii("c") >= 128)).alias("n_high"))


def best_source(spark, sf):
    """The source that covers the items' characters best: fewest high ones missing, then fewest at all."""
    x = char_coverage(spark, sf)
    return x.agg(F.min_by("source", F.struct("n_high", "n_missing", "source")).alias("source"), F.min(F.struct("n_high", "n_missing")).alias("m")).select("source", "m.n_high", "m.n_missing")


def stale_cache(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    # the cache knows labelled documents, those of bad quality under an outdated text
    cache = d.join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("sha")).otherwise("").alias("sha"))
    return d.join(cache, ["doc_id", "sha"], "left_anti").select("doc_id")


def distribution(spark, sf):
    e = events(spark, sf)
    return e.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 4).alias("median"), F.round(F.percentile("value", 0.9), 4).alias("p90"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value") < 5).alias("n_low"))


def anomalies(spark, sf):
    e = events(spark, sf).select("event_id", ((F.col("event_id") % 100) / 100).alias("conf"), "value", "t")
    kinds = F.array_compact(F.array(F.when(F.col("conf") < 0.35, "conf"), F.when(F.col("value") > 60, "long"), F.when(F.col("t") > 2500000, "late")))
    return e.select("event_id", F.explode(kinds).alias("anomaly"))


def level_ratio(spark, sf):
    e = events(spark, sf)
    rms = lambda c: F.sqrt(F.avg(F.when(c, F.col("value") * F.col("value"))))
    return e.groupBy("event_type").agg(F.round(20 * F.log10(rms(F.col("t") < 864000) / rms(F.col("t") >= 864000)), 4).alias("db"))


def match_ratio(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.explode(tx.words(F.col("text"))).alias("w"))
    vocabulary = table(spark, sf, "conversations").select(F.explode(tx.words(F.col("text"))).alias("w")).distinct().withColumn("hit", F.lit(1))
    x = b.join(vocabulary, "w", "left")
    return x.groupBy("item_id").agg(F.round(F.sum(F.when(F.col("hit") == 1, F.length("w")).otherwise(0)) / F.greatest(F.sum(F.length("w")), F.lit(1)), 4).alias("ratio"))


def report_rows(spark, sf):
    x = line_stats(spark, sf)
    share = tx.fixed(F.col("n_words") * 100.0 / F.col("morae"), 1, 5)
    row = F.format_string("%5d %4d words %5d morae %s%%", F.col("conv_id"), F.col("n_words"), F.col("morae"), share)
    return x.select("conv_id", F.when(F.col("conv_id").isNotNull(), row).alias("row"))


def distinct_in_order(spark, sf):
    d = table(spark, sf, "conversations").withColumn("ws", tx.words(F.col("text")))
    return d.select("conv_id", "turn", F.array_join(F.array_distinct("ws"), " ").alias("found"), F.size(F.array_distinct("ws")).cast("long").alias("n"))


def matching_blocks(spark, sf):
    """Known texts against noisy ones: each benchmark item with every document that shares any five words in a row with it;
    a text of fewer words has all of them as its only run."""
    def runs(w):
        return F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(F.slice(w, i, 5)))).otherwise(F.array(F.xxhash64(w)))

    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("a"), tx.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("b"), tx.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = b.select("item_id", F.explode(F.array_distinct(runs(F.col("w")))).alias("k"))
    met = d.select("doc_id", F.explode(F.array_distinct(runs(F.col("w")))).alias("k")).join(items, "k").select("item_id", "doc_id").distinct()
    pairs = met.join(b.drop("w"), "item_id").join(d.drop("w"), "doc_id")
    blocks = MatchingBlocks(F.col("a").outer(), F.col("b").outer())
    return pairs.lateralJoin(blocks.alias("m")).select("item_id", "doc_id", F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.size").alias("size"))


def _parsed(spark, sf):
    return parse_lines(table(spark, sf, "benchmark"), ["item_id"], "text")


def token_units(spark, sf):
    u = _parsed(spark, sf).select("item_id", "wi", F.posexplode("units").alias("k", "u"))
    return u.select("item_id", "wi", "k", F.col("u.u").alias("unit"), F.col("u.morae").alias("morae"), F.col("u.lo").alias("lo"), F.col("u.hi").alias("hi"), F.col("u.cls").alias("cls"), F.col("u.lang").alias("lang"))


def line_units(spark, sf):
    return line_weights(_parsed(spark, sf), ["item_id"])


def unresolved_runs(spark, sf):
    """Ideographs stand for every third word, with kana before every sixth: words of either kind need no list."""
    w = table(spark, sf, "benchmark").select("item_id", F.explode(tx.words(F.col("text"))).alias("w"))
    n = F.length("w")
    x = w.select("item_id", "w", F.when(n % 3 == 0, F.concat(F.when(n % 6 == 0, "の").otherwise(""), F.lit("一二!三"))).otherwise(F.col("w")).alias("t"))
    return unresolved(parse_lines(x, ["item_id"], "t", zh=frozenset(["三"])), ["item_id"]).groupBy("item_id", "run").count().withColumnRenamed("count", "n")


def document_json(spark, sf):
    w = _words(spark, sf).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("wi", "w"))).alias("ws"))
    words = F.transform("ws", lambda s: F.struct(s["w"].alias("w"), F.lit(None).cast("array<double>").alias("syl")))
    line = F.struct(F.col("turn").alias("i"), F.array_join(F.col("ws.w"), " ").alias("text"), words.alias("words"))
    return w.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines")).select("conv_id", F.to_json(F.struct("lines"), {"ignoreNullFields": "true"}).alias("doc"))


SYL = "greatest(len(regexp_extract_all({w}, '[aeiouy]+')) - CASE WHEN regexp_matches({w}, 'e$') AND NOT regexp_matches({w}, '(le|ee|ie)$') AND length({w}) > 3 AND len(regexp_extract_all({w}, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1)"
LN = """ln AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INT AS i, line FROM
  (SELECT doc_id, unnest(range(len(l))) AS p, rtrim(unnest(l), ' ') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> '')"""
WORDS = "list_filter(string_split_regex(trim({t}), '\\s+'), lambda w: w <> '')"
WD = f"""wd AS (SELECT conv_id, turn, role, wi::INT AS wi, w, {SYL.format(w='lower(w)')}::INT AS m FROM (SELECT conv_id, turn, role, unnest(range(len(ws))) AS wi, unnest(ws) AS w FROM (SELECT *, {WORDS.format(t='text')} AS ws FROM conversations)))"""
BW = f"bw AS (SELECT item_id, unnest(range(len(ws)))::INT AS wi, unnest(ws) AS w FROM (SELECT item_id, {WORDS.format(t='text')} AS ws FROM benchmark))"
LR = """q AS (SELECT *, CASE WHEN s > 0 THEN m / s ELSE 1.0::DOUBLE / n END * (tot - base * n) AS q FROM (SELECT *, CASE WHEN tot >= n THEN 1 ELSE 0 END AS base FROM (SELECT *, count(*) OVER p AS n, sum(m) OVER p AS s FROM t0 WINDOW p AS (PARTITION BY conv_id, turn)))),
r AS (SELECT *, (tot - base * n) - sum(floor(q)) OVER (PARTITION BY conv_id, turn) AS rest, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(q - floor(q), 9) DESC, wi) AS k FROM q),
lr AS (SELECT *, (CASE WHEN tot <= 0 THEN 0 ELSE base + floor(q) + CASE WHEN k <= rest THEN 1 ELSE 0 END END)::BIGINT AS got FROM r)"""
MARKS = "[!-/:-@\\[-`{-~“”‘’«»„…、。・「」『』？！～]"
MAP = f"""{WD}, c AS (SELECT conv_id, turn, {WORDS.format(t='text')} AS ws FROM conversations), l AS (SELECT conv_id, turn, lead(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS toks FROM c),
kw AS (SELECT conv_id, turn, wi, w, regexp_replace(lower(w), '[^a-z0-9À-ɏ]', '', 'g') AS kept FROM wd),
t0 AS (SELECT kw.*, toks, coalesce(len(toks), 0) AS tot, CASE WHEN kept = '' THEN 0 ELSE greatest(len(regexp_extract_all(kept, '[aeiouy]+')), 1) END::DOUBLE AS m, (kept <> '')::INT AS chunks,
  CASE WHEN toks IS NULL THEN 'generated' WHEN sum((kept <> '')::INT) OVER (PARTITION BY conv_id, turn) = len(toks) THEN 'chunks' ELSE 'ratio' END AS method FROM kw JOIN l USING (conv_id, turn)), {LR},
g AS (SELECT *, CASE method WHEN 'ratio' THEN got WHEN 'chunks' THEN chunks ELSE 1 END AS c FROM lr), h AS (SELECT *, sum(c) OVER (PARTITION BY conv_id, turn ORDER BY wi) AS cum FROM g),
mp AS (SELECT conv_id, turn, wi, method, c::BIGINT AS n, CASE WHEN method = 'generated' THEN coalesce(nullif(lower(regexp_replace(w, '^{MARKS}+|{MARKS}+$', '', 'g')), ''), lower(w)) ELSE array_to_string(toks[(cum - c + 1)::INT:cum::INT], ' ') END AS syl FROM h)"""

COVER = """WITH n AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark), h AS (SELECT DISTINCT source, unnest(string_split(text, '')) AS c FROM documents)
SELECT s.source, count(*) FILTER (h.c IS NULL)::BIGINT AS n_missing, count(*) FILTER (h.c IS NULL AND unicode(n.c) >= 128)::BIGINT AS n_high FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT c FROM n WHERE c <> '') n LEFT JOIN h ON h.source = s.source AND h.c = n.c GROUP BY s.source"""
SQ = CUT.replace("'", "''")
TU = f"""tk AS (SELECT item_id, unnest(range(len(ws)))::INT AS wi, unnest(ws) AS w FROM (SELECT item_id, string_split(coalesce(text, ''), ' ') AS ws FROM benchmark)),
us AS (SELECT item_id, wi, regexp_matches(w, '[{tx.KANA}]') AS ja, unnest(range(len(us)))::INT AS k, unnest(us) AS unit FROM (SELECT *, regexp_extract_all(w, '{SQ}') AS us FROM tk)),
tu AS (SELECT *, CASE WHEN regexp_matches(unit, '[A-Za-z'']') THEN 'latin' WHEN regexp_matches(unit, '[{tx.GLYPH}]') THEN 'cjk' WHEN regexp_matches(unit, '[{tx.KANA}]') THEN 'kana' ELSE 'punct' END AS cls, {SYL.format(w="lower(regexp_extract(unit, '[A-Za-z'']+'))")} AS syl,
  1 + len(regexp_extract_all(substr(regexp_extract(unit, '[{tx.KANA}][{GLIDES}{SMALL_VOWELS}]*'), 2), '[{SMALL_VOWELS}]')) - len(regexp_extract_all(unit, '{"|".join(PAIRS)}')) AS moras FROM us)"""

CATALOGUE = {
    "read_lines": (read_lines, f"WITH {LN} SELECT doc_id, i, length(line)::BIGINT AS n FROM ln"),
    "words_of_lines": (words_of_lines, f"WITH {LN} SELECT doc_id, i, len({WORDS.format(t='line')})::BIGINT AS n_words, len(string_split(line, ' '))::BIGINT AS n_tokens FROM ln"),
    "line_stats": (line_stats, f"WITH {WD} SELECT conv_id, count(DISTINCT turn)::BIGINT AS n_lines, count(*)::BIGINT AS n_words, sum(m)::BIGINT AS morae, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM wd GROUP BY conv_id"),
    "class_totals": (class_totals, f"WITH {WD} SELECT role, count(*)::BIGINT AS n, sum(m)::BIGINT AS morae, count(DISTINCT w)::BIGINT AS n_distinct, count(*) FILTER (m > 3)::BIGINT AS n_long, round(count(*) FILTER (m > 3) / count(*)::DOUBLE, 4) AS long_share FROM wd GROUP BY role"),
    "repeat_lines": (repeat_lines, f"WITH {LN} SELECT md5(line) AS line_md5, count(*)::BIGINT AS n, arg_min(doc_id, (doc_id, i)) AS first_doc, arg_min(i, (doc_id, i)) AS first_i FROM ln GROUP BY line HAVING count(*) > 1"),
    "unique_lines": (unique_lines, f"WITH {LN} SELECT count(*)::BIGINT AS n, count(DISTINCT line)::BIGINT AS n_unique FROM ln"),
    "latin_syllables": (latin_syllables, f"WITH w AS (SELECT DISTINCT w FROM (SELECT unnest({WORDS.format(t='lower(text)')}) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]+')) SELECT w, {SYL.format(w='w')}::INT AS n FROM w"),
    "strip_and_tag": (strip_and_tag, f"WITH {BW} SELECT item_id, wi, coalesce(nullif(lower(regexp_replace(w, '^{MARKS}+|{MARKS}+$', '', 'g')), ''), lower(w)) AS bare, regexp_replace('m/' || w || ' v1', '[^A-Za-z0-9_.-]+', '-', 'g') AS tag FROM bw"),
    "fold_text": (fold_text, "SELECT item_id, md5(regexp_replace(lower(text), '[^a-z0-9À-ɏ]', '', 'g')) AS folded FROM benchmark"),
    "script_weights": (script_weights, f"WITH {BW}, x AS (SELECT item_id, regexp_replace(lower(w), '[^a-z0-9À-ɏ]', '', 'g') AS w FROM bw) SELECT item_id, count(*) FILTER (w <> '')::BIGINT AS chunks, round(sum(CASE WHEN w = '' THEN 0 ELSE greatest(len(regexp_extract_all(w, '[aeiouy]+')), 1) END)::DOUBLE, 1) AS morae FROM x GROUP BY item_id"),
    "script_runs": (script_runs, f"""WITH w AS (SELECT doc_id, unnest({WORDS.format(t='text')}) AS w FROM documents)
SELECT doc_id, sum(len(regexp_extract_all(w, '[A-Za-z'']+|[^A-Za-z'']+')))::BIGINT AS n_runs, count(*) FILTER (regexp_matches(w, '^[A-Za-z'']'))::BIGINT AS n_latin, count(*) FILTER (NOT regexp_matches(w, '^[A-Za-z'']'))::BIGINT AS n_other FROM w GROUP BY doc_id"""),
    "apportion_tokens": (apportion_tokens, f"WITH {WD}, t0 AS (SELECT *, turn * 7 + 3 AS tot FROM wd), {LR} SELECT conv_id, turn, wi, got AS n FROM lr"),
    "prefix_weights": (prefix_weights, f"WITH {WD} SELECT conv_id, turn, wi, sum(m) OVER (PARTITION BY conv_id, turn ORDER BY wi)::BIGINT AS cum FROM wd"),
    "syllable_map": (syllable_map, f"WITH {MAP} SELECT * FROM mp"),
    "map_stats": (map_stats, f"WITH {MAP} SELECT method, count(DISTINCT (conv_id, turn))::BIGINT AS n_lines, count(*) FILTER (n = 0)::BIGINT AS n_sparse FROM mp GROUP BY method"),
    "flatten_units": (flatten_units, f"WITH {BW}, u AS (SELECT item_id, wi, regexp_matches(w, '[.,]') AS p, {SYL.format(w='lower(w)')}::INT AS m FROM bw), x AS (SELECT *, unnest(range(CASE WHEN NOT p AND m > 1 THEN m ELSE 1 END))::INT AS part FROM u) SELECT item_id, wi, part, CASE WHEN NOT p AND m > 1 THEN 1 ELSE m END::INT AS flat_morae FROM x"),
    "mora_slots": (mora_slots, f"WITH {WD} SELECT conv_id, turn, wi, unnest(range(greatest(m, 1)))::INT AS k FROM wd"),
    "char_coverage": (char_coverage, COVER),
    "best_source": (best_source, f"WITH x AS ({COVER}) SELECT source, n_high, n_missing FROM x ORDER BY n_high, n_missing, source LIMIT 1"),
    "stale_cache": (stale_cache, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "distribution": (distribution, "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90, min(value) AS lo, max(value) AS hi, count(*) FILTER (value < 5)::BIGINT AS n_low FROM events GROUP BY event_type"),
    "anomalies": (anomalies, "WITH e AS (SELECT event_id, event_id % 100 / 100.0::DOUBLE AS conf, value, epoch_us(ts)::DOUBLE / 1000000 - 1704067200 AS t FROM events) SELECT event_id, 'conf' AS anomaly FROM e WHERE conf < 0.35::DOUBLE UNION ALL SELECT event_id, 'long' FROM e WHERE value > 60 UNION ALL SELECT event_id, 'late' FROM e WHERE t > 2500000"),
    "level_ratio": (level_ratio, "WITH e AS (SELECT event_type, value, epoch_us(ts)::DOUBLE / 1000000 - 1704067200 AS t FROM events) SELECT event_type, round(20 * log10(sqrt(avg(value * value) FILTER (t < 864000)) / sqrt(avg(value * value) FILTER (t >= 864000))), 4) AS db FROM e GROUP BY event_type"),
    "match_ratio": (match_ratio, f"WITH {BW}, {WD}, v AS (SELECT DISTINCT w FROM wd) SELECT item_id, round(sum(CASE WHEN v.w IS NOT NULL THEN length(bw.w) ELSE 0 END) / greatest(sum(length(bw.w)), 1)::DOUBLE, 4) AS ratio FROM bw LEFT JOIN v USING (w) GROUP BY item_id"),
    "report_rows": (report_rows, f"WITH {WD}, s AS (SELECT conv_id, count(*)::BIGINT AS n, sum(m)::BIGINT AS m FROM wd GROUP BY conv_id) SELECT conv_id, printf('%5d %4d words %5d morae %5.1f%%', conv_id, n, m, n * 100.0::DOUBLE / m) AS \"row\" FROM s"),
    "distinct_in_order": (distinct_in_order, f"WITH {WD}, f AS (SELECT conv_id, turn, w, min(wi) AS wi FROM wd GROUP BY ALL) SELECT conv_id, turn, array_to_string(list(w ORDER BY wi), ' ') AS found, count(*)::BIGINT AS n FROM f GROUP BY conv_id, turn"),
    "matching_blocks": (matching_blocks, None),
    "token_units": (token_units, f"WITH {TU} SELECT item_id, wi, k, unit, CASE cls WHEN 'latin' THEN syl WHEN 'cjk' THEN 1 + ja::INT WHEN 'kana' THEN moras ELSE 0 END::DOUBLE AS morae, CASE cls WHEN 'latin' THEN syl WHEN 'cjk' THEN 1 WHEN 'kana' THEN moras ELSE 0 END::DOUBLE AS lo, CASE cls WHEN 'latin' THEN syl WHEN 'cjk' THEN 1 + 2 * ja::INT WHEN 'kana' THEN moras ELSE 0 END::DOUBLE AS hi, cls, CASE WHEN cls = 'latin' THEN 'en' WHEN cls = 'kana' OR cls = 'cjk' AND ja THEN 'ja' WHEN cls = 'cjk' THEN 'zh' ELSE '--' END AS lang FROM tu"),
    "line_units": (line_units, f"""WITH {TU}, x AS (SELECT item_id, CASE cls WHEN 'latin' THEN syl WHEN 'cjk' THEN 1 WHEN 'kana' THEN moras ELSE 0 END::DOUBLE AS lo, CASE cls WHEN 'latin' THEN syl WHEN 'cjk' THEN 1 + ja::INT WHEN 'kana' THEN moras ELSE 0 END::DOUBLE AS m, CASE cls WHEN 'latin' THEN syl WHEN 'cjk' THEN 1 + 2 * ja::INT WHEN 'kana' THEN moras ELSE 0 END::DOUBLE AS hi,
  CASE WHEN cls = 'latin' THEN 'en' WHEN cls = 'kana' OR cls = 'cjk' AND ja THEN 'ja' WHEN cls = 'cjk' THEN 'zh' END AS lang FROM tu)
SELECT item_id, count(*)::BIGINT AS n_units, sum(lo) AS lo, sum(m) AS morae, sum(hi) AS hi, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS langs FROM x GROUP BY item_id"""),
    "unresolved_runs": (unresolved_runs, f"WITH {BW} SELECT item_id, '一二' AS run, count(*)::BIGINT AS n FROM bw WHERE length(w) % 3 = 0 AND length(w) % 6 <> 0 GROUP BY item_id"),
    "document_json": (document_json, f"""WITH c AS (SELECT conv_id, turn, {WORDS.format(t='text')} AS ws FROM conversations), l AS (SELECT conv_id, turn, '{{"i":' || turn || ',"text":' || to_json(array_to_string(ws, ' '))::VARCHAR || ',"words":[' || array_to_string(list_transform(ws, lambda w: '{{"w":' || to_json(w)::VARCHAR || '}}'), ',') || ']}}' AS line FROM c WHERE len(ws) > 0)
SELECT conv_id, '{{"lines":[' || string_agg(line, ',' ORDER BY turn) || ']}}' AS doc FROM l GROUP BY conv_id"""),
}
