"""Constraint queries: each returns the rows that violate a rule, (rule, keys...), none if all holds."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _as(rows: DataFrame, rule: str, keys: list[str], bad) -> DataFrame:
    return rows.filter(bad).select(F.lit(rule).alias("rule"), *keys)


def check_units(lines: DataFrame, keys: list[str], text: str, words: str, units: str) -> DataFrame:
    """words (array<string>) rebuild the text, units (array<array<struct<u, morae, cls>>>) rebuild the words; no unit
    is empty, none but marks weighs nothing."""
    rebuilt = F.transform(units, lambda us: F.array_join(F.transform(us, lambda u: u["u"]), ""))
    flat = F.flatten(units)
    found = [
        _as(lines, "text", keys, F.array_join(words, " ") != F.col(text)),
        _as(lines, "token", keys, rebuilt != F.col(words)),
        _as(lines, "empty", keys, F.exists(flat, lambda u: u["u"] == "")),
        _as(lines, "weight", keys, F.exists(flat, lambda u: (u["morae"] <= 0) & (u["cls"] != "punct"))),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def check_map(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, words, tokens) against what is wanted: missing or extra lines, text, word list, and, where the
    words agree, tokens."""
    w = wanted.select(*keys, F.col("text").alias("_t"), F.col("words").alias("_w"), F.col("tokens").alias("_k"), F.lit(1).alias("_b"))
    x = found.withColumn("_a", F.lit(1)).join(w, keys, "full_outer")
    rule = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(F.col("text") != F.col("_t"), "text").when(F.col("words") != F.col("_w"), "words").when(F.col("tokens") != F.col("_k"), "tokens")
    return x.withColumn("rule", rule).filter("rule IS NOT NULL").select("rule", *keys)


def check_document(lines: DataFrame, keys: list[str], n_lines: int | None = None) -> DataFrame:
    """lines (keys, i, text, start, end, words array<struct<w, start, end, conf, syl array<struct<start, end>>>>)."""
    w = Window.partitionBy(*keys).orderBy("i")
    x = lines.withColumn("_i", F.row_number().over(w) - 1).withColumn("_prev", F.lag("end").over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    ks, ws = [*keys, "i"], F.col("words")
    pair = F.transform(F.sequence(F.lit(2), F.greatest(F.size(ws), F.lit(2))), lambda k: F.when(k <= F.size(ws), F.element_at(ws, k)["start"] < F.element_at(ws, k - 1)["end"] - 1e-9))
    syl = lambda f: F.exists(F.filter(ws, lambda v: F.size(v["syl"]) > 0), f)
    gaps = lambda v: F.exists(F.sequence(F.lit(1), F.size(v["syl"]) - 1), lambda k: F.abs(F.element_at(v["syl"], k + 1)["start"] - F.element_at(v["syl"], k)["end"]) > 5e-4)
    rules = {
        "sequence": F.col("i") != F.col("_i"),
        "text": F.array_join(F.transform(ws, lambda v: v["w"]), " ") != F.col("text"),
        "line start": F.col("start") != F.element_at(ws, 1)["start"],
        "line end": F.col("end") != F.element_at(ws, -1)["end"],
        "line order": F.col("start") < F.col("_prev") - 1e-9,
        "word order": F.exists(pair, lambda b: F.coalesce(b, F.lit(False))),
        "word span": F.exists(ws, lambda v: v["start"] >= v["end"]),
        "confidence": F.exists(ws, lambda v: (v["conf"] < 0) | (v["conf"] > 1)),
        "syllable count": F.exists(ws, lambda v: F.size(v["syl"]) == 1),
        "syllable bounds": syl(lambda v: (F.abs(F.element_at(v["syl"], 1)["start"] - v["start"]) > 5e-4) | (F.abs(F.element_at(v["syl"], -1)["end"] - v["end"]) > 5e-4)),
        "syllable span": syl(lambda v: F.exists(v["syl"], lambda s: s["end"] <= s["start"])),
        "syllable gap": F.exists(F.filter(ws, lambda v: F.size(v["syl"]) > 1), gaps),
    }
    if n_lines is not None:
        rules["line count"] = (F.col("_n") != n_lines) & (F.col("_i") == 0)
    # one pass over the lines: all rules are tested in one projection
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items()]))
    return x.select(F.explode(broken).alias("rule"), *ks)


def check_allocation(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, start, end, ratio, density) with implausible length, rate or onset density."""
    d = F.col("end") - F.col("start")
    kinds = F.array_compact(F.array(F.when(d < 0.25, "short"), F.when(d > 12, "long"), F.when(~F.col("ratio").between(0.5, 2.0), "ratio"), F.when(~F.col("density").between(0.4, 3.5), "density")))
    return lines.select(F.explode(kinds).alias("rule"), *keys)
