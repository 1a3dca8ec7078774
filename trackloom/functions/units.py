"""Singing units of a token, as Column expressions: one pattern cuts a token into units, the rest is counted in them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.text import APOSTROPHE_LATIN as LATIN
from trackloom.functions.text import GLYPH, KANA, latin_syllables

UNIT = "struct<u:string,morae:double,lo:double,hi:double,cls:string,lang:string,tentative:boolean>"
# fixed values: small kana that merge into the kana before them, the small vowels among them, and the pairs of kana and
# small vowel that are one mora
GLIDES = "ゃゅょャュョ"
SMALL_VOWELS = "ぁぃぅぇぉァィゥェォ"
PAIRS = "ファ フィ フェ フォ ヴァ ヴィ ヴェ ヴォ ウィ ウェ ウォ シェ ジェ チェ ティ ディ トゥ ドゥ ツァ ツィ ツェ ツォ".split()
MARK = f"[^{KANA}{GLYPH}{LATIN}]"
#: A unit: a Latin run, an ideograph, or a kana with the small ones after it, and the marks after that; the marks at the
#: head of a token belong to its first unit, and marks alone are a unit.
CUT = f"(?:^{MARK}+)?(?:[{LATIN}]+|[{GLYPH}]|[{KANA}][{GLIDES}{SMALL_VOWELS}]*){MARK}*|^{MARK}+\\z"


def cut_units(token: Column) -> Column:
    """The texts of a token's units, which joined are the token."""
    return F.regexp_extract_all(token, F.lit(CUT), F.lit(0))


def is_japanese(token: Column, ja: frozenset[str] = frozenset()) -> Column:
    """Tokens with any kana, and listed ones."""
    return token.rlike(f"[{KANA}]") | (token.isin(*ja) if ja else F.lit(False))


def units_column(token: Column, ja: frozenset[str] = frozenset(), zh: frozenset[str] = frozenset()) -> Column:
    """array<UNIT> of a token column. A Latin run weighs its syllables, tentatively; an ideograph 2 (1 to 3, tentative)
    in Japanese tokens, 1 in Chinese ones and in the listed runs zh; kana 1, and 1 more for each small vowel that isn't
    part of a pair; marks alone 0."""
    token = F.coalesce(token, F.lit(""))
    # in `other`, each ideograph of a listed run is another one, so that its unit differs
    other, stand_in = token, GLYPH[0]
    for run in sorted(zh):
        other = F.regexp_replace(other, f"(?<![{GLYPH}]){run}(?![{GLYPH}])", stand_in * len(run))
    listed, japanese = cut_units(other), is_japanese(token, ja)

    def unit(u: Column, k: Column) -> Column:
        latin, glyph, kana = (u.rlike(f"[{c}]") for c in (LATIN, GLYPH, KANA))
        syllables = latin_syllables(F.regexp_extract(u, f"[{LATIN}]+", 0)).cast("double")
        body = F.regexp_extract(u, f"[{KANA}][{GLIDES}{SMALL_VOWELS}]*", 0)
        more = F.regexp_count(F.substring(body, 2, 1 << 30), F.lit(f"[{SMALL_VOWELS}]")) - F.regexp_count(body, F.lit("|".join(PAIRS)))
        ja_glyph = glyph & japanese & (u == F.get(listed, k))
        by_class = lambda a, b, c, d: F.when(latin, a).when(glyph, b).when(kana, c).otherwise(d)
        in_ja = lambda a, b: F.when(ja_glyph, a).otherwise(b)
        moras = F.lit(1.0) + more
        return F.struct(
            u.alias("u"),
            by_class(syllables, in_ja(2.0, 1.0), moras, 0.0).alias("morae"),
            by_class(syllables, F.lit(1.0), moras, 0.0).alias("lo"),
            by_class(syllables, in_ja(3.0, 1.0), moras, 0.0).alias("hi"),
            by_class(F.lit("latin"), F.lit("cjk"), F.lit("kana"), "punct").alias("cls"),
            by_class(F.lit("en"), in_ja("ja", "zh"), F.lit("ja"), "--").alias("lang"),
            by_class(F.lit(True), ja_glyph, F.lit(False), False).alias("tentative"),
        )

    return F.transform(cut_units(token), unit)


def unsettled_runs(token: Column, ja: frozenset[str] = frozenset(), zh: frozenset[str] = frozenset()) -> Column:
    """The runs of ideographs whose language no kana and no list settles."""
    runs = F.regexp_extract_all(token, F.lit(f"[{GLYPH}]+"), F.lit(0))
    open_ = F.filter(runs, lambda r: ~r.isin(*zh)) if zh else runs
    return F.when(is_japanese(token, ja), F.array().cast("array<string>")).otherwise(open_)


def parse_lines(lines: DataFrame, keys: list[str], text: str, ja: frozenset[str] = frozenset(), zh: frozenset[str] = frozenset()) -> DataFrame:
    """(keys, wi, token, units, unsettled) of every token between single blanks; unresolved() reads the side output."""
    x = lines.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), " ", -1)).alias("wi", "token"))
    token = F.col("token")
    return x.select(*keys, "wi", "token", units_column(token, ja, zh).alias("units"), unsettled_runs(token, ja, zh).alias("unsettled"))


def unresolved(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wi, token, run) for each run of ideographs that has to be listed."""
    return parsed.select(*keys, "wi", "token", F.explode("unsettled").alias("run"))


def line_weights(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_units, lo, morae, hi, langs) of each line: bounds of its morae, and the languages other than none."""
    u = parsed.select(*keys, F.explode_outer("units").alias("u"))
    langs = F.array_join(F.array_sort(F.array_remove(F.collect_set("u.lang"), "--")), ",")
    total = lambda name: F.coalesce(F.sum(f"u.{name}"), F.lit(0.0)).alias(name)
    return u.groupBy(*keys).agg(F.count("u").alias("n_units"), total("lo"), total("morae"), total("hi"), langs.alias("langs"))
