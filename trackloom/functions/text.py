"""Scalar text functions as Column expressions; NFKC and the unit rules, which SQL lacks, as Arrow UDFs."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# fixed values: character classes of the orthographies
VOWELS = "aeiouy"
KATA, CJK, LATIN = "・-ヿ", "㐀-䶿一-鿿々豈-\ufaff", "a-z0-9À-ɏ"
#: The classes of singing units: kana letters with the long-vowel mark (not the middle dot and the iteration marks),
#: ideographs of the two main blocks, ASCII letters with the apostrophe.
KANA, GLYPH, APOSTROPHE_LATIN = "ぁ-ゖァ-ヺー", "㐀-䶿一-鿿", "A-Za-z'"
SMALL = "ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮ"
PUNCTUATION = "[!-/:-@\\[-`{-~“”‘’«»„…、。・「」『』？！～]"


def words(text: Column) -> Column:
    """Words between any white space, none empty."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def single_split(text: Column) -> Column:
    """Split at every single blank; neighbouring blanks give empty tokens."""
    return F.split(text, " ", -1)


def latin_syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e (not le, ee, ie; words over three letters), at least one."""
    low = F.lower(word)
    n = F.regexp_count(low, F.lit(f"[{VOWELS}]+"))
    silent = low.rlike("e$") & ~low.rlike("(le|ee|ie)$") & (F.length(low) > 3) & (n > 1)
    return F.greatest(n - F.when(silent, 1).otherwise(0), F.lit(1)).cast("int")


def fixed(x: Column, digits: int, width: int = 0) -> Column:
    """x with so many digits after the point, right-aligned, as C's printf: the double's exact value is rounded, halves
    to the even digit (format_string rounds the shortest decimal form, halves up)."""
    return F.when(x.isNotNull(), F.format_string(f"%{width or ''}s", F.call_function("format_number", x, F.lit("0." + "0" * digits))))


def strip_marks(word: Column) -> Column:
    """Marks off both ends, lowered; the lowered word if nothing is left."""
    bare = F.lower(F.regexp_replace(word, f"^{PUNCTUATION}+|{PUNCTUATION}+$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lower(word))


def tag(name: Column) -> Column:
    """A file-name tag: runs of other characters become one dash."""
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "-")


def kind(ch: Column) -> Column:
    """kana, cjk, latin (ASCII letters and the apostrophe) or other, of one character."""
    is_one_of = lambda cls: ch.rlike(f"^[{cls}]$")
    return F.when(is_one_of(KANA), "kana").when(is_one_of(GLYPH), "cjk").when(is_one_of(APOSTROPHE_LATIN), "latin").otherwise("other")


def runs_of(token: Column) -> Column:
    """Maximal runs of one class; nothing is dropped."""
    classes = (KANA, GLYPH, APOSTROPHE_LATIN, f"^{KANA}{GLYPH}{APOSTROPHE_LATIN}")
    return F.regexp_extract_all(token, F.lit("|".join(f"[{c}]+" for c in classes)), F.lit(0))


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def fold(text: Column, normalise: bool = True) -> Column:
    """NFKC, lower case, and only Latin letters, digits, kana and ideographs kept."""
    return F.regexp_replace(F.lower(nfkc(text) if normalise else text), f"[^{LATIN}぀-ヿ{CJK}豈-﫿]", "")


def class_runs(text: Column, normalise: bool = True) -> Column:
    """[(class, run)]: K ideographs, T the marks after katakana, H other kana, L Latin and digits. Characters of no
    class don't break a run. Katakana letters are of class H, and the long-vowel mark is T: T is tried first, but
    covers only U+30FB-30FF."""
    x = F.regexp_replace(F.lower(nfkc(text) if normalise else text), f"[^{CJK}{KATA}぀-ヺ{LATIN}]", "")
    found = F.regexp_extract_all(x, F.lit(f"([{CJK}]+|[{KATA}]+|[぀-ヺ]+|[{LATIN}]+)"), F.lit(1))
    return F.transform(found, lambda r: F.struct(F.when(r.rlike(f"^[{CJK}]"), "K").when(r.rlike(f"^[{KATA}]"), "T").when(r.rlike("^[぀-ヺ]"), "H").otherwise("L").alias("cls"), r.alias("run")))


def script_chunks(text: Column, normalise: bool = True) -> Column:
    """Class runs counted, ideographs with the kana right after them once."""
    return F.regexp_count(F.array_join(F.transform(class_runs(text, normalise), lambda r: r["cls"]), ""), F.lit("KH|K|H|T|L"))


def mora_weight(text: Column, normalise: bool = True) -> Column:
    """Latin runs: vowel groups, at least 1; ideographs 2 each; kana 1, small kana .5 unless first of their run."""

    def of(r: Column) -> Column:
        latin = F.greatest(F.regexp_count(r["run"], F.lit(f"[{VOWELS}]+")), F.lit(1)).cast("double")
        small = F.regexp_count(F.substring(r["run"], 2, 1 << 30), F.lit(f"[{SMALL}]"))
        return F.when(r["cls"] == "L", latin).when(r["cls"] == "K", 2.0 * F.length(r["run"])).otherwise(F.length(r["run"]) - 0.5 * small)

    return F.aggregate(class_runs(text, normalise), F.lit(0.0), lambda acc, r: acc + of(r))
