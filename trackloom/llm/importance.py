"""Quality classifier by importance resampling: two generative models over hashed n-grams, one of the target text
(documents labelled as good), one of the raw text (all documents); a document's importance is the ratio of its
probabilities under the two, and Gumbel top-k draws the documents to keep in proportion to it, without replacement.

An n-gram is a token, a pair of neighbours, or the outline (letter case, digits, marks) of three neighbours; a pair
of equal neighbours is one n-gram whatever the word, so that repetition shows. Counts go into 2 ** 13 buckets, of
which the models are distributions (add-one smoothing).

The log-ratio of a whole text grows with its length, and with it the models' small errors. So a text's importance
is tempered: its mean log-ratio, shrunk by PRIOR n-grams of ratio 0, for LENGTH n-grams.

How many to keep: half of the labelled documents (by the hash of their ids) make the target model, the other half
calibrate importance -> chance of being good (a logistic curve over its sign-preserving logarithm; documents inside
the target model would look better than unlabelled ones); k is the sum of these chances over all documents, unless a share is given.
The k-th largest key is found exactly by counting digits of the keys, never by sorting or collecting documents.
Counts cover every document; only labels are bounded, by the label table itself.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import cut, fold_of, free, lean, small_or_not

BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
LENGTH, PRIOR = 200.0, 10.0
TOKENS = re.compile(r"\w+|[^\w\s]+")
#: The calibration curve is fitted on at most this many labelled documents, those with the smallest hash of their id.
LABELS = 200_000


def _outline(token: str) -> int:
    if token.isalpha():
        return 1 if token.islower() else 2 if token.istitle() else 3 if token.isupper() else 4
    return 5 if token.isdigit() else 6 if token.isalnum() else 7 + min(len(token), 4)


class Tokens(dict):
    """token -> its hash (48 bits) and outline (4 bits) in one number, remembered for up to 100,000 tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token) >> 16 << 4 | _outline(token)
        return value

    def buckets(self, text: str) -> np.ndarray:
        """The bucket of every n-gram of a text."""
        found = TOKENS.findall(text)
        if not found:
            return np.zeros(0, np.int64)
        both = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        h, o = both >> np.uint64(4), both & np.uint64(15)
        pair = h[:-1] * np.uint64(31) + h[1:]
        pair[h[:-1] == h[1:]] = 1
        shape = (o[:-2] * np.uint64(16) + o[1:-1]) * np.uint64(16) + o[2:] + np.uint64(1 << 50)
        mixed = np.concatenate([h, pair, shape]) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, good) -> for each bucket of this task the counts over all rows and over the good ones."""
    tokens, raw, target = Tokens(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column(0), batch.column(1), strict=True):
            n = np.bincount(tokens.buckets(text.as_py() or ""), minlength=BUCKETS)
            raw += n
            if good.as_py():
                target += n
    at = np.nonzero(raw)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def _ratios(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ratio = Tokens(), np.frombuffer(shared.value)
        for batch in batches:
            at = [tokens.buckets(t.as_py() or "") for t in batch.column(1)]
            sums = pa.array([float(ratio[x].sum()) for x in at], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sums, pa.array([len(x) for x in at], pa.int64())], ["doc_id", "log_ratio", "n_grams"])

    return run


def _squash(x):
    return np.sign(x) * np.log1p(np.abs(x))


def _fit_curve(x: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve by Newton steps with a little ridge; flat if there is nothing to fit."""
    rate = (good.sum() + 1) / (len(good) + 2)
    if len(set(good.tolist())) < 2:
        return 0.0, float(np.log(rate / (1 - rate)))
    z = np.stack([_squash(x), np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (good - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _kth_largest(keys: DataFrame, name: str, k: int) -> int | None:
    """The k-th largest of a long column of 48 bits, digit by digit: three counts of at most 2 ** 16 groups."""
    if k <= 0:
        return None
    above, fixed, left = None, 0, k
    for shift in (32, 16, 0):
        part = keys if above is None else keys.filter(above)
        digit = F.shiftright(F.col(name), shift).bitwiseAND(65535)
        for value, n in sorted(part.groupBy(digit.alias("d")).count().collect(), reverse=True):
            if left <= n:
                break
            left -= n
        else:
            return None if not fixed else fixed << shift
        fixed = (fixed << 16) | value
        above = F.shiftright(F.col(name), shift) == fixed
    return fixed


def gumbel(doc_id: str, seed: int = 7) -> Column:
    """A Gumbel variate that depends on the id and the seed only."""
    u = (F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", good: Column | None = None, share: float | None = None, seed: int = 7) -> DataFrame:
    """doc_id, n_grams, log_ratio, importance, p_good, gumbel_key, kept of every row of docs. good: a condition on labels, by
    default quality = 1.

    Null and empty texts have no n-grams and a log-ratio of 0; rows with equal ids and texts share their decision;
    null labels and ids count as unlabelled; without labels the ratio is 0 everywhere and half the rows are drawn
    unless a share is given; rows that tie with the k-th key are all kept; an empty table gives no rows; further
    columns, whatever their names, are not read."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    is_good = F.coalesce(good if good is not None else F.col("quality") == 1, F.lit(False))
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(is_good).alias("good"))
    known = known.withColumn("fold", fold_of("_id", 2))
    marked = texts.join(small_or_not(known), F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce(F.col("good") & (F.col("fold") == 0), F.lit(False)).alias("good"))
    found = marked.mapInArrow(lean(_counts), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, r, t in found:
        raw[bucket] += r
        target[bucket] += t
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if any(t for _, _, t in found) else np.zeros(BUCKETS)
    shared = spark.sparkContext.broadcast(ratio.tobytes())
    scored = cut(texts.mapInArrow(lean(_ratios(shared)), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, log_ratio double, n_grams long"))
    scored = scored.withColumn("importance", F.col("log_ratio") * LENGTH / (F.col("n_grams") + PRIOR))
    sample = scored.join(known.filter("fold = 1"), F.col("doc_id") == F.col("_id")).select("importance", F.col("good").cast("int").alias("good")).orderBy(F.xxhash64("doc_id"), "importance").limit(LABELS).toPandas()
    slope, intercept = _fit_curve(sample["importance"].to_numpy(float), sample["good"].to_numpy(float))
    squash = F.signum("importance") * F.log1p(F.abs("importance"))
    scored = scored.withColumn("p_good", 1 / (1 + F.exp(-(squash * slope + intercept))))
    scored = scored.withColumn("gumbel_key", F.col("importance") + gumbel("doc_id", seed))
    # keys as 48-bit numbers in order: 2 ** -20 steps around 2 ** 47, the ends saturate
    scored = scored.withColumn("_k", F.least(F.greatest(F.floor(F.col("gumbel_key") * (1 << 20)) + (1 << 47), F.lit(0)), F.lit((1 << 48) - 1)))
    n, expected = scored.agg(F.count("*"), F.coalesce(F.sum("p_good"), F.lit(0.0))).first()
    least = _kth_largest(scored, "_k", round(n * share if share is not None else expected))
    return scored.select("doc_id", "n_grams", "log_ratio", "importance", "p_good", "gumbel_key", F.lit(False).alias("kept") if least is None else (F.col("_k") >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the resampling keeps, with their columns."""
    id_col, gone = options.get("id_col", "doc_id"), free(docs, "gone")
    out = cut(resample(docs, labels, **options).filter("NOT kept").select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(small_or_not(out), F.col(id_col).eqNullSafe(F.col(gone)), "left_anti")
