"""Toxicity by a learned lexicon, matched with misspellings, weighed by context.

Lexicon: words that stand in more contexts (previous and next word) of toxic documents than chance allows, learned
from a bounded sample of labelled rows. Contexts, one for each document, are counted, so copies of a document count once.
Matching: the Levenshtein automaton of a word (its states are rows of the edit table, dead ones are dropped) runs
over the lexicon trie; words of 5 letters and more may differ by one edit, two swapped neighbours being one. A form
that clean documents use as often as toxic ones is a word of its own and no misspelling.
Context: a hit between quotation marks, or within a few words after a word of reporting, counts a quarter.
Score: a logistic curve over the summed evidence, fitted on the same sample. Texts are read whole.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut, fold_of, lean

#: Labelled rows (those with the smallest hash of their id) that lexicon and curve are learned from, at most.
SAMPLE = 30_000
#: Letters and digits; a single mark that stands in for a letter inside a word belongs to it.
WORD = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*")
EDITS, FUZZY, QUOTED, WINDOW, LEAST_G = 1, 0.6, 0.25, 6, 18.0
# fixed values: words of reporting and quotation, in English, German, French and Spanish
REPORTING = frozenset("said says wrote writes quoted quotes quote called calls cited cites reported reads titled term word sagte schrieb zitierte zitat nannte wort dit écrit cite citation mot dijo escribió citó cita palabra".split())
QUOTES = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|(?<!\w)\"[^\"\n]*\"(?!\w)")


class LexiconTrie:
    """A trie of words, searched with the Levenshtein automaton of a query word."""

    def __init__(self, weights: dict[str, float], edits: int = EDITS):
        self.weights, self.edits, self.root = weights, edits, {}
        for word in weights:
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = word
        # one edit can't change both ends of a word: its first or its last letters are those of the term
        fuzzy = [w for w in weights if len(w) >= 5]
        self.heads = {(n, w[: self._end(w)]) for w in fuzzy for n in (len(w) - 1, len(w), len(w) + 1)}
        self.tails = {(n, w[-self._end(w) :]) for w in fuzzy for n in (len(w) - 1, len(w), len(w) + 1)}
        self.ends = {n: sorted({self._end(w) for w in fuzzy if abs(len(w) - n) <= 1}) for n in range(4, 2 + max(map(len, fuzzy), default=0))}

    @staticmethod
    def _end(term: str) -> int:
        return (len(term) - 1) // 2

    def find(self, word: str) -> tuple[str, int] | None:
        """The best term within the allowed edits and its distance; nearer first, then heavier, then by name."""
        if word in self.weights:
            return word, 0
        n = len(word)
        for k in self.ends.get(n, ()):
            if (n, word[:k]) in self.heads or (n, word[-k:]) in self.tails:
                return self._walk(word)
        return None

    def _walk(self, word: str) -> tuple[str, int] | None:
        best, todo, most = None, [(self.root, tuple(range(len(word) + 1)), None, "")], self.edits
        while todo:
            node, row, above, before = todo.pop()
            for ch, child in node.items():
                if ch == "":
                    if row[-1] <= most and len(child) >= 5:
                        key = (row[-1], -self.weights[child], child)
                        best = key if best is None or key < best else best
                    continue
                new = [row[0] + 1]
                for i, c in enumerate(word):
                    cost = min(new[-1] + 1, row[i + 1] + 1, row[i] + (c != ch))
                    if i and above and c == before and word[i - 1] == ch:
                        cost = min(cost, above[i - 1] + 1)
                    new.append(cost)
                # a swap costs one at its second letter, so a row above may still lead on
                if min(new) <= most or min(row) < most:
                    todo.append((child, tuple(new), row, ch))
        return (best[2], best[0]) if best else None


class Matcher(dict):
    """word -> (term, evidence, is misspelled) or None, remembered for up to 300,000 words."""

    def __init__(self, weights: dict[str, float], own_words: frozenset[str] = frozenset()):
        self.trie, self.own = LexiconTrie(weights), own_words

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        found = self.trie.find(word)
        if found and found[1]:
            found = None if word in self.own else (found[0], self.trie.weights[found[0]] * FUZZY, True)
        elif found:
            found = (found[0], self.trie.weights[found[0]], False)
        self[word] = found
        return found

    def evidence(self, text: str) -> tuple[float, int, int, int]:
        """Summed evidence, hits, misspelled hits and quoted hits of a text. Of one term, further hits count less."""
        low = text.lower()
        words = WORD.findall(low)
        at = [(i, m) for i, m in enumerate(map(self.__getitem__, words)) if m]
        if not at:
            return 0.0, 0, 0, 0
        spans = [m.span() for m in WORD.finditer(low)]
        marks = [m.span() for m in QUOTES.finditer(low)]
        total, seen, fuzzy, quoted, q = 0.0, Counter(), 0, 0, 0
        for i, (term, weight, misspelled) in at:
            while q < len(marks) and marks[q][1] <= spans[i][0]:
                q += 1
            inside = q < len(marks) and marks[q][0] <= spans[i][0]
            reported = any(w in REPORTING for w in words[max(0, i - WINDOW) : i])
            seen[term] += 1
            total += weight * (QUOTED if inside or reported else 1.0) / seen[term]
            fuzzy += misspelled
            quoted += inside or reported
        return total, len(at), fuzzy, quoted


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic texts -> distinct (word, context) of each batch; a document adds the first context of each word."""
    for batch in batches:
        found = set()
        for text in batch.column(0):
            words = ["", *WORD.findall((text.as_py() or "").lower()), ""]
            found.update({w: f"{a} {b}" for a, w, b in zip(words[-3::-1], words[-2::-1], words[::-1], strict=False)}.items())
        w, c = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(c, pa.string())], ["word", "context"])


def _clean_counts(candidates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = candidates.value, Counter()
        for batch in batches:
            for text in batch.column(0):
                n.update(known & set(WORD.findall((text.as_py() or "").lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return run


def _forms(weights):
    """(toxic, text) -> (word, toxic, n): misspelled forms of the lexicon and in how many texts of either label they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, n = Matcher(weights.value), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n.update((w, toxic) for w in set(WORD.findall((text.as_py() or "").lower())) if (m := matcher[w]) and m[2])
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["word", "toxic", "n"])

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, own, slope, intercept = model.value
        matcher = Matcher(weights, own)
        for batch in batches:
            rows = [matcher.evidence(t.as_py() or "") for t in batch.column(2)]
            evidence = np.array([r[0] for r in rows], float)
            score = 1 / (1 + np.exp(-(np.log1p(evidence) * slope + intercept)))
            more = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.7).astype(np.int32)), pa.array(evidence), *more]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "evidence", "n_hits", "n_misspelled", "n_quoted"])

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A rising logistic curve over log1p(evidence), by Newton steps with a little ridge."""
    if not len(y) or not y.any():
        return 1.0, -4.0
    z, w = np.stack([np.log1p(x), np.ones(len(x))], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2), z.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return max(0.1, float(w[0])), float(w[1])


def learn(sample: DataFrame) -> tuple[dict[str, float], frozenset[str], float, float]:
    """(lexicon with weights, clean forms near it, slope, intercept) from (text, toxic) rows, a bounded sample."""
    spark = sample.sparkSession
    sample = cut(sample)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    toxic, clean = sample.filter("toxic = 1").select("text"), sample.filter("toxic = 0").select("text")
    contexts = toxic.mapInArrow(lean(_contexts), "word string, context string").distinct().groupBy("word").count().filter("count >= 3")
    candidates = {r["word"]: r["count"] for r in contexts.collect()}
    known = spark.sparkContext.broadcast(frozenset(candidates))
    n_of = {r["word"]: r["n"] for r in clean.mapInArrow(lean(_clean_counts(known)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    weights, share = {}, n_toxic / max(1, n_toxic + n_clean)
    for word, a in candidates.items():
        b = n_of.get(word, 0)
        g = 2 * (a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0)) if 0 < share < 1 else 0
        weight = float(np.log((a / max(1, n_toxic)) / ((b + 0.5) / max(1, n_clean))))
        if weight >= np.log(8) and g >= LEAST_G and not word.isdigit():
            weights[word] = weight
    shared = spark.sparkContext.broadcast(weights)
    own: frozenset[str] = frozenset()
    if weights:
        seen_in = sample.select(F.col("toxic").cast("int"), "text").mapInArrow(lean(_forms(shared)), "word string, toxic int, n long").groupBy("word")
        seen_in = seen_in.agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"))
        own = frozenset(r["word"] for r in seen_in.filter("c > 0").collect() if r["c"] * n_toxic >= r["t"] * n_clean)
    model = spark.sparkContext.broadcast((weights, own, 1.0, 0.0))
    schema = "toxic int, held_out boolean, score double, predicted int, evidence double, n_hits long, n_misspelled long, n_quoted long"
    seen = sample.select("toxic", F.lit(False).alias("held_out"), "text").mapInArrow(lean(_score(model)), schema.replace("toxic int", "doc_id int")).select("doc_id", "evidence").toPandas()
    slope, intercept = _curve(seen["evidence"].to_numpy(float), seen["doc_id"].to_numpy(float))
    return weights, own, slope, intercept


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, n_hits, n_misspelled, n_quoted of every row of docs.

    Only the text enters the score. Null and empty texts have no evidence and get the score of none; null ids fall
    into the fold of the empty text; rows of labels with a null id or label, or of the held-out fold, are not read;
    an id labelled both ways counts as toxic; without labels the curve is a fixed one and the lexicon empty; rows
    with equal texts get equal scores; an empty table gives no rows; further columns are not read."""
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & (fold_of(id_col, modulus) != held_out))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("doc_id"), (fold_of(id_col, modulus) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    model = spark.sparkContext.broadcast(learn(sample))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(lean(_score(model)), f"doc_id {id_type}, held_out boolean, score double, predicted int, evidence double, n_hits long, n_misspelled long, n_quoted long")
