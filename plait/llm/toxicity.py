"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, takes accents off, turns full-width, mathematical and look-alike letters into plain
Latin ones and digits or signs that stand for letters into these, and joins letters that are set apart,
so that disguised words meet their plain entries. The lexicon is learned from labelled documents: words
and stems (beginnings of words, written ``stem*``) whose share of toxic documents is far above that of
others, in many different contexts (words of one copied text have few). Its weights are log odds.
Phrases of a lexicon word and a neighbour that stand in text not labelled toxic are exceptions and cancel
the match. The weight found, with and without division by the text's length, goes into a logistic model.
All entries and phrases that the sample of labelled documents supports are kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.runtime import lean, materialise, ship

#: Labelled documents that the lexicon and the model are fitted on, at most (smallest hashes first).
SAMPLE = 20_000
LEAST_DOCS, LEAST_ODDS, LEAST_Z = 5, 2.0, 5.0
#: Different neighbours on either side that a frequent entry has at least; a rarer one, half its documents.
LEAST_CONTEXTS = 20
#: Lengths of stems.
STEMS = (5, 6, 7, 8)
CUT = 0.7

# fixed values: letters of other scripts that look like Latin ones
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
# fixed values: digits and signs that stand for letters where a letter follows, and digits at a word's end
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Combining marks and characters without width go.
_TABLE = str.maketrans(LOOKALIKES) | dict.fromkeys((*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_SUBSTITUTED = re.compile(r"[0134578@$!|]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]{1,3}(?![\w@$])")
_SUB_TABLE = str.maketrans(SUBSTITUTES)
_APART = re.compile(r"(?<![^\W_])[^\W\d_]([ .*_-])(?:[^\W\d_]\1){2,}[^\W\d_](?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_TABLE).lower()
    text = _SUBSTITUTED.sub(lambda m: m[0].translate(_SUB_TABLE), text)
    return _APART.sub(lambda m: m[0].replace(m[1], ""), text)


def forms(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def held_out(id: str = "doc_id"):
    """True for rows that no label may be learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Lexicon:
    """Words with weights, exception phrases and the model over the weight found."""

    def __init__(self, weights: dict[str, float], phrases: set[str], model: tuple[float, ...] = (0.0, 0.0, 0.0)) -> None:
        self.weights, self.phrases, self.model = weights, phrases, model
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "phrases": self.phrases, "model": self.model, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = a = ahocorasick.Automaton()
            found: dict[str, list[tuple[float, bool, bool]]] = {}
            for w, x in self.weights.items():
                found.setdefault(w.rstrip("*"), []).append((x, False, w.endswith("*")))
            for p in self.phrases:
                found.setdefault(p, []).append((0.0, True, False))
            for key, entries in found.items():
                a.add_word(key, (len(key), entries))
            a.make_automaton()
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float]:
        """The weight of lexicon words outside exception phrases, whole and per hundred words."""
        if not text or not self.weights:
            return 0.0, 0.0
        folded = fold(text)
        n, best, spared = len(folded), {}, []
        for last, (size, entries) in self.automaton.iter(folded):
            start, end = last - size + 1, last + 1
            if start and folded[start - 1].isalpha():
                continue
            whole = end >= n or not folded[end].isalpha()
            for weight, phrase, stem in entries:
                if whole != stem:
                    if phrase:
                        spared.append((start, end))
                    elif best.get(start, (0, 0.0))[1] < weight:  # a word counts once, as its heaviest entry
                        best[start] = end, weight
        found = [(s, e, w) for s, (e, w) in best.items()]
        if not found:
            return 0.0, 0.0
        if spared:  # starts are in order of ends; a word is spared if some phrase covers it
            starts, ends = np.array(spared).T
            found = [x for x in found if not ((starts <= x[0]) & (ends >= x[1])).any()] if len(spared) < 1000 else _uncovered(found, spared)
        total = sum(x[2] for x in found)
        return math.log1p(total), math.log1p(100 * total / (folded.count(" ") + folded.count("\n") + 1))

    def score(self, text: str | None) -> float:
        a, b, c = self.model
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _uncovered(found: list, spared: list) -> list:
    """``found`` spans outside the union of ``spared`` ones, by one sweep."""
    out, reach, i = [], -1, 0
    spared = sorted(spared)
    for s, e, w in sorted(found):
        while i < len(spared) and spared[i][0] <= s:
            reach = max(reach, spared[i][1])
            i += 1
        if reach < e:
            out.append((s, e, w))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton steps on the penalised likelihood of intercept and two slopes."""
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(3)
    keep = ridge * np.diag([1e-3, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def training_set(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents, none of them held out. The labels are
    bounded before they are broadcast, and the texts stay where they are."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Fit the lexicon, its exception phrases and the model."""
    spark = docs.sparkSession
    ship(spark)
    train = materialise(training_set(docs, labels, sample), "toxic-train")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tox, clean = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (tox if label else clean).update({f for w in set(_WORD.findall(fold(text or ""))) for f in forms(w)})
        keys = list(tox | clean)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([tox[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], ["word", "tox", "clean"])

    totals = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, set(), (math.log((n1 + 0.5) / (n0 + 0.5)), 0.0, 0.0))
    counts = train.mapInArrow(lean(words), "word string, tox long, clean long").groupBy("word").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("tox") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    pooled = (F.col("tox") + F.col("clean") + 1.0) / (n1 + n0 + 2.0)
    z = (F.col("tox") / float(n1) - F.col("clean") / float(n0)) / F.sqrt(pooled * (1 - pooled) * (1.0 / n1 + 1.0 / n0))
    good = counts.select("word", "tox", odds.alias("odds"), z.alias("z")).where((F.col("tox") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z))
    entries = {r.word: (r.tox, r.odds) for r in good.collect()}  # words of SAMPLE documents, at most

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple] = set()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = _WORD.findall(fold(text or ""))
                for i, w in enumerate(ws):
                    for form in forms(w):
                        if form in entries:
                            out.add((form, ws[i - 1] if i else "", ws[i + 1] if i + 1 < len(ws) else "", label))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int32())], ["word", "before", "after", "toxic"])

    around = materialise(train.mapInArrow(lean(contexts), "word string, before string, after string, toxic int").distinct(), "toxic-contexts")
    varied = {r.word: r.n for r in around.where("toxic = 1").groupBy("word").agg(F.least(F.count_distinct("before"), F.count_distinct("after")).alias("n")).collect()}
    weights = {w: o for w, (t, o) in entries.items() if varied.get(w, 0) >= max(LEAST_DOCS, min(LEAST_CONTEXTS, 0.5 * t))}
    pair = F.explode(F.array(F.when(F.col("before") != "", F.concat_ws(" ", "before", "word")), F.when(F.col("after") != "", F.concat_ws(" ", "word", "after"))))
    pairs = around.where(F.col("word").isin([w for w in weights if "*" not in w])).select("toxic", pair.alias("phrase")).where("phrase is not null")
    safe = pairs.groupBy("phrase").agg(F.sum(1 - F.col("toxic")).alias("c"), F.sum("toxic").alias("t")).where("c >= 3 and t = 0")
    phrases = {r.phrase for r in safe.collect()} if weights else set()
    lexicon = Lexicon(weights, phrases)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([lexicon.features(t) for t in b.column(0).to_pylist()], dtype=np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), b.column(1)], ["x", "y", "toxic"])

    got = train.mapInArrow(lean(measured), "x double, y double, toxic int").toArrow()  # at most SAMPLE rows
    x = np.column_stack((got.column("x").to_numpy(), got.column("y").to_numpy()))
    lexicon.model = fit_logistic(x, got.column("toxic").to_numpy())
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, cut: float = CUT, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every whole text, one row per input row. A null or
    empty text scores as one without lexicon words. Rows with a null id are not held out."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # words and phrases of SAMPLE documents, at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            s = np.array([own.score(t) for t in b.column(1).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    got = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(lean(run), "doc_id long, score double, predicted int")
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """Learn from ``labels`` (doc_id, toxic; rows held out are never read) and score all of ``docs``.
    Without labels of both kinds every text gets the same score. See :func:`scored` for the rows."""
    return scored(docs, learn(docs, labels, sample), cut)
