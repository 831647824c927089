"""Reading level of each document: a regularised ordinal regression calibrated to graded samples.

Features: lexical diversity, word rarity, connectives, a proxy of clause depth, word and sentence length, all over the
whole text. Rarity comes from word counts over the whole corpus: exact ones of its most frequent words, for the others
the mean count of the words of a hashed bucket, so the table's size doesn't grow with the vocabulary and rare words don't
share a count with frequent ones. The model is a proportional-odds regression with a ridge penalty, fitted on the graded samples (at most
:data:`MAX_SAMPLES` of them) on the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import written

#: Words with exact counts, and buckets for all others.
HEAD, BUCKETS = 50_000, 1 << 16
MAX_SAMPLES = 20_000
#: Texts of fewer words have no level.
MIN_WORDS = 30

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_STOP = re.compile(r"[.!?。！？]+[\"'”’)\]]*(?:\s+|$)|\n\s*\n|\n(?=\s*(?:[-*#>•|]|\d+[.)]))")
# Connectives by the kind of clause they open.
_EASY = frozenset("and but or so because then when if".split())
_HARD = frozenset("although whereas whereby inasmuch insofar notwithstanding provided unless consequently furthermore moreover nevertheless nonetheless albeit hence thus therefore whilst wherein thereby hereby hitherto lest despite irrespective".split())
_RELATIVE = frozenset("which who whom whose while since after before until though that".split())

_HEADING_WORDS = 8
_ENDS = (".", "!", "?", "。", '"', "”", ")", ";", ",", ":")


def sentences(text: str) -> list[str]:
    """The sentences of a text; a short line that ends none and isn't continued by the next is one of its own."""
    if "\n" in text:
        lines = text.split("\n")
        for i, x in enumerate(lines[:-1]):
            line, after = x.strip(), lines[i + 1].lstrip()
            if line and after and not line.endswith(_ENDS) and not after[0].islower() and not line[0].islower() and len(line.split()) <= _HEADING_WORDS:
                lines[i] = x + "\n"
        text = "\n".join(lines)
    return [s for s in _STOP.split(text) if s and any(c.isalpha() for c in s)]


def word_number(text: str | None) -> int:
    return sum(any(c.isalnum() for c in w) for w in text.split()) if text else 0


FEATURES = (
    "word length", "long words", "very long words", "syllables", "sentence length", "words a clause", "hard connectives",
    "easy connectives", "commas", "diversity", "rarity", "rare words",
)


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class Counts:
    """Word counts of a corpus: ``head`` has those of its most frequent words, ``tail`` the mean count of the others of each bucket."""

    head: dict[str, int]
    tail: np.ndarray
    total: int
    words: int


def word_counts(docs: DataFrame, text: str) -> Counts:
    """Counts over all documents. Each task sends a word once for every half million different ones it meets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    found.update(_WORD.findall(t.as_py().lower()))
            if len(found) > 500_000:
                yield as_batch()
                found.clear()
        yield as_batch()

    counted = written(docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    head = {r["word"]: r["n"] for r in counted.orderBy(F.desc("n"), "word").limit(HEAD).collect()}
    last = list(head)[-1] if len(head) == HEAD else None
    rest = (F.col("n") < head[last]) | ((F.col("n") == head[last]) & (F.col("word") > last)) if last else F.lit(False)
    # Spark's crc32 is that of zlib
    rows = counted.where(rest).groupBy(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BUCKETS)).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    total, words = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tail = np.zeros(BUCKETS)
    for r in rows:
        tail[r["b"]] = r["n"] / r["k"]
    return Counts(head, tail, total, words)


class Measure:
    """Turns a text into its features, given the corpus's word counts."""

    def __init__(self, counts: Counts):
        self.counts, self.size = counts, counts.total + 0.5 * counts.words + 1
        self.rare = float(-log(2e-5))
        self.words: dict[str, tuple[int, int, float, int]] = {}

    def word(self, w: str) -> tuple[int, int, float, int]:
        """(letters, syllables, rarity, kind of connective) of a lower-case word."""
        found = self.words.get(w)
        if found is None:
            if len(self.words) > 200_000:
                self.words.clear()
            syllables = max(1, len(re.findall(r"[aeiouyäöüéèêáíóúà]+", w)))
            kind = 2 if w in _HARD else 1 if w in _EASY else 3 if w in _RELATIVE else 0
            n = self.counts.head.get(w)
            n = float(self.counts.tail[_bucket(w)]) if n is None else n
            found = self.words[w] = (len(w), syllables, -log((n + 0.5) / self.size), kind)
        return found

    def features(self, text: str | None) -> list[float] | None:
        """None for a text of fewer than :data:`MIN_WORDS` words."""
        if not text or word_number(text) < MIN_WORDS:
            return None
        names = _WORD.findall(text.lower())
        n = len(names)
        if n < 2:
            return None
        known = list(map(self.word, names))
        # the length of the sentence that the median word stands in: headings weigh by their words, and a list without full stops doesn't outweigh the rest
        sizes = sorted(len(s.split()) for s in sentences(text))
        half = (sum(sizes) + 1) // 2
        length = float(max(1, next((x for x, upto in zip(sizes, accumulate(sizes)) if upto >= half), 1)))
        per = n / length
        lengths, syllables, rarity, kinds = zip(*known)
        hard, easy, relative = kinds.count(2), kinds.count(1), kinds.count(3)
        commas = text.count(",") + text.count(";") + text.count(":")
        # moving-average type-token ratio over 50 words (30 for the shortest texts): independent of the text's length
        window = min(50, n)
        seen: dict[str, int] = {}
        distinct, total = 0, 0
        for i, w in enumerate(names):
            distinct += seen.get(w, 0) == 0
            seen[w] = seen.get(w, 0) + 1
            if i >= window:
                old = names[i - window]
                seen[old] -= 1
                distinct -= seen[old] == 0
            if i >= window - 1:
                total += distinct
        diversity = total / (n - window + 1) / window
        return [
            sum(lengths) / n, sum(x >= 9 for x in lengths) / n, sum(x >= 13 for x in lengths) / n, sum(syllables) / n,
            log(length), log(n / (per + hard + easy + commas)), hard / per, easy / per, commas / per,
            diversity, sum(rarity) / n, sum(x > self.rare for x in rarity) / n,
        ]


@dataclass
class OrdinalModel:
    """P(level > k) = sigmoid(w x - cut_k) on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def level(self, x: np.ndarray) -> np.ndarray:
        """The most probable level."""
        above = 1 / (1 + np.exp(-(self.score(x)[:, None] - self.cuts[None, :])))
        edge = np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], axis=1)
        return self.levels[np.argmax(edge[:, :-1] - edge[:, 1:], axis=1)]

    def at_least(self, x: np.ndarray, level: int) -> np.ndarray:
        """P(level or more)."""
        cut = self.cuts[int(np.searchsorted(self.levels, level)) - 1]
        return 1 / (1 + np.exp(-(self.score(x) - cut)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 4000) -> OrdinalModel:
    """Fits the proportional-odds model by accelerated gradient steps; deterministic."""
    levels = np.unique(y)
    if len(levels) < 2:
        raise ValueError("graded samples of at least two levels are needed")
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, k = (x - mean) / scale, len(levels) - 1
    above = (y[:, None] > levels[None, :-1]).astype(float)
    w, c = np.zeros(z.shape[1]), np.linspace(-1.5, 1.5, k)
    share = np.clip(above.mean(0), 0.01, 0.99)
    c = -np.log(share / (1 - share))
    m = [np.zeros_like(w), np.zeros_like(c)]
    v = [np.zeros_like(w), np.zeros_like(c)]
    for t in range(1, steps + 1):
        # cumulative links: each cut is a logistic regression that shares its weights with the others
        err = 1 / (1 + np.exp(-((z @ w)[:, None] - c[None, :]))) - above
        grads = (z.T @ err.sum(1) / len(z) + ridge * w / len(z), -err.mean(0))
        for i, (p, g) in enumerate(zip((w, c), grads)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p -= 0.03 * (1 - t / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(mean, scale, w, np.sort(c), levels)


def graded(samples: DataFrame, text: str, level: str, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """Features and levels of the graded samples (the first :data:`MAX_SAMPLES` by hash, a documented bound of the fit)."""
    rows = samples.where(F.col(level).isNotNull() & F.col(text).isNotNull()).select(text, level).orderBy(F.xxhash64(text), text).limit(MAX_SAMPLES).collect()
    found = [(f, r[1]) for r in rows if (f := measure.features(r[0])) is not None]
    return np.array([f for f, _ in found]), np.array([y for _, y in found])


def levels(docs: DataFrame, key: str, text: str, samples: DataFrame, sample_text: str, sample_level: str, hard_from: int = 4, counts: Counts | None = None) -> DataFrame:
    """``key``, ``n_words``, ``level`` (1 .. 5), ``score`` (the latent difficulty) and ``p_hard``, the probability of ``hard_from`` or more.

    Texts of fewer than :data:`MIN_WORDS` words, null and empty ones among them, get null in the last three. Texts are
    read whole; repeated rows are kept; an empty table gives an empty one; other columns take no part.
    """
    measure = Measure(word_counts(docs, text) if counts is None else counts)
    x, y = graded(samples, sample_text, sample_level, measure)
    model = fit(x, y)
    measure.words.clear()
    shared = docs.sparkSession.sparkContext.broadcast((measure, model))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fitted = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [own.features(t) for t in texts]
            some = [i for i, f in enumerate(found) if f is not None]
            level, score, hard = ([None] * len(texts) for _ in range(3))
            if some:
                fx = np.array([found[i] for i in some])
                for i, a, b, c in zip(some, fitted.level(fx).tolist(), fitted.score(fx).tolist(), fitted.at_least(fx, hard_from).tolist()):
                    level[i], score[i], hard[i] = int(a), b, c
            n = [word_number(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(level, pa.int32()), pa.array(score, pa.float64()), pa.array(hard, pa.float64())], [key, "n_words", "level", "score", "p_hard"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(rate, f"`{key}` {kind}, n_words int, level int, score double, p_hard double")
