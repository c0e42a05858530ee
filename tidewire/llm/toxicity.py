"""Toxic severity by cumulative-link ordinal regression on sparse text features.

A document has a sparse vector of hashed words, one weight a feature serves all ordered
thresholds, and P(grade > k) is the logistic of its score less the k-th threshold.  The
output is the expected grade.

The labels only say toxic or not.  Grades above 0 are made of them: words are scored by
how much more often they stand in toxic than in other labelled documents, and a toxic
document's grade grows with the number of such words in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialise, scratch, text_of

#: Hashed features; labelled rows that training reads at most, the first in order of a hash of their id.
FEATURES, SAMPLE = 1 << 18, 8000
#: Features of theirs together at most, of 8 bytes each on the driver, and how many of them a step reads at a time.
SAMPLE_FEATURES, CHUNK = 12_000_000, 1_000_000
BEGINNINGS = (4, 5, 6)
#: Grades above 0: as many equal parts of the toxic documents.
GRADES = 3
#: How much more often a telling word stands in toxic documents, and in how many of them at least.
TELLING, OFTEN = 8.0, 5
#: Penalty that keeps weights sparse, steps, and their size.
SPARSE, ROUNDS, RATE = 1e-3, 150, 0.3
#: P(grade > 0) from which a document counts as toxic.
THRESHOLD = 0.3
#: Hashes of words that a worker keeps before it forgets them.
KEPT = 500_000
_TRIM = ".,;:!?\"'()[]{}<>|*#%$&@~^_=+-/\\`"
_kept: dict[str, tuple[int, ...]] = {}


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and, since inflected languages vary its end, of its beginnings."""
    parts = {word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)}
    return tuple(xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass"), 1) % FEATURES for p in parts)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, value) of a text: log counts of its lower-case words, without marks around them, and their beginnings."""
    if len(_kept) > KEPT:
        _kept.clear()
    at: list[int] = []
    for w in text.lower().split():
        if (f := _kept.get(w)) is None:
            f = _kept[w] = word_features(w.strip(_TRIM))
        at += f
    found, n = np.unique(np.array(at, np.int64), return_counts=True)
    return found, 1 + np.log(n)


@dataclass(frozen=True)
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


@dataclass(frozen=True)
class Rows:
    """Sparse rows one after another: features and their values, and where each row begins; a last entry is the end."""

    at: np.ndarray
    value: np.ndarray
    begin: np.ndarray

    def __len__(self) -> int:
        return len(self.begin) - 1

    def chunks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, features, values, row of each, counted from the first) for runs of about CHUNK features."""
        a = 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.begin, self.begin[a] + CHUNK, "right")) - 1)
            part = slice(self.begin[a], self.begin[b])
            yield slice(a, b), self.at[part], self.value[part], np.repeat(np.arange(b - a), np.diff(self.begin[a : b + 1]))
            a = b


def rows_of(vectors: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
    begin = np.cumsum([0, *(len(f) for f, _ in vectors)])
    return Rows(np.concatenate([f for f, _ in vectors]).astype(np.int32), np.concatenate([v for _, v in vectors]).astype(np.float32), begin)


def fit(rows: Rows, grade: np.ndarray, n_grades: int) -> CumulativeLink:
    """Maximum likelihood with an absolute penalty on the weights, by adaptive proximal gradient steps.

    Thresholds are kept in order by writing them as a first one and positive gaps.  Scores
    and gradients are summed chunk by chunk, so temporaries don't grow with the sample.
    """
    w = np.zeros(FEATURES)
    t = np.array([2.0, *np.zeros(n_grades - 2)])  # first, logs of gaps
    seen_w, seen_t = np.full(FEATURES, 1e-8), np.full(len(t), 1e-8)
    for _ in range(ROUNDS):
        theta = t[0] + np.r_[0, np.cumsum(np.exp(t[1:]))]
        g_w, g_theta = np.zeros(FEATURES), np.zeros(len(theta) + 2)
        for part, at, value, doc in rows.chunks():
            own = grade[part]
            i = np.arange(len(own))
            score = np.bincount(doc, w[at] * value, len(own))
            s = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -50, 50)))
            upper = np.column_stack([np.ones(len(own)), s, np.zeros(len(own))])  # P(grade > -1), ..., P(grade > top)
            slope = np.column_stack([np.zeros(len(own)), s * (1 - s), np.zeros(len(own))])
            p = np.maximum(upper[i, own] - upper[i, own + 1], 1e-12)
            d_score = (slope[i, own] - slope[i, own + 1]) / p / len(rows)
            g_w += np.bincount(at, value * d_score[doc], FEATURES)
            np.add.at(g_theta, own, -slope[i, own] / p / len(rows))
            np.add.at(g_theta, own + 1, slope[i, own + 1] / p / len(rows))
        g_theta = g_theta[1:-1]
        g_t = np.r_[g_theta.sum(), np.cumsum(g_theta[::-1])[::-1][1:] * np.exp(t[1:])]
        seen_w += g_w**2
        seen_t += g_t**2
        step = RATE / np.sqrt(seen_w)
        w += step * g_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * SPARSE, 0)
        t += RATE * g_t / np.sqrt(seen_t)
    return CumulativeLink(w, t[0] + np.r_[0, np.cumsum(np.exp(t[1:]))])


def grades(rows: Rows, toxic: np.ndarray) -> np.ndarray:
    """0 for documents that aren't toxic; else 1 to GRADES, by the number of telling features."""
    has = [np.zeros(FEATURES), np.zeros(FEATURES)]
    for part, at, _, doc in rows.chunks():
        bad = toxic[part][doc]
        for y in (0, 1):
            has[y] += np.bincount(at[bad == y], minlength=FEATURES)
    n = np.bincount(toxic, minlength=2)
    ratio = ((has[1] + 0.5) / (n[1] + 1)) / ((has[0] + 0.5) / (n[0] + 1))
    telling = (ratio >= TELLING) & (has[1] >= OFTEN)
    count = np.zeros(len(rows))
    for part, at, value, doc in rows.chunks():
        told = telling[at]
        count[part] = np.bincount(doc[told], np.round(np.exp(value[told].astype(float) - 1)), part.stop - part.start)
    edges = np.quantile(count[toxic == 1], np.arange(1, GRADES) / GRADES)
    return np.where(toxic == 1, 1 + np.searchsorted(edges, count), 0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CumulativeLink | None:
    """Learn from at most ``sample`` labelled documents with at most SAMPLE_FEATURES features together; None unless both labels occur among them.

    Where a document has several labels, the highest counts; labels other than 0 and 1
    say nothing, nor do those of documents that aren't there.  A repeated doc_id is one
    document, with the last of its texts in order.  Features are counted where the texts
    are, so only those that are learnt from come to the driver.
    """
    own = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = own.orderBy(F.xxhash64("doc_id")).limit(sample)  # bounded by the parameter

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for s in range(0, len(x), 64):
                own = x.iloc[s : s + 64]
                f = [features(t) for t in own["text"]]
                yield pd.DataFrame({"doc_id": own["doc_id"], "toxic": own["toxic"], "n": [len(a) for a, _ in f], "f": [a.astype("<i4").tobytes() for a, _ in f], "v": [b.astype("<f4").tobytes() for _, b in f]})

    texts = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    with scratch(docs.sparkSession):
        described = materialise(texts.mapInPandas(describe, "doc_id long, toxic int, n long, f binary, v binary"), "features")
        order = F.xxhash64("doc_id")
        sizes = described.select("doc_id", "n").orderBy(order).toPandas()  # at most ``sample`` rows of numbers
        sizes = sizes[sizes["n"] <= SAMPLE_FEATURES]
        sizes = sizes[sizes["n"].cumsum() <= SAMPLE_FEATURES]
        learnt = docs.sparkSession.createDataFrame([(int(i),) for i in sizes["doc_id"]], "doc_id long")
        got = described.join(F.broadcast(learnt), "doc_id").orderBy(order).toPandas()
    toxic = got["toxic"].to_numpy(np.int64)
    if len(set(toxic)) < 2:
        return None
    rows = rows_of([(np.frombuffer(f, "<i4"), np.frombuffer(v, "<f4")) for f, v in zip(got["f"], got["v"])])
    del got
    grade = grades(rows, toxic)
    _, grade = np.unique(grade, return_inverse=True)  # without grades that nobody has
    return fit(rows, grade, int(grade.max()) + 1)


def severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, severity (the expected grade), p_toxic (that the grade is above 0) and predicted of every row.

    Null and empty texts have no features and get the prior grade of such a score.
    Without labels of both kinds nothing can be learnt: severity and p_toxic are 0.
    """
    model = train(docs, labels, sample)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if model is None:
                yield pd.DataFrame({"doc_id": x["doc_id"], "severity": 0.0, "p_toxic": 0.0})
                continue
            s = np.zeros(len(x))
            for k, t in enumerate(x["text"]):
                f, v = features(t)
                s[k] = model.weights[f] @ v
            above = model.above(s)
            yield pd.DataFrame({"doc_id": x["doc_id"], "severity": above.sum(axis=1), "p_toxic": above[:, 0]})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return own.mapInPandas(score, "doc_id long, severity double, p_toxic double").withColumn("predicted", (F.col("p_toxic") >= threshold).cast("int"))
