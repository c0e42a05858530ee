"""Document quality by regularised quadratic discriminant analysis.

A document is described by transformed statistics of its bytes, words and lines.  For
each class Spark sums the first and second moments of those statistics over the labelled
rows, so training needs one pass and a state of fixed size, whatever the number of rows.
The class covariances are shrunk towards their diagonal and the pooled covariance, their
Cholesky factors are computed once, and the score of a document is the logistic of the
difference of the class log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialise, text_of

FEATURES = (
    "log_words", "log_word_length", "upper", "digit", "space", "comma_stop", "bang", "pipe", "symbol", "other_mark",
    "beyond_ascii", "byte_entropy", "log_line_words", "repeated_lines", "distinct_words", "distinct_pairs", "repeats_last", "top_word", "short_words", "marked_words",
)
#: Weight of the pooled covariance, then of the diagonal, in a class covariance; and the least variance.
TO_POOLED, TO_DIAGONAL, LEAST = 0.5, 0.1, 1e-4
THRESHOLD = 0.3

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\x0b\x0c\r", "comma_stop": b",.", "bang": b"!?", "pipe": b"|", "symbol": b"#$%&*@^~<>{}[]\\=+/_`"}
_OTHER = b"\"'();:-"
_CLASS = np.zeros((256, 9))
for _n, _set in enumerate([*_KINDS.values(), _OTHER, bytes(range(128, 256))]):
    _CLASS[list(_set), _n] = 1


def features(text: str) -> np.ndarray:
    """The statistics named in FEATURES; all are defined for an empty text too."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = of @ _CLASS / size
    p = of[of > 0] / size
    lines = raw.split(b"\n")
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(w[-1] in b"!?#$%&*|@^~<>{}[]=+/_`" for w in words)
    # Distinct shares fall with length whatever the quality; the exponent takes most of that out.
    return np.array([
        np.log1p(len(words)), np.log1p(sum(map(len, words)) / n), *np.sqrt(share), -(p * np.log2(p)).sum(),
        np.log1p(n / len(lines)), np.sqrt(1 - len(set(lines)) / len(lines)), np.log((len(counts) + 1) / (n + 1) ** 0.8), np.log((pairs + 1) / (n + 1) ** 0.95),
        np.sqrt(same / n), np.sqrt(max(counts.values(), default=0) / n), np.sqrt(sum(len(w) < 4 for w in words) / n), np.sqrt(marked / n),
    ])


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield pd.DataFrame({"doc_id": x["doc_id"], "x": [features(t) for t in x["text"]]})


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row; null texts count as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(_describe, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(FEATURES)
    n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for x in batches:
        if len(x):
            m, y = np.stack(x["x"].to_numpy()), x["y"].to_numpy()
            for c in (0, 1):
                of = m[y == c]
                n[c] += len(of)
                s[c] += of.sum(axis=0)
                ss[c] += of.T @ of
    yield pd.DataFrame({"y": [0, 1], "n": n, "s": list(s), "ss": list(ss.reshape(2, -1))})


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor of the covariance, log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        log = [self.prior[c] - 0.5 * self.log_det[c] - 0.5 * (((x - self.mean[c]) @ self.whiten[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(described: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Moments of all labelled rows of ``described`` that aren't held out; None unless both classes occur.

    Labels other than 0 and 1 and null ids say nothing; where a document has several
    labels, the lowest counts.
    """
    own = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    rows = described.where(~held_out(F.col("doc_id"))).join(own, "doc_id").select("x", "y")
    parts = rows.mapInPandas(_moments, "y int, n double, s array<double>, ss array<double>").groupBy("y").agg(
        F.sum("n").alias("n"), *(F.array(*(F.sum(F.col(c)[i]) for i in range(k))).alias(c) for c, k in (("s", len(FEATURES)), ("ss", len(FEATURES) ** 2)))
    )
    got = {r["y"]: r for r in parts.collect()}  # two rows of fixed size
    if not got or any(got[c]["n"] < 2 for c in (0, 1)):
        return None
    d = len(FEATURES)
    n = np.array([got[c]["n"] for c in (0, 1)])
    mean = np.array([got[c]["s"] for c in (0, 1)]) / n[:, None]
    cov = np.array([np.reshape(got[c]["ss"], (d, d)) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = (n[:, None, None] * cov).sum(axis=0) / n.sum()
    cov = (1 - TO_POOLED) * cov + TO_POOLED * pooled
    cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.stack([np.diag(np.diag(c)) for c in cov]) + LEAST * np.eye(d)
    low = np.linalg.cholesky(cov)
    return Discriminant(np.log(n / n.sum()), mean, np.linalg.inv(low), 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Scores depend on the text alone.  Without labels of both classes there is nothing to
    learn: every score is then 0.5.  Null texts count as empty; null ids are scored like
    any other and are never held out; repeated rows are scored one by one.
    """
    described = materialise(describe(docs), "described")
    model = fit(described, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            s = model.score(np.stack(x["x"].to_numpy())) if model and len(x) else np.full(len(x), 0.5)
            yield pd.DataFrame({"doc_id": x["doc_id"], "score": s})

    scored = described.mapInPandas(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns.

    Texts are read once: the statistics are written beside the rows, the labelled ones
    of them meet the labels, and the rows are then chosen where they are.
    """

    @F.pandas_udf("array<double>")
    def described(text: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in text], dtype=object)

    # A row travels as one column, so names of other columns can't clash.
    own = materialise(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), described(text_of(docs)).alias("x")), "described")
    model = fit(own.select(F.col("row.doc_id").cast("long").alias("doc_id"), "x"), labels)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if model and len(x) else np.full(len(x), 0.5))

    return own.where(score("x") >= threshold).select("row.*")
