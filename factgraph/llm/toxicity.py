"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is an n-gram (3 to 5 characters of the lower-cased text) hashed to 18 bits, present or absent in a text. Its scale is the log of the ratio of
its smoothed rates in toxic and other texts; the features whose rates differ most surely are kept, and a logistic regression learns their weights.

Defined results: a null or empty text has no features and gets the offset's probability; with labels of one class only every score is that class;
without labels every score is 0.5; repeated rows are scored alike; other columns are kept unless a result column has their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factgraph.llm.common import labelled_sample

#: The sample that the model is fitted on: rows of each class, with their whole texts.
PER_CLASS = 3000
SIZES = (3, 4, 5)
BITS = 18
FEATURES = 6000


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    offset: float


def grams(text: str | None) -> np.ndarray:
    """The hash of each n-gram of a text, of all sizes."""
    c = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if text else np.empty(0, np.uint32)
    found, h = [], c
    for n in range(2, SIZES[-1] + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) ^ c[n - 1 :]
        if n >= SIZES[0]:
            found.append((h * np.uint32(0x9E3779B1) + np.uint32(n * 0x0C6EF372)) >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def train(rows: list[tuple[str, int]]) -> Model:
    y = np.array([label for _, label in rows], dtype=float)
    if len(set(y)) < 2:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0 if not len(y) else 40.0 if y[0] else -40.0)
    sets = [np.unique(grams(t)) for t, _ in rows]
    counts = np.zeros((2, 1 << BITS))
    for s, label in zip(sets, y, strict=True):
        counts[int(label), s] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], dtype=float)
    rate = (counts + 0.5) / (n[:, None] + 1)
    ratio = np.log(rate[1] / rate[0])
    sure = np.abs(ratio) / np.sqrt(1 / (counts[0] + 0.5) + 1 / (counts[1] + 0.5))  # the ratio over its standard error
    kept = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    where = np.full(1 << BITS, -1)
    where[kept] = np.arange(len(kept))
    cols = [where[s] for s in sets]
    cols = [c[c >= 0] for c in cols]
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.concatenate(cols)
    scale = ratio[kept]
    value = scale[col]
    w, b = np.zeros(len(kept)), float(np.log(n[1] / n[0]))
    m, v, step = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0.05
    for t in range(1, 201):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[col], len(y)) + b, -35, 35)))
        e = (p - y) / len(y)
        g = np.append(np.bincount(col, value * e[row], len(kept)) + 1e-4 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    return Model(kept, w * scale, float(b))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return train(labelled_sample(docs, labels, "toxic", per_class))


def scorer(model: Model):
    """The log odds of a text."""
    table = np.zeros(1 << BITS, dtype=np.float32)
    table[model.index] = model.weight
    has = table != 0

    def odds(text: str | None) -> float:
        g = grams(text)
        return model.offset + float(table[np.unique(g[has[g]])].sum(dtype=np.float64))

    return odds


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns to keep of it) with the score of each whole text."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    read = docs.select(*dict.fromkeys([*kept, text_col]))
    schema = T.StructType([*read.select(*kept).schema.fields, T.StructField(score_col, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = scorer(model)
        for batch in batches:
            x = np.array([odds(t.as_py()) for t in batch.column(text_col)], dtype=float)
            p = 1 / (1 + np.exp(-np.clip(x, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p, pa.float64())], [*kept, score_col])

    return read.mapInArrow(scored, schema)
