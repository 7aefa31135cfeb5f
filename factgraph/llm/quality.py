"""Quality by compression: a text compresses better with a zstandard dictionary made of texts like it.

Two dictionaries are built from good and bad labelled texts. A text is cut into blocks, each block is compressed with either, and the difference of the
total sizes over the text's length, (bad - good) / (bytes + 64), becomes a probability by a logistic curve fitted on labelled texts that the
dictionaries have not seen. Blocks keep the dictionaries at work through long texts, which would else become their own dictionary.

The model is fitted on a bounded sample: PER_CLASS rows a class, with their whole texts; a class's first half goes to the dictionary's trainer, in pieces
of PIECE bytes, and the other half to the curve.

Defined results: null and empty texts have a difference of 0 and get the curve's value there; with labels of one class only every score is that
class; without labels every score is 0.5; repeated rows are scored alike; other columns are kept unless a result column has their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factgraph.llm.common import labelled_sample

#: The sample that the model is fitted on: rows of each class; and the bytes of a piece for a dictionary's trainer.
PER_CLASS = 3000
PIECE = 1024
DICT_BYTES = 65_536
BLOCK = 4096
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def dictionary(texts: list[bytes]) -> zstd.ZstdCompressionDict:
    """A trained dictionary, or where too few samples are there to train one, their bytes as they are."""
    samples = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstd.train_dictionary(DICT_BYTES, samples)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


class Difference:
    """The normalised difference of compressed sizes."""

    def __init__(self, good: bytes, bad: bytes):
        params = zstd.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.good, self.bad = (zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d), compression_params=params).compress for d in (good, bad))

    def __call__(self, text: str | None) -> float:
        data = (text or "").encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return sum(len(self.bad(b)) - len(self.good(b)) for b in blocks) / (len(data) + 64)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve, by Newton's method with a weak pull to zero."""
    w = np.zeros(2)
    X = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -35, 35)))
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2), X.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows = labelled_sample(docs, labels, "quality", per_class)
    sides = [[t.encode() for t, y in rows if y == side and t] for side in (0, 1)]
    if not all(sides):
        return Model(b"", b"", 0.0, 0.0 if not any(sides) else 40.0 if sides[1] else -40.0)
    bad, good = (dictionary(side[: max(1, len(side) // 2)]).as_bytes() for side in sides)
    difference = Difference(good, bad)
    rest = [(difference(t.decode()), y) for y, side in enumerate(sides) for t in (side[len(side) // 2 :])]
    x, y = (np.array(v, dtype=float) for v in zip(*rest, strict=True))
    return Model(good, bad, *logistic(x, y))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns to keep of it) with the score of each whole text."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    read = docs.select(*dict.fromkeys([*kept, text_col]))
    schema = T.StructType([*read.select(*kept).schema.fields, T.StructField(score_col, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        difference = Difference(model.good, model.bad) if model.good else lambda _: 0.0
        for batch in batches:
            x = np.array([difference(t.as_py()) for t in batch.column(text_col)], dtype=float)
            p = 1 / (1 + np.exp(-(model.slope * x + model.offset)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p, pa.float64())], [*kept, score_col])

    return read.mapInArrow(scored, schema)
