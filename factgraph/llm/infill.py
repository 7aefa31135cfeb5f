"""Fill-in-the-middle: a text is cut at two line ends, and its parts are put in another order between markers.

The lines come from the tokenizers library: its Split pre-tokenizer isolates the matches of UNIT and gives each match's offsets in code points; nothing is
trained. The ends of the matches, in order, are the ranked offsets: their number is n, and the k-th is where the first k lines end. Four draws from a hash
of the id choose the two ranks, whether the text stays plain, and the order of the parts. A text is handed over in pieces of PIECE characters, since the
library keeps 16 bytes for each of a text's bytes; a line that a piece cuts is joined again by leaving out the end that the cut has made.

Defined results: a null text counts as empty and an empty one is plain; so is one that contains a marker, so that each output can be taken apart again; a
null id draws as the empty one; rows that repeat an id draw alike, each for its own text; other columns are kept unless a result column has their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex
from tokenizers.pre_tokenizers import PreTokenizer, Split

UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: What is hashed before the id; how many texts of 100 are cut, and how many of those have the suffix first.
SEED = "7"
RATE, SUFFIX_FIRST = 100, 50
PIECE = 1 << 18
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def ends(text: str, splitter: PreTokenizer, piece: int = PIECE) -> np.ndarray:
    """The code-point offset at which each line ends."""
    found = []
    for at in range(0, len(text), piece):
        part = text[at : at + piece]
        own = np.array([b for _, (_, b) in splitter.pre_tokenize_str(part)], dtype=np.int64) + at
        cut = at + piece < len(text) and part[-1] != "\n"
        found.append(own[:-1] if cut else own)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def draws(key: str, seed: str = SEED) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def infilled(text: str, key: str, splitter: PreTokenizer, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    at = ends(text, splitter)
    n = len(at)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (int(at[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def transform(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = UNIT
) -> DataFrame:
    """docs (or the columns to keep of it) with n, form, prefix_chars, middle_chars and output, for each whole text. unit must end where a line ends, at the latest."""
    result = T.StructType.fromDDL(RESULT)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in result.names]
    read = docs.select(*(F.col(f"`{c}`") for c in kept), F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key")).alias("n"))
    schema = T.StructType([*read.select(*(f"`{c}`" for c in kept)).schema.fields, *result.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Split(Regex(unit), "isolated")
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            given = batch.column(len(kept))
            rows = [infilled(t.as_py(), k.as_py(), splitter, seed, rate, suffix_first) for t, k in zip(given.field("text"), given.field("key"), strict=True)]
            made = [pa.array([r[i] for r in rows], type_) for i, type_ in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [f.name for f in schema])

    return read.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that was cut: no part of an output contains a marker, and none can arise where two parts meet, so markers part it exactly."""
    part = lambda i: F.get(F.split(output, "|".join(MARKERS), -1), F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
