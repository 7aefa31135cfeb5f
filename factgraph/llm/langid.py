"""Language identification by cross-parsing: a text is cut into the longest phrases that stand in a language's labelled text, and the language that needs
the fewest bits for its phrases wins.

A suffix automaton of each language's sample follows a text as long as it matches; where no transition is left a phrase ends and the next begins. A phrase
costs what naming a place in the sample costs, log2(bytes of the sample + 256) bits, and a byte that the sample lacks is a phrase of its own; the bits over
the text's bytes are compared. Texts are lower-cased and what is neither letter nor mark becomes one space, both code point by code point; the automata
read UTF-8, so that scripts need no table. Whole texts are read, in pieces of PIECE characters and blocks of BLOCK bytes where phrases end; thousands of
blocks go through an automaton side by side, a byte a step. Transitions lie in one array, each state at a place of its own where its bytes meet no other's.

The sample: of each language, different texts in the order of a hash, each whole, at most ROWS and until CHARS characters are reached; texts that are longer
than CHARS come last. Its size does not depend on the table's. A text may hold passages of another language, and what one automaton knows of it would win
texts from the other: so each language's sample is halved, and a segment of one half counts only if no other language's other half parses it, or the one
before or after it, better than its own does. One task builds one language's automaton. The model grows with the number of languages.

Defined results: null texts and texts without a letter are 'und' with score 0, and so is everything when no language has been learned; equal bits go to
the lesser name; rows without an id, a language or a letter are not learned from; repeated texts are learned once a language and scored alike; other
columns are kept unless a result column has their name.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.common import written

#: The sample of a language.
ROWS, CHARS = 200, 40_000
PIECE, BLOCK, LANES = 1 << 18, 1024, 4096
#: The first texts of a language are found in so many shares, and then among theirs; how many rows may be broadcast.
SHARES, BROADCAST_ROWS = 128, 20_000
#: Bytes of the segments that are held against other languages.
SEGMENT = 128
#: How fast another language's share of the score falls with its bits a byte.
SHARPNESS = 4.0
UNKNOWN = "und"
RESULT = "lang_pred string, score double"


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case, or the space; and whether it is a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    lower = np.array([ord(chr(c).lower()[0]) if k in "LM" else 32 for c, k in enumerate(kinds)], dtype=np.uint32)
    return lower, np.array([k == "L" for k in kinds])


def pieces(text: str | None) -> list[bytes]:
    """The text's words, lower-cased and between single spaces; none if no letter is there."""
    lower, letter = characters()
    found, any_letter = [], False
    for at in range(0, len(text or ""), PIECE):
        c = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        any_letter = any_letter or bool(letter[c].any())
        c = np.concatenate([[32], lower[c], [32]]).astype("<u4")
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
        found.append(c.tobytes().decode("utf-32-le").encode())
    return [p for p in found if p != b" "] if any_letter else []


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of each state; every part of data leads from state 0 to one of them, and nothing else does."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new, p = len(following), last
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return following


def packed(following: list[dict[int, int]]) -> np.ndarray:
    """The transitions in one array: a state is its place, a byte's cell lies that many after it, and holds the owner's place and the next state's."""
    n = sum(map(len, following))
    room = bytearray(2 * n + 2 * len(following) + 1024)
    place, taken, start = [0] * len(following), set(), 0
    for state in sorted(range(len(following)), key=lambda s: (s > 0, -len(following[s]))):
        cs = sorted(following[state])
        if not cs:
            continue
        at, tried = room.find(0, start + cs[0]), 0
        while at - cs[0] in taken or any(room[at - cs[0] + c] for c in cs):
            at, tried = room.find(0, at + 1), tried + 1
            if at < 0 or at + 256 > len(room):
                room += bytes(len(room))
                at = room.find(0, max(0, at))
        place[state] = at - cs[0]
        taken.add(place[state])
        for c in cs:
            room[place[state] + c] = 1
        if tried > 64:
            start = at - cs[0]
    free = 1
    for state, f in enumerate(following):
        if not f and state:
            while free in taken:
                free += 1
            place[state] = free
            taken.add(free)
    cells = np.full(max(place) + 257, -1, dtype=np.int64)
    for state, f in enumerate(following):
        for c, s in f.items():
            cells[place[state] + c] = place[state] << 32 | place[s]
    return cells


@dataclass(frozen=True)
class Language:
    name: str
    bytes_: int
    cells: np.ndarray

    def phrases(self, steps: np.ndarray, active: np.ndarray) -> np.ndarray:
        """The phrases of each block; steps has a row a byte, and active says how many blocks have it: the longer ones come first."""
        first = np.where(self.cells[:256] >= 0, self.cells[:256] & 0xFFFFFFFF, 0)
        state, count = np.zeros(steps.shape[1], np.int64), np.zeros(steps.shape[1], np.int64)
        for c, m in zip(steps, active, strict=True):
            s, c = state[:m], c[:m]
            cell = self.cells[s + c]
            ends = np.flatnonzero(cell >> 32 != s)
            there = c[ends]
            again = first[there]
            count[ends] += (s[ends] > 0).astype(np.int64) + (again == 0)
            cell &= 0xFFFFFFFF
            cell[ends] = again
            state[:m] = cell
        return count + (state > 0)


def parsed(blocks: Iterable[tuple[int, bytes]], n: int, languages: list[Language]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each of n texts, and its bits a byte in each language; blocks are of the texts with these numbers."""
    sizes, counts = np.zeros(n, np.int64), np.zeros((n, len(languages)), np.int64)
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        held.sort(key=lambda x: -len(x[1]))
        of, lengths = np.array([i for i, _ in held]), np.array([len(b) for _, b in held])
        longest = int(lengths[0])
        steps = np.frombuffer(b"".join(b.ljust(longest, b"\0") for _, b in held), np.uint8).reshape(len(held), longest).T.astype(np.int64, order="C")
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        np.add.at(sizes, of, lengths)
        for k, language in enumerate(languages):
            np.add.at(counts[:, k], of, language.phrases(steps, active))
        held.clear()

    for block in blocks:
        held.append(block)
        if len(held) == LANES:
            flush()
    if held:
        flush()
    return sizes, counts * np.log2([x.bytes_ + 256.0 for x in languages]) / np.maximum(sizes, 1)[:, None]


def blocks_of(texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
    for i, text in enumerate(texts):
        for piece in pieces(text):
            for at in range(0, len(piece), BLOCK):
                yield i, piece[at : at + BLOCK]


def predicted(texts: list[str | None], languages: list[Language]) -> tuple[list[str], np.ndarray]:
    """The language of each text, and how clear the case is: its share, where a share falls with the bits a byte."""
    if not languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    sizes, bits = parsed(blocks_of(texts), len(texts), languages)
    best = bits.argmin(axis=1)  # the first of equals, in the order of names
    share = 1 / np.exp2(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
    known = sizes > 0
    return [languages[b].name if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, share, 0.0)


def fit(docs: DataFrame, learnable: Column, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, chars: int = CHARS) -> list[Language]:
    """The languages of the rows that are learnable."""
    usable = docs.filter(F.coalesce(learnable, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    usable = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    different = usable.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n"))
    order = (F.col("n") > chars, F.xxhash64("h", F.lit(13)), "h")
    first = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    drawn = different.withColumn("share", F.pmod("h", F.lit(SHARES))).withColumn("rank", first("lang", "share")).filter(F.col("rank") <= rows)
    drawn = drawn.withColumn("rank", first("lang")).filter(F.col("rank") <= rows)
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < chars).select("lang", "h", "rank")
    drawn = written(drawn, "langid-drawn")
    few = drawn.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # at most ROWS a language, but languages are as many as the table has
    texts = written(usable.join(F.broadcast(drawn) if few else drawn, ["lang", "h"]).groupBy("lang", "h", "rank").agg(F.min("text").alias("text")), "langid-sample")
    halves = automata(texts.withColumn("part", F.col("rank") % 2), lambda text, lang, rank: pieces(text))
    return [x for _, x in automata(texts.withColumn("part", F.lit(0)), lambda text, lang, rank: own_segments(text, lang, 1 - rank % 2, halves))]


def automata(texts: DataFrame, read: Callable[[str, str, int], list[bytes]]) -> list[tuple[int, Language]]:
    """(part, language) of texts (lang, part, rank, text), in the order of names; read gives what counts of a text."""

    def built(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        data = b"\0".join(p for t, lang, rank in zip(group["text"], group["lang"], group["rank"], strict=True) for p in read(t, lang, rank))
        return pd.DataFrame({"lang": group["lang"][:1], "part": group["part"][:1], "n": [len(data)], "cells": [packed(suffix_automaton(data)).tobytes()]})

    found = texts.groupBy("lang", "part").applyInPandas(built, "lang string, part int, n long, cells binary").filter("n > 0").collect()
    return [(r.part, Language(r.lang, r.n, np.frombuffer(bytes(r.cells), np.int64))) for r in sorted(found, key=lambda r: (r.lang, r.part))]


def own_segments(text: str, lang: str, part: int, halves: list[tuple[int, Language]]) -> list[bytes]:
    """The segments of a text that no other language's half parses better than its own does, nor a neighbour of theirs, into which a passage may reach."""
    judges = [x for p, x in halves if p == part]
    names = [x.name for x in judges]
    segments = [s for p in pieces(text) for s in words(p)]
    if lang not in names or not segments:
        return segments
    _, bits = parsed(enumerate(segments), len(segments), judges)
    other = bits[:, names.index(lang)] > bits.min(axis=1)
    near = other | np.append(other[1:], False) | np.append(False, other[:-1])
    return [s for s, out in zip(segments, near, strict=True) if not out]


def words(piece: bytes) -> Iterator[bytes]:
    """A piece, cut at the first space after every SEGMENT bytes."""
    at = 0
    while at < len(piece) - 1:
        end = piece.find(b" ", at + SEGMENT)
        end = len(piece) - 1 if end < 0 else end
        yield piece[at : end + 1]
        at = end


def identify(docs: DataFrame, languages: list[Language], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns to keep of it) with lang_pred and score of each whole text."""
    result = T.StructType.fromDDL(RESULT)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in result.names]
    read = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).alias("score"))
    schema = T.StructType([*read.select(*(f"`{c}`" for c in kept)).schema.fields, *result.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predicted(batch.column(len(kept)).to_pylist(), languages)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [f.name for f in schema])

    return read.mapInArrow(run, schema)
