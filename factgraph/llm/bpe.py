"""BPE encoding and decoding with a pair occurrence index.

The words that a worker has not met before are laid out as one long symbol list. An index maps each pair of symbols that has a merge rank to all its
positions; ranks are taken in ascending order from a heap, each rank's positions are merged together, and only the lists of the pairs that a merge
makes are touched. Symbols, first ranks and the ids that are left are laid out by numpy. Words and their ids stay in a bounded table, since texts repeat
words far more often than they bring new ones; a full one is kept until the next is full, and what is met of it moves on.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows and ids are encoded independently; all other columns are
kept, the two new ones replace columns of the same name.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: Words kept in each of a worker's two tables of encoded words, the one being filled and the one before it, and characters of the longest that is kept.
MAX_WORDS, LONG = 200_000, 200
#: Characters that match \s in a tokenizer file's patterns.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Beyond these characters a text may hold ones that are newer than Python's character tables; the library's own tables then split it.
BEYOND = re.compile("[^\x00-\u0557]").search
#: Characters up to there by the classes that patterns name.
NEAR = {n: "".join(rf"\u{c:04x}" for c in range(0x558) if unicodedata.category(chr(c))[0] == n) for n in "LN"}
#: Fixed value: the split pattern of byte-level tokenizers that name none in their file.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else the next free one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def near_findall(pattern: str) -> Callable[[str], list[str]]:
    """A split pattern for texts that BEYOND finds nothing in, by the standard library's expressions, which take less than half the time."""
    for name, chars in NEAR.items():
        pattern = re.sub(rf"(\[\^?[^\]]*)\\p\{{{name}\}}", lambda m, chars=chars: m[1] + chars, pattern).replace(rf"\p{{{name}}}", f"[{chars}]")
    return re.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall


class PairIndexBpe:
    """A tokenizer file's BPE model, and what it does to a text before and after the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.size = max(self.vocab.values()) + 1
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.pairs: list[tuple[int, int]] = []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y = self.vocab[a], self.vocab[b]
            self.rank.setdefault(x * self.size + y, len(self.made))
            self.made.append(self.vocab[a + b])
            self.pairs.append((x, y))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        normalizers = spec["normalizer"] and (spec["normalizer"].get("normalizers") or [spec["normalizer"]]) or []
        self.nfc = any(n["type"] == "NFC" for n in normalizers)
        self.lower = any(n["type"] == "Lowercase" for n in normalizers)
        steps = spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]]
        pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), BYTE_LEVEL)
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        self.near_words = near_findall(pattern)
        self.bytes = byte_symbols()
        self.joins_bytes = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.symbol = np.array([self.vocab.get(c, -1) for c in self.bytes])
        self.last = np.array([self.vocab.get(c + self.suffix, -1) for c in self.bytes])
        self.pair_keys = np.array(sorted(self.rank) or [-1], dtype=np.int64)
        self.pair_ranks = np.array([self.rank.get(k, -1) for k in self.pair_keys.tolist()], dtype=np.int64)
        names = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)
        self.back = back = {c: b for b, c in enumerate(self.bytes)}
        self.library = Tokenizer.from_file(path)
        self.raw = np.array([bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in self.names], dtype=object) if self.joins_bytes else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalized(self, text: str) -> str:
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if self.lower else text  # sigma: by character, not by word

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if BEYOND(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            own = self.library.normalizer
            shown = self.library.pre_tokenizer.pre_tokenize_str(own.normalize_str(text) if own else text)
            return [bytes(self.back[c] for c in w).decode() for w, _ in shown]
        text = self.normalized(text)
        return self.words(text) if BEYOND(text) else self.near_words(text)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, as little-endian unsigned 32-bit integers."""
        size, rank, made = self.size, self.rank, self.made
        encoded = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        shown = np.frombuffer(b"".join(encoded), np.uint8)
        ends = lengths.cumsum() - 1
        laid = self.symbol[shown]
        laid[ends] = self.last[shown[ends]]
        of = np.repeat(np.arange(len(encoded)), lengths)[laid >= 0]
        laid = laid[laid >= 0]
        goes_on = np.append(of[1:] == of[:-1], False)[: len(laid)]
        here = np.arange(len(laid))
        before: list[int] = np.where(np.append(False, goes_on[:-1])[: len(laid)], here - 1, -1).tolist()
        after: list[int] = np.where(goes_on, here + 1, -1).tolist()
        starts = np.flatnonzero(goes_on)
        keys = laid[starts] * size + laid[starts + 1]
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        ranked = self.pair_keys[at] == keys
        starts, ranks = starts[ranked], self.pair_ranks[at[ranked]]
        order = np.argsort(ranks, kind="stable")
        found, cuts = np.unique(ranks[order], return_index=True)
        places_of = starts[order].tolist()
        cuts = [*cuts.tolist(), len(places_of)]
        index: dict[int, list[int]] = {r: places_of[cuts[i] : cuts[i + 1]] for i, r in enumerate(found.tolist())}
        sym: list[int] = laid.tolist()
        word: list[int] = of.tolist()
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            left, right = self.pairs[r]
            new = made[r]
            waits, held = -1, []  # a merge may make a pair of a lower rank: the rest of its word then waits for it
            for i in places:
                j = after[i]
                if sym[i] != left or j < 0 or sym[j] != right:
                    continue
                if word[i] == waits:
                    held.append(i)
                    continue
                k, p = after[j], before[i]
                sym[i], sym[j], after[i] = new, -1, k
                if k >= 0:
                    before[k] = i
                    if (s := rank.get(new * size + sym[k])) is not None:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heapq.heappush(active, s)
                        if s < r:
                            waits = word[i]
                if p >= 0 and (s := rank.get(sym[p] * size + new)) is not None:
                    if s in index:
                        index[s].append(p)
                    else:
                        index[s] = [p]
                        heapq.heappush(active, s)
                    if s < r:
                        waits = word[i]
            if held:
                index.setdefault(r, []).extend(held)
                heapq.heappush(active, r)
        left_over = np.array(sym, dtype=np.int64)
        ids = left_over[left_over >= 0].astype("<u4").tobytes()
        stops = (4 * np.bincount(of[left_over >= 0], minlength=len(words)).cumsum()).tolist()
        return [ids[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        pieces: list[list[tuple[list[str], bytes]]] = []
        met: set[str] = set()
        for text in texts:
            parts = self.special_split.split(text or "") if self.special_split else [text or ""]
            mine = []
            for k in range(0, len(parts), 2):
                words = self.split(parts[k]) if parts[k] else []
                met.update(words)
                mine.append((words, self.special[parts[k + 1]].to_bytes(4, "little") if k + 1 < len(parts) else b""))
            pieces.append(mine)
        fresh = met.difference(self.known)
        if len(self.known) + len(fresh) > MAX_WORDS:
            self.older, self.known = self.known, {}
            fresh = met
        known, older = self.known, self.older
        known.update((w, older[w]) for w in fresh if w in older)
        new = sorted(fresh.difference(older))
        known.update(zip(new, self.merge_all(new), strict=True))
        get = known.__getitem__
        made = [b"".join(chain.from_iterable((*map(get, words), special) for words, special in mine)) for mine in pieces]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return made

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, dtype="<u4")
        if self.joins_bytes:
            return b"".join(self.raw[found].tolist()).decode("utf-8", "replace")
        return " ".join(self.names[found].tolist())


_models: dict[str, PairIndexBpe] = {}


def model(path: str) -> PairIndexBpe:
    """One model for a worker and file."""
    if path not in _models:
        _models[path] = PairIndexBpe(path)
    return _models[path]


def slices(batch: pa.RecordBatch, text_col: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or one row."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(text_col)).fill_null(0).to_pylist()):
        if held and held + n > chars:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns to keep of it) with each whole text's ids, packed as little-endian unsigned 32-bit integers, and the text that they decode to."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, decoded_col)]
    read = docs.select(*dict.fromkeys([*kept, text_col]))
    schema = T.StructType([*read.select(*kept).schema.fields, T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.StringType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for whole in batches:
            for batch in slices(whole, text_col):
                ids = bpe.encode_batch(batch.column(text_col).to_pylist())
                columns = [batch.column(c) for c in kept] + [pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, ids_col, decoded_col])

    return read.mapInArrow(encode, schema)
