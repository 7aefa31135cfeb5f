"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

A file's header holds its prior: how often each id occurs (order 0), and each id's most frequent follower, both counted over the whole file. Ids are
cut into blocks, and every block starts afresh from the prior. Within a block, tables of the last two ids (order 2) and of the last one (order 1, the
follower until the block knows better) each predict an id, with a confidence. The prediction of the highest order is the candidate; whether it is the
next id is one binary decision, whose probability a logistic mixer, adapting at every step, makes from what all three orders say of the candidate. Where
the candidate fails, the id is coded by its order-0 frequency. All arithmetic is in integers, so any machine decodes what another has written. Fresh
starts make each block readable alone, and let numpy code many side by side.

A file holds the documents of a range of ids in ascending order: an index of doc ids and lengths, the prior, then blocks with id count, length and
crc32. Ranges are made by a range partitioning on id and the first characters of the text, which also cuts an id that many rows repeat; a file's name
carries the task attempt, and only the attempt that succeeded is listed.

Defined results: a null or empty text is the end id alone; rows that repeat an id stand next to each other, by text; a null id comes first; an empty
table writes no file.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factgraph.llm.bpe import SPACE, slices
from factgraph.llm.common import new_shared_path, written

MAGIC = b"IDCM2\n"
#: Ids of a block, and the most blocks that are coded side by side.
BLOCK = 1024
LANES = 6144
#: Bits of the tables of the last id and of the last two, and of the prior's whole.
BITS1, BITS2 = 7, 8
WHOLE = 16
#: Slots of a worker's table of tokenized words (half of them are used), ids that it holds, and characters of its longest word.
SLOTS = 1 << 21
HELD_IDS = HELD_CHARS = 8_000_000
LONG = 256
#: Characters that are worked on at once.
CUT = 1 << 20
NULL_ID = -(2**63)

_logit = np.clip(np.round(np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096))) * 256), -2047, 2047)
STRETCH = _logit.astype(np.int32)
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256.0))), 16, 4080).astype(np.int32)
#: What an order says of the candidate, by its confidence (0 to 3) and whether it predicts the candidate.
SAYS = np.array([[0, 0], [-64, 160], [-160, 448], [-400, 768]], np.int32).reshape(-1)
_ZERO, _U12, _U16, _U32, _TOP, _BOTTOM = (np.uint64(x) for x in (0, 12, 16, 32, 1 << 32, 1 << 30))


class Prior:
    """Where every block of a file starts: the frequency of each id out of 2^WHOLE, and its follower."""

    def __init__(self, freq: np.ndarray, follower: np.ndarray):
        self.counts, self.follower = freq, follower
        self.freq, self.start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.id_of = np.repeat(np.arange(len(freq)), freq)
        self.stretch = STRETCH.take(np.minimum(freq >> (WHOLE - 12), 4095))

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        counts = np.bincount(ids, minlength=1)
        seen = np.nonzero(counts)[0]
        upto = np.cumsum(counts[seen]) * ((1 << WHOLE) - len(seen)) // max(len(ids), 1)
        freq, follower = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int32)
        freq[seen] = np.diff(upto, prepend=0) + 1
        wide = ids.astype(np.uint32)
        pairs = np.sort(np.delete(wide[:-1] << np.uint32(16) | wide[1:], slice(BLOCK - 1, None, BLOCK)))  # no pair reaches over a block's end
        edges = np.concatenate([np.zeros(min(len(pairs), 1), np.int64), np.nonzero(pairs[1:] != pairs[:-1])[0] + 1, np.full(min(len(pairs), 1), len(pairs))])
        pairs, n = pairs[edges[:-1]].astype(np.int64), np.diff(edges)
        order = np.lexsort((n, pairs >> 16))
        last = order[np.nonzero(np.diff(pairs[order] >> 16, append=-1))[0]]
        follower[pairs[last] >> 16] = pairs[last] & 65535
        return cls(freq, follower)

    def packed(self) -> bytes:
        seen = np.nonzero(self.counts)[0]
        return b"".join(x.astype("<u2").tobytes() for x in (seen, self.counts[seen] - 1, self.follower[seen]))

    @classmethod
    def unpacked(cls, data: bytes) -> Prior:
        seen, counts, follows = np.frombuffer(data, "<u2").astype(np.int64).reshape(3, -1)
        freq, follower = np.zeros(seen.max(initial=0) + 1, np.int64), np.zeros(seen.max(initial=0) + 1, np.int32)
        freq[seen], follower[seen] = counts + 1, follows
        return cls(freq, follower)


class Model:
    """The predictors and mixers of many blocks, one step at a time. Orders 1 and 2 are rows of one array, and their tables lie in one."""

    def __init__(self, lanes: int, prior: Prior):
        lane = np.arange(lanes)
        self.prior = prior
        self.table = np.zeros((lanes << BITS1) + (lanes << BITS2), np.int32)  # an entry is an id and, in its two lowest bits, how sure it is
        self.base = np.stack([lane << BITS1, (lanes << BITS1) + (lane << BITS2)])
        self.spread, self.shift = np.array([[0x9E3779B1], [0xC2B2AE35]], np.uint32), np.array([[32 - BITS1], [32 - BITS2]], np.uint32)
        self.weights, self.input = np.full((3, lanes), 1 << 14, np.int32), np.empty((3, lanes), np.int32)
        self.context, self.prev = np.zeros((2, lanes), np.uint32), np.zeros(lanes, np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidate of each lane and its probability, out of 4096."""
        self.slot = self.base + (self.context * self.spread >> self.shift)
        self.entry = self.table.take(self.slot)
        self.id, self.sure = self.entry >> 2, self.entry & 3
        one = np.where(self.sure[0], self.id[0], self.prior.follower.take(self.prev, mode="clip"))
        candidate = np.where(self.sure[1], self.id[1], one)
        self.prior.stretch.take(candidate, out=self.input[0], mode="clip")
        SAYS.take(self.sure << 1 | (self.id == candidate), out=self.input[1:], mode="clip")
        x = self.weights * self.input
        self.p = SQUASH.take((x[0] + x[1] + x[2] >> 14) + 2048, mode="clip")
        return candidate, self.p

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """What came: the ids, and where the candidate was right."""
        self.weights += self.input * (((hit.astype(np.int32) << 12) - self.p) * 3) + 0x2000 >> 14
        right = self.id == ids
        self.table[self.slot] = np.where(right, self.entry + (self.sure < 3), np.where(self.sure > 1, self.entry - 1, (ids.astype(np.int32) << 2) + 1))
        came = ids.astype(np.uint32)
        self.context[1] = self.context[0] * np.uint32(0x85EBCA6B) ^ came
        self.context[0] = came
        self.prev = ids


class Coder:
    """The ranges of many blocks. A range never falls below 2^30, so one step sends out one 32-bit word of a lane at most."""

    def __init__(self, lanes: int, prior: Prior):
        self.prior = prior
        self.low, self.size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def cut(self, p: np.ndarray) -> None:
        """The part of each range that stands for the candidate, and the unit of the rest."""
        self.inside = (self.size >> _U12) * p.astype(np.uint64)
        self.unit = (self.size - self.inside) >> _U16

    def narrow(self, ids: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Goes into the part of what came; the lanes whose top word is settled, and the words."""
        self.low += np.where(hit, _ZERO, self.inside + self.unit * self.prior.start.take(ids, mode="clip"))
        self.size = np.where(hit, self.inside, self.unit * self.prior.freq.take(ids, mode="clip"))
        same = (self.low ^ (self.low + self.size)) < _TOP
        go = np.nonzero(same | (self.size < _BOTTOM))[0]
        low = self.low[go]
        size = np.where(same[go], self.size[go], (_ZERO - low) & (_BOTTOM - np.uint64(1)))
        self.low[go], self.size[go] = low << _U32, size << _U32
        return go, low >> _U32


def encode_blocks(blocks: np.ndarray, prior: Prior) -> list[bytes]:
    """The code of each row of ids, shape (lanes, length)."""
    lanes, length = blocks.shape
    state, coder = Model(lanes, prior), Coder(lanes, prior)
    first = np.arange(lanes) * (length + 4)
    out, pos = np.zeros(lanes * (length + 4), np.uint32), first.copy()
    for ids in np.ascontiguousarray(blocks.T.astype(np.int64)):
        candidate, p = state.predict()
        hit = ids == candidate
        coder.cut(p)
        go, word = coder.narrow(ids, hit)
        state.update(ids, hit)
        at = pos[go]
        out[at], pos[go] = word, at + 1
    for shift in (_U32, _ZERO):
        out[pos] = coder.low >> shift & (_TOP - np.uint64(1))
        pos += 1
    return [out[a:b].astype("<u4").tobytes() for a, b in zip(first, pos, strict=True)]


def decode_blocks(codes: list[bytes], length: int, prior: Prior) -> np.ndarray:
    """The rows of ids that encode_blocks made the codes of."""
    lanes, wide = len(codes), max(map(len, codes)) // 4 + 4
    state, coder = Model(lanes, prior), Coder(lanes, prior)
    words = np.zeros((lanes, wide), np.uint32)
    for i, c in enumerate(codes):
        words[i, : len(c) // 4] = np.frombuffer(c, "<u4")
    words, pos = words.ravel(), np.arange(lanes) * wide
    code = words[pos].astype(np.uint64) << _U32 | words[pos + 1]
    pos += 2
    out = np.empty((length, lanes), np.uint16)
    for t in range(length):
        candidate, p = state.predict()
        coder.cut(p)
        offset = code - coder.low
        hit = offset < coder.inside
        ids = prior.id_of.take(((offset - coder.inside) // coder.unit).view(np.int64), mode="clip")  # meaningless where hit
        ids = np.where(hit, candidate, ids)
        out[t] = ids
        go, _ = coder.narrow(ids, hit)
        state.update(ids, hit)
        at = pos[go]
        code[go], pos[go] = code[go] << _U32 | words.take(at, mode="clip"), at + 1  # damaged code may ask for more
    return np.ascontiguousarray(out.T)


def spread(blocks: int) -> Iterator[tuple[int, int]]:
    """Runs of blocks that are coded side by side, all near the same number of lanes."""
    runs = max(1, -(-blocks // LANES))
    edges = [blocks * i // runs for i in range(runs + 1)]
    return zip(edges, edges[1:], strict=False)


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    """A file's parts: the index with the prior, then blocks."""
    prior = Prior.of(ids)
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + prior.packed(), 1)
    yield MAGIC + struct.pack("<QQII", len(doc_ids), len(ids), len(index), zlib.crc32(index)) + index
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint16)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1:]  # an id that the prior knows
    rows = padded.reshape(-1, BLOCK)
    for a, b in spread(blocks):
        for i, code in enumerate(encode_blocks(rows[a:b], prior) if b > a else [], a):
            n = min(BLOCK, len(ids) - i * BLOCK)
            yield struct.pack("<III", n, len(code), zlib.crc32(rows[i, :n].astype("<u2").tobytes())) + code


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a file; a damaged index or block raises ValueError."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    at = len(MAGIC) + 24
    docs, total, size, crc = struct.unpack("<QQII", data[len(MAGIC) : at])
    index = data[at : at + size]
    if zlib.crc32(index) != crc:
        raise ValueError("damaged index")
    index = zlib.decompress(index)
    prior = Prior.unpacked(index[12 * docs :])
    at += size
    heads, codes = [], []
    while at < len(data):
        n, size, crc = struct.unpack("<III", data[at : at + 12])
        codes.append(data[at + 12 : at + 12 + size])
        heads.append((n, crc))
        at += 12 + size
    if len(codes) != -(-total // BLOCK):
        raise ValueError("blocks are missing")
    ids = np.empty(total, np.uint16)
    done = 0
    for a, b in spread(len(codes)):
        for row, (n, crc) in zip(decode_blocks(codes[a:b], BLOCK, prior).astype("<u2") if b > a else [], heads[a:b], strict=True):
            if zlib.crc32(row[:n].tobytes()) != crc:
                raise ValueError("damaged block")
            ids[done : done + n] = row[:n]
            done += n
    if done != total:
        raise ValueError("blocks are missing")
    return np.frombuffer(index[: 8 * docs], "<i8"), np.frombuffer(index[8 * docs : 12 * docs], "<u4").astype(np.int64), ids


LETTER, NUMBER, BLANK, OTHER, NEW = range(5)
is_blank = re.compile(f"[{SPACE}]").match


@cache
def kinds() -> np.ndarray:
    """What each character is to the split pattern of byte-level BPE; NEW are those that Python's tables do not know."""
    made = np.full(0x110000, OTHER, np.uint8)
    of = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        made[c] = NEW if category == "Cn" else of.get(category[0], OTHER)
    made[[c for c in range(0x3001) if is_blank(chr(c))]] = BLANK
    return made


def word_starts(chars: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the words of texts laid end to end begin, firsts being where the texts do.

    Letters, numbers and other characters run together, a space before a run goes with it, and of a run of blanks all but the last are a word where
    something follows. An apostrophe alone takes a contraction's letters from the run after it.
    """
    n = len(chars)
    kind = kinds().take(chars)
    first = np.zeros(n + 4, bool)
    first[firsts] = True
    start = first.copy()
    start[n] = True
    start[1:n] |= kind[1:] != kind[:-1]
    after = np.nonzero((kind[1:] != BLANK) & (kind[:-1] == BLANK) & ~first[1:n])[0] + 1
    start[after - 1] = True
    start[after[chars[after - 1] == 32]] = False
    lone = np.nonzero(chars[: n - 1] == 39)[0]
    lone = lone[start[lone] & (kind[lone + 1] == LETTER) & ~first[lone + 1]]
    a, b = chars[lone + 1], chars[np.minimum(lone + 2, n - 1)]
    short = np.isin(a, [ord(c) for c in "stmd"])
    both = np.zeros(len(lone), bool)
    for x, y in ("re", "ve", "ll"):
        both |= (a == ord(x)) & (b == ord(y)) & (lone + 2 < n) & ~first[lone + 2]
    for where, taken in ((lone[short], 1), (lone[both & ~short], 2)):
        start[where + 1] = False
        start[where + 1 + taken] = True
    texts = np.append(firsts, n)
    new = np.nonzero(kind == NEW)[0]
    for t in np.unique(np.searchsorted(texts, new, "right") - 1):  # the library splits these itself
        start[texts[t] + 1 : texts[t + 1]] = False
    start[n + 1 :] = False
    return np.nonzero(start[: n + 1])[0]


between = re.compile(r"(?<=[!-~]) (?=[!-~])").search


def pieces(text: str) -> list[str]:
    """A long text in pieces of about CUT characters, cut before a single space between two printing ASCII characters, where a word begins; what has no such place stays whole."""
    cuts = [0]
    while len(text) - cuts[-1] > CUT and (m := between(text, cuts[-1] + CUT)):
        cuts.append(m.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class Words:
    """Encodes texts with the tokenizers library, each distinct word once; a text's words do not touch each other in byte-level BPE.

    Words are found by a 64-bit hash and compared character by character, so that none is taken for another: one that meets another's hash is encoded each
    time, as are longer words than LONG. Characters and ids of the known words lie in two arrays. The table is emptied when half its slots or an array is
    full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core: threads of its own would only wait for each other
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.factor = int.from_bytes(os.urandom(8), "little") | 1
        self.powers = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.keys, self.word = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.first, self.count, self.ids = np.zeros(SLOTS // 2, np.int32), np.zeros(SLOTS // 2, np.int32), np.zeros(HELD_IDS, np.uint16)
        self.letter, self.span, self.letters = np.zeros(SLOTS // 2, np.int32), np.zeros(SLOTS // 2, np.int32), np.zeros(HELD_CHARS, np.uint32)
        self.words, self.held, self.spelt = 0, 0, 0

    def hashes(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A hash of each word: the difference of a running polynomial, brought back to power 0."""
        if len(self.powers) <= len(chars):
            powers = np.empty((2, max(1 << 20, len(chars) + 1)), np.uint64)
            powers[0], powers[1], powers[:, 0] = self.factor, pow(self.factor, -1, 1 << 64), 1
            self.powers, self.inverse = np.cumprod(powers, axis=1, dtype=np.uint64)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars + np.uint32(1)).astype(np.uint64) * self.powers[: len(chars)], dtype=np.uint64)])
        h = (upto[starts[1:]] - upto[starts[:-1]]) * self.inverse[starts[:-1]]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + np.diff(starts).astype(np.uint64)
        return np.maximum(h ^ (h >> np.uint64(29)), np.uint64(1))  # 0 marks a free slot

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's word, or -1."""
        out = np.full(len(h), -1, np.int32)
        at = (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[at]
            same = key == h[left]
            out[left[same]] = self.word[at[same]]
            on = ~same & (key != 0)
            left, at = left[on], (at[on] + 1) & (SLOTS - 1)
        return out

    def other(self, word: np.ndarray, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the known word of the same hash is another word, or none is known."""
        spans = np.diff(starts)
        differ = (word < 0) | (self.span.take(word, mode="clip") != spans)
        places = np.repeat(self.letter.take(word, mode="clip") - starts[:-1], spans)
        places += np.arange(len(chars))
        unlike = np.nonzero(self.letters.take(places, mode="clip") != chars)[0]
        differ[np.searchsorted(starts, unlike, "right") - 1] = True
        return differ

    def learn(self, h: np.ndarray, ids: list[list[int]], letters: np.ndarray, lengths: np.ndarray) -> None:
        """Adds distinct words that are not known, their characters end to end."""
        stops = self.spelt + np.cumsum(lengths)
        own = slice(self.words, self.words + len(h))
        self.letter[own], self.span[own], self.letters[self.spelt : stops[-1]] = stops - lengths, lengths, letters
        self.spelt = int(stops[-1])
        sizes = np.array([len(i) for i in ids], np.int64)
        ends = self.held + np.cumsum(sizes)
        new = np.arange(self.words, self.words + len(h), dtype=np.int32)
        self.first[new], self.count[new] = ends - sizes, sizes
        self.ids[self.held : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint16, int(sizes.sum()))
        self.held, self.words = int(ends[-1]), self.words + len(h)
        at = (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):  # each free slot takes the first that asks
            free = np.nonzero(self.keys[at] == 0)[0]
            slot, who = np.unique(at[free], return_index=True)
            won = free[who]
            self.keys[slot], self.word[slot] = h[left[won]], new[left[won]]
            on = np.ones(len(left), bool)
            on[won] = False
            left, at = left[on], (at[on] + 1) & (SLOTS - 1)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, as unsigned 16-bit integers, and the number of each text's."""
        texts = [t or "" for t in texts]
        if len(texts) > 1 and any(len(t) > CUT for t in texts) or len(pieces(texts[0] if texts else "")) > 1:
            parts = [[self([piece])[0] for piece in pieces(t)] for t in texts]
            return np.concatenate([x for own in parts for x in own]), np.array([sum(map(len, own)) for own in parts], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        if not whole:
            return np.empty(0, np.uint16), np.zeros(len(texts), np.int64)
        chars, ends = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(sizes)
        firsts = (ends - sizes)[sizes > 0]
        starts = word_starts(chars, firsts)
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        for i in odd:  # the library finds the special tokens
            starts = starts[(starts <= ends[i] - sizes[i]) | (starts >= ends[i])]
        spans = np.diff(starts)
        apart = spans > LONG
        if odd:
            apart |= np.isin(starts[:-1], (ends - sizes)[odd])
        h = self.hashes(chars, starts)
        word = np.where(apart, -2, self.find(h))
        new, where = np.unique(h[word == -1], return_index=True)
        if len(new):
            where = np.nonzero(word == -1)[0][where]
            ids = self.encoded([whole[starts[i] : starts[i + 1]] for i in where])
            if self.words + len(new) > SLOTS // 2 or self.held + sum(map(len, ids)) > HELD_IDS or self.spelt + spans[where].sum() > HELD_CHARS:
                self.clear()
                if len(texts) > 1:  # what was known is to be learnt again, perhaps by halves
                    half = len(texts) // 2
                    parts = [self(texts[:half]), self(texts[half:])]
                    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                return np.array(self.encoded(texts)[0], np.uint16), np.array([len(self.encoded(texts)[0])], np.int64)
            upto = np.cumsum(spans[where])
            letters = chars[np.repeat(starts[where] - upto + spans[where], spans[where]) + np.arange(upto[-1])]
            self.learn(new, ids, letters, spans[where])
            word[word == -1] = self.find(h[word == -1])
        apart |= self.other(word, chars, starts)
        long = np.nonzero(apart)[0]
        alone = self.encoded([whole[starts[i] : starts[i + 1]] for i in long])
        counts = self.count.take(word, mode="clip").astype(np.int64)
        counts[long] = [len(x) for x in alone]
        upto = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(self.first.take(word, mode="clip").astype(np.int64) - upto[:-1], counts) + np.arange(upto[-1])
        ids = self.ids.take(places, mode="clip")
        for i, x in zip(long, alone, strict=True):
            ids[upto[i] : upto[i + 1]] = x
        edges = upto[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return ids, np.diff(edges)


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One table of words for a worker and file; it outlives the task."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def write(docs: DataFrame, path: str, base: str | None = None, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id", most_ids: int = 1 << 23) -> DataFrame:
    """Files of each range of doc ids under base; (file, before, docs, ids), before being the ids of all files before it."""
    base = base or new_shared_path(docs.sparkSession, "ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        files, root = fs.FileSystem.from_uri(base)
        words = words_of(path)
        made: list[tuple] = []
        names: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> None:
            files.create_dir(root, recursive=True)
            name = f"{ctx.partitionId():06d}-{len(made):05d}-{ctx.taskAttemptId()}.ids"
            docs, sizes, flat = np.concatenate(names), np.concatenate(lengths), np.concatenate(ids)
            with files.open_output_stream(f"{root}/{name}") as out:
                for part in pack(docs, sizes, flat):
                    out.write(part)
            made.append((f"{base}/{name}", ctx.partitionId(), len(made), len(docs), len(flat)))
            names.clear()
            lengths.clear()
            ids.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                flat, sizes = words(batch.column(1).to_pylist())
                names.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                lengths.append(sizes + 1)
                ids.append(np.insert(flat, np.cumsum(sizes), end_id))
                if sum(map(len, ids)) >= most_ids:
                    flush()
        if names:
            flush()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["file", "part", "ordinal", "docs", "ids"])

    made = written(rows.mapInArrow(save, "file string, part int, ordinal int, docs long, ids long"), "id-files")
    before = Window.orderBy("part", "ordinal").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return written(made.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"), "docs", "ids"), "id-file-list")


def read(listed: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all documents in listed files, ids packed as little-endian unsigned 32-bit integers."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, path = fs.FileSystem.from_uri(name)
                with files.open_input_file(path) as f:
                    names, lengths, ids = unpack(f.read())
                ends = np.cumsum(lengths)
                for a in range(0, len(names), 2000):
                    span = range(a, min(a + 2000, len(names)))
                    packed = [ids[ends[i] - lengths[i] : ends[i]].astype("<u4").tobytes() for i in span]
                    doc_ids = pa.array([None if names[i] == NULL_ID else int(names[i]) for i in span], pa.int64())
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array([before + int(ends[i] - lengths[i]) for i in span], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "start", "ids"])

    files = max(1, listed.count())
    return listed.select("file", "before").repartition(files).mapInArrow(load, "doc_id long, start long, ids binary")
