"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles: a shingle weighs 1 + log(its count in the text), times 1 + RARE * log(N / df) / log(N), df being
the documents that hold it. Two texts are similar if their weighted Jaccard similarity is SIMILAR or more. Since what sets two copies apart is rarer than
what thousands of copies share, the weights alone would part large groups at the threshold; so pairs from floor(SIMILAR) on, which no pair of single
shingles falls below whose plain Jaccard similarity is SIMILAR, are also similar if that plain similarity is SIMILAR or more. df is counted over all documents in a table of 2^20 counters, whose median, the load that chance puts on any counter, is taken off; the
table has a fixed size and is broadcast. Each of 48 samples draws one shingle of a text so that two texts draw the same with probability of their
weighted Jaccard similarity; 16 bands of 3 samples put texts into buckets.

Exact copies are one text from the start. In each bucket one text is the hub: in even bands the one that shares most buckets, which in a group of
copies is the one nearest to all, in odd bands one by a hash that differs from band to band. The others are compared with it by true weighted Jaccard
similarity, and verified links join texts to classes, which settles most of a group of copies at a cost in proportion to its size. Then every bucket
whose texts are not all of one class is finished: those outside its largest class are compared with all the others of other classes, except pairs that a
bound excludes. Two bounds hold without exception: similarity is at most the ratio of the total weights, and 1 - similarity is a metric, so two texts
whose weighted similarities to the bucket's hub lie more than 1 - floor(SIMILAR) apart are not similar. So each pair that shares a bucket is in one class, compared, or
excluded; the only links that can be missed are those of pairs that share no bucket (a chance of 2e-5 at weighted similarity 0.8, 4e-4 at the floor).

df comes from counters that other shingles share; what chance adds to a counter moves a weight by less than RARE and in all texts alike, so similarities
stay exact for the weights in use.

Texts of one to four words are one shingle of all their words. Defined results: a null or empty text (or one of spaces) is similar to no text but
its equals, null counting as empty; ids are whole numbers, others fail the cast; rows that repeat an id are one document, and so in one class, and dedup
keeps the least text of them; rows without an id have no class, and dedup keeps them all; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm.common import written

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 3
COUNTERS = 20  # bits
RARE = 0.5
#: Counters of a row of partial counts, and shingles that are sampled together.
BLOCK = 1 << 11
TOGETHER = 200_000
#: Shingles of hubs that a task keeps.
HUBS_HELD = 200_000
#: Texts of a bucket that are held while the bucket's others stream past.
HELD = 256

_rng = np.random.default_rng(20)
_POWERS = np.cumprod(np.full(1 << 14, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_PLACES = _POWERS[[3, 14, 159, 265, 358]]
_SALTS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_R = _rng.gamma(2, 1, 1 << 16).astype(np.float32)
_LOGC = np.log(_rng.gamma(2, 1, 1 << 16)).astype(np.float32)
_BETA = _rng.uniform(0, 1, 1 << 16).astype(np.float32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's distinct shingles in ascending order, and their counts."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    solid = (b != 32) & ((b < 9) | (b > 13))
    starts = np.nonzero(solid & np.concatenate([[True], ~solid[:-1]]))[0] if len(b) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(b)))
    inside = np.arange(starts[0], len(b)) - np.repeat(starts, lengths)
    value = np.where(solid[starts[0] :], b[starts[0] :].astype(np.uint64) + np.uint64(1), np.uint64(0)) * _POWERS[inside & (len(_POWERS) - 1)]
    words = mixed(np.add.reduceat(value, starts - starts[0]))
    n = min(WORDS, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h += words[i : len(words) - n + 1 + i] * _PLACES[i]
    return np.unique(mixed(h + np.uint64(n)), return_counts=True)


def counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS)).astype(np.int64)


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The table of document counts, and the number of documents. Partial tables are summed by blocks of counters, as they stream in."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(1 << COUNTERS, np.int32), 0
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, counter(shingles(text.as_py())[0]), 1)
            n += batch.num_rows
        if n:
            blocks = counts.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(blocks))], pa.int32()), pa.array([np.array([n], np.int32).tobytes(), *(x.tobytes() for x in blocks)], pa.binary())], ["block", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, np.int64(0)) + np.frombuffer(counts, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])

    parts = docs.select("text").mapInArrow(partial, "block int, counts binary")
    blocks = {r.block: np.frombuffer(bytes(r.counts), np.int64) for r in parts.repartition("block").mapInArrow(summed, "block int, counts binary").collect()}
    if not blocks:
        return np.zeros(1 << COUNTERS, np.int64), 0
    return np.concatenate([blocks[i] for i in range((1 << COUNTERS) // BLOCK)]), int(blocks[-1][0])


def log_idf(counts: np.ndarray, n: int) -> np.ndarray:
    """The log of a shingle's weight, by counter."""
    df = np.clip(counts - np.median(counts), 1, max(n, 1))
    return np.log1p(RARE * np.log(max(n, 1) / df) / np.log(max(n, 2))).astype(np.float32)


def weights(s: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The weights of a set's shingles."""
    return (1 + np.log(s[1])) * np.exp(idf[counter(s[0])].astype(np.float64))


def samples(sets: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """A row of samples for each non-empty weighted set (hashes, counts)."""
    h = np.concatenate([s[0] for s in sets])
    logw = np.log1p(np.log(np.concatenate([s[1] for s in sets]))).astype(np.float32) + idf[counter(h)]
    sizes = np.array([len(s[0]) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for k, salt in enumerate(_SALTS):
        m = (h ^ salt) * np.uint64(0x9E3779B97F4A7C15)
        m ^= m >> np.uint64(31)
        m *= np.uint64(0xD6E8FEB86659FD93)
        r, beta = _R[m >> np.uint64(48)], _BETA[(m >> np.uint64(32)) & np.uint64(0xFFFF)]
        t = np.floor(logw / r + beta)
        loga = _LOGC[(m >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - beta + np.float32(1))
        least = np.repeat(np.minimum.reduceat(loga, starts), sizes)
        drawn = np.where(loga == least, m ^ t.astype(np.int64).astype(np.uint64) * np.uint64(0xA0761D6478BD642F), np.uint64(2**64 - 1))
        out[:, k] = np.minimum.reduceat(drawn, starts)
    return out


def bands(drawn: np.ndarray) -> np.ndarray:
    x = drawn.reshape(-1, BANDS, ROWS)
    h = np.zeros(x.shape[:2], np.uint64)
    for i in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return h.view(np.int64)


def signatures(texts: DataFrame, idf) -> DataFrame:
    """(v, weight, bands) of each text of (v, text) that has words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value

        def done(ids: list, sets: list) -> pa.RecordBatch:
            weight = [float(weights(s, table).sum()) for s in sets]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(weight, pa.float64()), pa.array(bands(samples(sets, table)).tolist(), pa.list_(pa.int64()))], ["v", "weight", "bands"])

        for batch in batches:
            ids, sets, held = [], [], 0
            for v, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py())
                if len(s[0]):
                    ids.append(v)
                    sets.append(s)
                    held += len(s[0])
                if held > TOGETHER:
                    yield done(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield done(ids, sets)

    return texts.select("v", "text").mapInArrow(sign, "v long, weight double, bands array<long>")


def similarity(a: tuple, b: tuple, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets (hashes, counts)."""
    wa, wb = weights(a, idf), weights(b, idf)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    whole = wa.sum() + wb.sum() - both
    return float(both / whole) if whole else 0.0


def floor(least: float) -> float:
    """The least weighted similarity of two sets of single shingles whose plain similarity is least: all that differs is as rare as can be, all that is shared as common."""
    return least / (least + (1 - least) * (1 + RARE))


def alike(a: tuple, b: tuple, score: float, least: float) -> bool:
    """Whether two sets of that weighted similarity are similar."""
    if score >= least or score < floor(least):
        return score >= least
    both = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return both >= least * (len(a[0]) + len(b[0]) - both)


def verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """(v, hub, score, similar) of pairs (v, hub), the score being their similarity."""
    own = texts.select("v", F.col("text").alias("own"))
    hubs = texts.select(F.col("v").alias("hub"), F.col("text").alias("other"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        known: OrderedDict[int, tuple] = OrderedDict()  # hubs recur
        held = 0
        for batch in batches:
            out = []
            for v, hub, mine, other in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if hub not in known:
                    known[hub] = shingles(other)
                    held += len(known[hub][0])
                    while len(known) > 1 and held > HUBS_HELD:
                        held -= len(known.popitem(last=False)[1][0])
                own = shingles(mine)
                score = similarity(own, known[hub], table)
                out.append((v, hub, score, alike(own, known[hub], score, least)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["v", "hub", "score", "similar"])

    return pairs.join(own, "v").join(hubs, "hub").select("v", "hub", "own", "other").mapInArrow(compare, "v long, hub long, score double, similar boolean")


def components(links: DataFrame) -> DataFrame:
    """(v, c): each linked vertex with the least vertex of its component. Labels fall along links, then jump to their labels' labels."""
    edges = written(links.select("v", "hub").unionByName(links.select(F.col("hub").alias("v"), F.col("v").alias("hub"))).distinct(), "near-edges")
    labels = written(edges.groupBy("v").agg(F.least("v", F.min("hub")).alias("c")), "near-labels")
    while True:
        of = labels.select(F.col("v").alias("hub"), F.col("c").alias("d"))
        near = edges.join(of, "hub").groupBy("v").agg(F.min("d").alias("d"))
        met = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "d").alias("hub"))
        new = written(met.join(of, "hub").select("v", F.least("hub", "d").alias("c"), "old"), "near-labels")
        moved = not new.filter("c <> old").isEmpty()
        labels = new.select("v", "c")
        if not moved:
            return labels


def settled(beside: DataFrame, judged: DataFrame, found: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """(v, hub): the links that are missing between components of a bucket. beside has all texts of a bucket but its hub, judged their scores against it.

    The texts outside a bucket's largest component are held in blocks of HELD, and the bucket's texts stream past each block. A pair is looked at in the
    first band that it shares.
    """
    ratio = F.least("weight", "hub_weight") / F.greatest("weight", "hub_weight")
    scored = beside.join(judged.select("v", "hub", "score"), ["v", "hub"], "left").join(found, "v", "left")
    # between low and high lies the similarity to the hub
    placed = scored.select("band", "key", "v", "weight", "bands", F.coalesce("c", "v").alias("c"), F.coalesce("score", F.lit(0.0)).alias("low"), F.coalesce("score", ratio).alias("high"))
    placed = written(placed, "near-placed")
    sizes = placed.groupBy("band", "key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "key")
    several = sizes.agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    several = several.select("band", "key", F.col("most.c").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / HELD).cast("int").alias("blocks"))
    inside = placed.join(several, ["band", "key"])
    held = inside.filter("c <> main").withColumn("block", F.pmod(F.xxhash64("v"), "blocks").cast("int")).withColumn("past", F.lit(0))
    past = inside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("past", F.lit(1))
    columns = ["band", "key", "block", "past", "v", "weight", "bands", "c", "low", "high", "main", "text"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at, block, stack, low_score = idf.value, None, [], None, floor(least)
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        for batch in batches:
            out = []
            cells = [column.to_pylist() for column in batch.columns[:-1]]
            for band, key, part, past, v, weight, keys, c, low, high, main, text in zip(*cells, batch.column(len(columns) - 1), strict=True):
                if at != (band, key, part):
                    at, block, stack = (band, key, part), [], None
                    root.clear()
                if not past:
                    block.append((v, weight, keys[:band], c, low, high, shingles(text.as_py())))
                    continue
                if not block:
                    continue
                if stack is None:
                    stack = Stack(block, table)
                    tops = np.array([top(x[3]) for x in block])
                mine = top(c)
                open_ = (tops != mine) & ((c == main) | (stack.v < v))
                open_ &= np.minimum(stack.weight, weight) >= np.maximum(stack.weight, weight) * (low_score - 1e-6)
                open_ &= np.maximum(stack.low - high, low - stack.high) <= 1 - low_score + 1e-6
                if band and open_.any():
                    open_ &= ~(stack.keys == np.array(keys[:band])).any(axis=1)
                if not open_.any():
                    continue
                s = shingles(text.as_py())
                scores = stack.scores(s, weights(s, table))
                for i in np.nonzero(open_ & (scores >= low_score - 1e-9))[0]:
                    if tops[i] != mine and alike(s, block[i][6], similarity(s, block[i][6], table), least):
                        out.append((v, block[i][0]))
                        root[int(tops[i])] = mine
                        tops[tops == tops[i]] = mine
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], ["v", "hub"])

    rows = held.unionByName(past).join(texts, "v").select(columns)
    return rows.repartition("band", "key", "block").sortWithinPartitions("band", "key", "block", "past").mapInArrow(link, "v long, hub long")


class Stack:
    """Texts that are compared together: their shingles in one sorted array."""

    def __init__(self, block: list[tuple], idf: np.ndarray):
        self.v, self.weight = np.array([x[0] for x in block]), np.array([x[1] for x in block])
        self.keys = np.array([x[2] for x in block], np.int64)
        self.low, self.high = np.array([x[4] for x in block]), np.array([x[5] for x in block])
        w = [weights(x[6], idf) for x in block]
        h = np.concatenate([x[6][0] for x in block])
        order = np.argsort(h)
        self.of = np.repeat(np.arange(len(block)), [len(x) for x in w])[order]
        self.each, self.sums = np.concatenate(w)[order], np.array([x.sum() for x in w])
        self.h = np.unique(h)
        self.ends = np.searchsorted(h[order], self.h, "right")
        self.starts = np.concatenate([[0], self.ends[:-1]])

    def scores(self, s: tuple[np.ndarray, np.ndarray], w: np.ndarray) -> np.ndarray:
        """The weighted Jaccard similarity of each text with the set s of weights w."""
        at = np.searchsorted(self.h, s[0])
        at[at == len(self.h)] = 0
        known = self.h[at] == s[0]
        at, mine = at[known], w[known]
        n = self.ends[at] - self.starts[at]
        place = np.arange(n.sum()) + np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.empty(0, np.int64)
        both = np.bincount(self.of[place], np.minimum(self.each[place], np.repeat(mine, n)), len(self.sums))
        return both / (self.sums + w.sum() - both)


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = SIMILAR) -> DataFrame:
    """(id, class_id): one row per id, the class being the least id in it."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("v"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("v is not null")
    counts, n = document_counts(rows)
    idf = spark.sparkContext.broadcast(log_idf(counts, n))
    # exact copies: one vertex, their least id
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    ids = written(rows.select("v", digest.alias("digest")), "near-ids")
    copies = written(ids.groupBy("digest").agg(F.min("v").alias("rep"), F.count(F.lit(1)).alias("n")), "near-copies")
    signed = written(signatures(rows, idf), "near-signed")
    reps = copies.select(F.col("rep").alias("v")).distinct()
    signed = signed.join(reps, "v", "left_semi").dropDuplicates(["v", "bands"])
    signed = written(signed, "near-texts-signed")
    keys = signed.select("v", F.posexplode("bands").alias("band", "key"))
    sizes = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(keys.join(sizes, ["band", "key"]), "near-shared")
    known = shared.groupBy("v").agg(F.sum("n").alias("known"))
    members = written(shared.drop("n").join(known, "v").join(signed, "v").select("v", "weight", "bands", "known", "band", "key"), "near-members")
    first = F.struct(F.when(F.col("band") % 2 == 0, -F.col("known")).otherwise(0).alias("known"), F.xxhash64("v", "band").alias("order"), "v", "weight")
    hubs = members.groupBy("band", "key").agg(F.min(first).alias("h")).select("band", "key", F.col("h.v").alias("hub"), F.col("h.weight").alias("hub_weight"))
    beside = written(members.join(hubs, ["band", "key"]).filter("v <> hub").drop("known"), "near-beside")
    links = None
    if not beside.isEmpty():
        # similarity is at most the ratio of the total weights
        close = F.least("weight", "hub_weight") >= F.greatest("weight", "hub_weight") * (floor(least) - 1e-6)
        pairs = written(beside.filter(close).select("v", "hub").distinct(), "near-pairs")
        wanted = beside.select("v").unionByName(beside.select(F.col("hub").alias("v"))).distinct()
        texts = written(rows.join(wanted, "v", "left_semi").dropDuplicates(["v", "text"]), "near-texts")
        judged = written(verified(pairs, texts, idf, least), "near-judged")
        links = judged.filter("similar").select("v", "hub")
        links = links.unionByName(written(settled(beside, judged, components(links), texts, idf, least), "near-settled"))
    joined = ids.join(copies.select("digest", "rep"), "digest").filter("v <> rep").select("v", F.col("rep").alias("hub"))
    links = joined if links is None else links.unionByName(joined)
    found = components(links)
    return ids.select("v").distinct().join(found, "v", "left").select(F.col("v").alias(id_col), F.coalesce("c", "v").alias("class_id"))


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = SIMILAR) -> DataFrame:
    """docs without all but one document of each class: that with the least id stays, and of its rows the one of the least text; rows without an id stay."""
    stay = classes(docs, text_col, id_col, least).filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias("stay"))
    rows = docs.select(F.col(id_col).cast("long").alias("v"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(stay, F.col("v") == F.col("stay"), "left_semi")
    rest = F.array(*(F.col(f"row.`{c}`").cast("string") for c in docs.columns))
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("text", rest))).filter("n = 1")
    return one.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)).unionByName(docs.filter(F.col(id_col).isNull()))
