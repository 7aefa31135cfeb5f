"""Media columns: content-addressed payloads in tar shards.

A payload is a text's UTF-8 bytes, zero-padded to a positive multiple of 64, kept losslessly as an 8-bit greyscale PNG of width 64. Each task appends its
payloads to tar shards of its own in the shared folder, under the payload's sha256 as name; a payload that its shard holds already is not stored again,
and its row points at the stored one. Where several tasks have stored a payload, content_index() names its one place, and all its rows point there, so
that a digest has one address over the whole table; what the other tasks stored of it is never read. Rows carry shard, offset, length and digest. Reading
goes by ranges: the first bytes of a member give the metadata columns, its whole range the payload and its features.

A shard's name carries the task attempt, and rows come only from the attempt that succeeded, so a lost executor leaves an orphan file and no wrong row.
Shard and offset depend on the run, all other columns on the text alone.

Defined results: a null text is stored as the empty one; rows of equal texts have equal values in all columns, the place too; an empty table writes no
shard; other columns are kept unless a result column has their name.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.common import new_shared_path, written

UNIT = 64
SHARD_BYTES = 256 << 20
#: Bytes that a header-only read takes: the tar header, then the PNG's signature and first chunk.
HEADER = 512 + 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
PLACE = "digest string, shard string, offset long, length long, n_bytes long"
META = "media_type string, width long, height long, bit_depth int"
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Payloads with several places that are few enough to be broadcast: a row takes about 300 bytes.
FEW = 100_000
#: Members whose values a reading task keeps for rows that point at the same place.
KEPT_MEMBERS = 10_000


def payload_of(text: str | bytes | None) -> bytes:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # each line begins with filter type 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width = 8, b"", 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


class ShardWriter:
    """Appends members to tar files of at most SHARD_BYTES each."""

    def __init__(self, base: str, task: str):
        self.files, self.root = fs.FileSystem.from_uri(base)
        self.base, self.task, self.n, self.out = base, task, 0, None
        self.places: dict[str, tuple[str, int, int]] = {}

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * 512))  # the end of a tar file
            self.out.close()
            self.out = None

    def add(self, payload: bytes) -> tuple[str, str, int, int]:
        digest = hashlib.sha256(payload).hexdigest()
        if digest not in self.places:
            media = to_png(payload)
            if self.out is None or self.out.tell() + len(media) > SHARD_BYTES and self.out.tell():
                self.close()
                self.name = f"{self.task}-{self.n:04d}.tar"
                self.files.create_dir(self.root, recursive=True)
                self.out = self.files.open_output_stream(f"{self.root}/{self.name}")
                self.places.clear()
                self.n += 1
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            at = self.out.tell()
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % 512))
            self.places[digest] = (f"{self.base}/{self.name}", at, len(media))
        return (digest, *self.places[digest])


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def extended(df: DataFrame, ddl: str, step) -> DataFrame:
    """df with more columns, made a batch at a time by step(batch), which is the result of step's own start in each task."""
    new = fields(ddl)
    kept = [c for c in df.columns if c not in {f.name for f in new}]
    schema = T.StructType([*(df.schema[c] for c in kept), *new])
    arrow = [pa.field(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.dataType.simpleString()]) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, end = step()
        for batch in batches:
            rows = [row(r) for r in batch.to_pylist()]
            made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *(f.name for f in new)])
        end()

    return df.mapInArrow(run, schema)


def store(docs: DataFrame, base: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row's payload written to tar shards under base; the rows' places, themselves written once."""
    base = base or new_shared_path(docs.sparkSession, "media")
    read = docs.select(*dict.fromkeys([*(docs.columns if keep is None else keep), text_col]))

    def step():
        ctx = TaskContext.get()
        writer = ShardWriter(base, f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}")

        def row(r: dict) -> tuple:
            payload = payload_of(r[text_col])
            return (*writer.add(payload), len((r[text_col] or "").encode("utf-8", "surrogatepass")))

        return row, writer.close

    places = extended(read, PLACE, step)
    return settled(written(places if keep is None else places.select(*(c for c in keep if c in places.columns), *(f.name for f in fields(PLACE))), "media-places"))


class Ranges:
    """Reads ranges of files, with the last file open."""

    def __init__(self):
        self.name, self.file = None, None

    def __call__(self, name: str, at: int, n: int) -> bytes:
        if name != self.name:
            files, path = fs.FileSystem.from_uri(name)
            self.close()
            self.name, self.file = name, files.open_input_file(path)
        return self.file.read_at(n, at)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def header_of(ranges: Ranges, r: dict) -> tuple:
    """The metadata of a row's member, from its first bytes."""
    head = ranges(r["shard"], r["offset"], HEADER)
    info = tarfile.TarInfo.frombuf(head[:512], "utf-8", "surrogateescape")
    if info.name != f"{r['digest']}.png" or info.size != r["length"]:
        raise ValueError(f"{r['shard']} holds another member at {r['offset']}")
    width, height, depth = struct.unpack(">IIB", head[512 + 16 : 512 + 25])
    return "image/png", width, height, depth


def headers(places: DataFrame) -> DataFrame:
    """places with metadata columns, from the first bytes of each member alone."""

    def step():
        ranges = Ranges()
        return lambda r: header_of(ranges, r), ranges.close

    return extended(places, META, step)


def feature_of(payload: bytes) -> str:
    """Least, greatest, sum and sum of squares of the samples, changes between neighbours' halves, and counts in 8 equal bins."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256)
    seen = np.nonzero(counts)[0]
    turns = int(np.count_nonzero((x[1:] ^ x[:-1]) & 0x80))
    bins = ",".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))
    return f"{seen[0]}:{seen[-1]}:{counts @ level}:{counts @ (level * level)}:{turns}:{bins}"


def load(places: DataFrame) -> DataFrame:
    """places with metadata columns, and with digests and features of the payloads read back from their ranges."""

    def step():
        ranges = Ranges()
        known: OrderedDict[tuple[str, int], tuple] = OrderedDict()

        def row(r: dict) -> tuple:
            key = r["shard"], r["offset"]
            if key not in known:
                head = header_of(ranges, r)
                media = ranges(r["shard"], r["offset"] + 512, r["length"])
                payload = from_png(media)
                known[key] = (*head, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload))
                if known[key][5] != r["digest"]:
                    raise ValueError(f"{r['shard']} holds another payload at {r['offset']}")
                if len(known) > KEPT_MEMBERS:
                    known.popitem(last=False)
            return known[key]

        return row, ranges.close

    return extended(places, f"{META}, {READ}", step)


def content_index(places: DataFrame) -> DataFrame:
    """(digest, shard, offset, length, places): one place for each payload, the first by shard and offset, and how many it has been stored at."""
    at = places.select("digest", "shard", "offset", "length").distinct()  # combined before the shuffle: a hot digest is a row a task
    return at.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"), F.count(F.lit(1)).alias("places")).select("digest", "at.*", "places")


def settled(places: DataFrame) -> DataFrame:
    """places with each row at its payload's one place. Only payloads that have several are joined, broadcast where they are counted and few."""
    moved = content_index(places).filter("places > 1")
    moved = written(moved.select(F.col("digest").alias("moved_digest"), F.struct("shard", "offset", "length").alias("moved_to")), "media-moved")
    moved = F.broadcast(moved) if moved.count() <= FEW else moved
    columns = places.columns
    rows = places.select(F.col("digest").alias("own_digest"), F.struct("shard", "offset", "length").alias("own"), F.struct(*columns).alias("row"))
    joined = rows.join(moved, F.col("own_digest") == F.col("moved_digest"), "left").withColumn("place", F.coalesce("moved_to", "own"))
    new = ("shard", "offset", "length")
    return joined.select(*(F.col(f"place.{c}" if c in new else f"row.`{c}`").alias(c) for c in columns))
