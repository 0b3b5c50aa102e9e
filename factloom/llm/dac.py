"""Token-ID files of directly addressable codes.

Each id is cut into chunks of 8 bits.  Level 1 holds the lowest chunk of every id and one
continuation bit per id; level 2 holds the next chunk of the ids whose bit is set, and so on.  A
rank directory (set bits before each block of 512) finds an id's place on the next level, so any
id is read from a few bytes, found by their places in the file, without decoding a block.

A file is a row of segments, each of the documents of some ``SEGMENT_BYTES`` of text (or of one longer
document), then an index of the segments.  Files hold documents in ascending id order; file k's
documents come before those of file k + 1.  The number of files follows the bytes of text.

Cases: null text is empty and holds the end id only; null document ids come first and are read as
null; repeated ids keep all their rows, in the order of a hash of their texts and then of the texts,
and may go on in the next file; an empty table writes no file and reads as no rows; a text of any
length is one document of one segment; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import bpe
from factloom.llm.shared import by_bytes, filesystem, write_atomically

MAGIC = b"DACTOK01"
SEGMENT_BYTES = 4 << 20
#: Bytes of text of a file on a large input, and the least that a file is cut down to so that all cores have work.
FILE_BYTES, LEAST_FILE_BYTES = 256 << 20, 8 << 20
BLOCK_BITS = 512
_BLOCK_BYTES = BLOCK_BITS // 8
_SEGMENT = struct.Struct("<QQQQ")  # where it begins, its bytes, its documents, its ids
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def split_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bitmap, rank directory) of each level; the last level's bitmap is empty."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        chunks = (rest & 0xFF).astype(np.uint8)
        if not more.any():
            levels.append((chunks, np.zeros(0, np.uint8), np.zeros(0, "<u4")))
            return levels
        bits = np.packbits(more, bitorder="little")
        padded = np.pad(_POPCOUNT[bits], (0, -len(bits) % _BLOCK_BYTES)).reshape(-1, _BLOCK_BYTES)
        ranks = np.concatenate([[0], np.cumsum(padded.sum(axis=1, dtype=np.int64))[:-1]]).astype("<u4")
        levels.append((chunks, bits, ranks))
        rest = rest[more] >> 8


def join_levels(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """All ids of a segment."""
    above = levels[-1][0].astype(np.uint32)
    for chunks, bits, _ in reversed(levels[:-1]):
        here = chunks.astype(np.uint32)
        more = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
        here[more] |= above << 8
        above = here
    return above


def pick(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], at: int) -> int:
    """The id at one place: a chunk a level, found by the rank directories."""
    found = 0
    for depth, (chunks, bits, ranks) in enumerate(levels):
        found |= int(chunks[at]) << 8 * depth
        if not len(bits) or not bits[at >> 3] >> (at & 7) & 1:
            return found
        block = at // BLOCK_BITS
        whole = bits[block * _BLOCK_BYTES : at >> 3]
        at = int(ranks[block]) + int(_POPCOUNT[whole].sum(dtype=np.int64)) + int(_POPCOUNT[bits[at >> 3] & (1 << (at & 7)) - 1])
    return found


def pack_segment(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    levels = split_levels(ids)
    parts = [
        struct.pack("<QQQ", len(doc_ids), len(ids), len(levels)),
        doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
        doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
        counts.astype("<u8").tobytes(),
    ]
    for chunks, bits, ranks in levels:
        parts += [struct.pack("<QQQ", len(chunks), len(bits), len(ranks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(parts)


def unpack_segment(data: bytes) -> tuple[pa.Array, np.ndarray, list]:
    """(document ids, number of ids of each document, levels)."""
    n_docs, _, n_levels = struct.unpack_from("<QQQ", data)
    at = 24

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, n, at)
        at += found.nbytes
        return found

    known = take("u1", n_docs)
    doc_ids = pa.array(take("<i8", n_docs), pa.int64(), mask=known == 0)
    counts = take("<u8", n_docs).astype(np.int64)
    levels = []
    for _ in range(n_levels):
        sizes = struct.unpack_from("<QQQ", data, at)
        at += 24
        levels.append((take("u1", sizes[0]), take("u1", sizes[1]), take("<u4", sizes[2])))
    return doc_ids, counts, levels


class _Stored:
    """A part of a file as an array that is read element by element."""

    def __init__(self, file, begin: int, kind: str, n: int):
        self.file, self.begin, self.kind, self.n = file, begin, np.dtype(kind), n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at):
        first, last = (at.start or 0, at.stop) if isinstance(at, slice) else (at, at + 1)
        self.file.seek(self.begin + first * self.kind.itemsize)
        found = np.frombuffer(self.file.read((last - first) * self.kind.itemsize), self.kind)
        return found if isinstance(at, slice) else found[0]


class TokenFile:
    """A token file that is open for reading."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 16)
        n, magic = struct.unpack("<Q8s", self.file.read(16))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.file.seek(size - 16 - n * _SEGMENT.size)
        self.index = list(_SEGMENT.iter_unpack(self.file.read(n * _SEGMENT.size)))
        self.firsts = np.cumsum([0] + [x[3] for x in self.index])
        self.places: dict[int, list] = {}

    def __len__(self) -> int:
        return int(self.firsts[-1])

    def _levels(self, k: int) -> list[tuple[_Stored, _Stored, _Stored]]:
        """Where the levels of segment k stand; only their sizes are read."""
        if k not in self.places:
            at = self.index[k][0]
            self.file.seek(at)
            n_docs, _, n_levels = struct.unpack("<QQQ", self.file.read(24))
            at += 24 + 17 * n_docs
            levels = []
            for _ in range(n_levels):
                self.file.seek(at)
                sizes = struct.unpack("<QQQ", self.file.read(24))
                parts, at = [], at + 24
                for kind, n in zip(("u1", "u1", "<u4"), sizes, strict=True):
                    parts.append(_Stored(self.file, at, kind, n))
                    at += n * parts[-1].kind.itemsize
                levels.append(tuple(parts))
            self.places[k] = levels
        return self.places[k]

    def __getitem__(self, at: int) -> int:
        """The id at place ``at`` of the file: a chunk, up to 64 bytes of bitmap and a rank a level are read."""
        if not 0 <= at < len(self):
            raise IndexError(at)
        k = int(np.searchsorted(self.firsts, at, "right")) - 1
        return pick(self._levels(k), at - int(self.firsts[k]))

    def segments(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(document ids, number of ids of each, all ids) of each segment."""
        for begin, size, _, _ in self.index:
            self.file.seek(begin)
            doc_ids, counts, levels = unpack_segment(self.file.read(size))
            yield doc_ids, counts, join_levels(levels)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(document id, its ids) in the order of the file."""
        for doc_ids, counts, ids in self.segments():
            yield from zip(doc_ids.to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True)

    def close(self) -> None:
        self.file.close()


def _file_parts(segments: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]], totals: dict) -> Iterator[bytes]:
    index, at = [], len(MAGIC)
    yield MAGIC
    for doc_ids, counts, ids in segments:
        data = pack_segment(doc_ids, counts, ids)
        index.append((at, len(data), len(doc_ids), len(ids)))
        at += len(data)
        totals["docs"] += len(doc_ids)
        totals["ids"] += len(ids)
        yield data
    yield b"".join(_SEGMENT.pack(*x) for x in index) + struct.pack("<Q8s", len(index), MAGIC)


def files_for(df: DataFrame, text_col: str = "text") -> int:
    """How many files the texts fill: ``FILE_BYTES`` each, or less where cores would have no work."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // FILE_BYTES), min(4 * cores, -(-size // LEAST_FILE_BYTES)))


def write(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, files: int | None = None, slice_bytes: int = SEGMENT_BYTES) -> list[tuple[str, int, int]]:
    """Encode every text and write token files to ``folder``; [(file, documents, ids)] in order.

    What comes to the driver is one row a file.  A hot id is dealt out by the hash of its texts,
    and a hot text by its rows.
    """
    spark = df.sparkSession
    files = files or files_for(df, text_col)
    source = bpe.vocabulary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, totals = bpe.worker_bpe(bpe.LibraryBpe, source.value), {"docs": 0, "ids": 0}
        parts = by_bytes(batches, 1, slice_bytes)
        first = next(parts, None)
        if first is None:
            return

        def segments():
            part = first
            while part is not None:
                ids, at = coder.encode_all(part.column(1))
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                yield part.column(0).cast(pa.int64()), np.diff(at) + (end_id is not None), ids
                part = next(parts, None)

        place = TaskContext.get().partitionId()
        uri = f"{folder}/tokens-{place:06d}.dac"
        write_atomically(uri, _file_parts(segments(), totals))
        yield pa.RecordBatch.from_pydict({"place": [place], "file": [uri], "docs": [totals["docs"]], "ids": [totals["ids"]]})

    # Numbered, so that the copies of one row are dealt out too.
    order = [F.col("id"), F.xxhash64("text"), F.col("row")]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions("id", F.xxhash64("text"), "text", "row").drop("row")
    written = dealt.mapInArrow(run, "place long, file string, docs long, ids long").collect()
    return [(r["file"], r["docs"], r["ids"]) for r in sorted(written, key=lambda r: r["place"])]


def read(spark: SparkSession, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, ids) of every document in the files: ids are packed, start counts the ids before."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    if not manifest:
        return spark.createDataFrame([], schema)
    starts = np.cumsum([0] + [m[2] for m in manifest]).tolist()
    listed = spark.sparkContext.broadcast([(m[0], start) for m, start in zip(manifest, starts, strict=False)])  # one entry a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, start = listed.value[k]
                file = TokenFile(name)
                for doc_ids, counts, ids in file.segments():
                    at = np.concatenate([[0], np.cumsum(counts)])
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + at[:-1]), bpe.packed(ids, at)], names=["doc_id", "start", "ids"])
                    start += int(at[-1])
                file.close()

    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(run, schema)


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read`` returns."""
    return tokens.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
