"""SimHash near-duplicates, found through the anchors of a covering code.

A 64-bit fingerprint is cut into two parts of 23 bits and one of 18.  The anchors of a 23-bit part
are the 4,096 words of the perfect Golay code, whose covering radius is 3; the 18-bit part takes all
its words as anchors (radius 0).  Two fingerprints that differ in at most ``limit`` bits differ in
at most t bits of some part, where the t of the parts add up to ``limit`` - 2.  So a fingerprint's
home is its nearest anchor, and it is copied to the nearest anchor of each word that lies within t bits
of its own.  These are anchors within radius + t, and enough of them: a partner's part is one of those
words, so its home is among the copies' anchors.  Each home compares its own fingerprints with the
copies, and every link is found.

Equal fingerprints are one node.  An anchor with many fingerprints is dealt out in blocks of at
most ``BLOCK``, and a block returns a spanning star a cluster, never all its pairs.

Cases: null and wordless texts have fingerprint zero and link like any other; repeated rows stay
rows of their own with one component; a null document id is never a component's name unless the
component has no other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.components import components
from factloom.llm.shared import by_bytes, only, saved, slices

SEED = 42
BLOCK = 4096
#: Linked fingerprints (16 bytes each) up to which a row a component is broadcast.
BROADCAST_ROWS = 1_000_000
PARTS = ((0, 23), (23, 23), (46, 18))
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    begins = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins, stops, strict=True)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, bits) of every row; bits is the fingerprint as a signed long."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("bits", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("simhash")
        for batch in by_bytes(batches, 1):
            bits = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=[id_col, "bits"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _remainders(first: int, width: int) -> np.ndarray:
    """The remainder by the generator polynomial of every word whose bits lie in [first, first + width)."""
    table = np.zeros(1, np.uint32)
    for bit in range(first, first + width):
        power = 1 << bit
        for at in range(22, 10, -1):
            if power >> at & 1:
                power ^= GOLAY << at - 11
        table = np.concatenate([table, table ^ np.uint32(power)])
    return table


class Covering:
    """The anchors of one part of the fingerprint."""

    def __init__(self, shift: int, width: int):
        self.shift, self.width = np.uint64(shift), width
        self.errors = None
        if width == 23:
            # The remainder of a sum is the sum of remainders: two small tables do for all words.
            self.low, self.high = _remainders(0, 12), _remainders(12, 11)
            self.errors = np.zeros(2048, np.uint32)
            for n in range(1, 4):
                for bits in combinations(range(23), n):
                    word = sum(1 << b for b in bits)
                    self.errors[self.remainder(np.uint32(word))] = word

    def remainder(self, part: np.ndarray) -> np.ndarray:
        return self.low[part & np.uint32(0xFFF)] ^ self.high[part >> np.uint32(12)]

    def part(self, bits: np.ndarray) -> np.ndarray:
        return (bits >> self.shift & np.uint64((1 << self.width) - 1)).astype(np.uint32)

    def nearest(self, part: np.ndarray) -> np.ndarray:
        return part if self.errors is None else part ^ self.errors[self.remainder(part)]

    def copies(self, bits: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, is it home): the nearest anchors of all words within ``extra`` bits, where a partner's home must be."""
        part, rows = self.part(bits), np.arange(len(bits))
        home = self.nearest(part)
        found = [rows.astype(np.uint64) << np.uint64(32) | home]
        for n in range(1, extra + 1):
            for flipped in combinations(range(self.width), n):
                near = self.nearest(part ^ np.uint32(sum(1 << b for b in flipped)))
                found.append(rows.astype(np.uint64) << np.uint64(32) | near)
        pairs = np.unique(np.concatenate(found))
        row, anchor = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return row, anchor, home[row] == anchor


def coverings() -> list[Covering]:
    """The parts' anchors, built once per worker."""
    held = only("simhash")
    if "coverings" not in held:
        held["coverings"] = [Covering(*p) for p in PARTS]
    return held["coverings"]


def shares(limit: int) -> list[int]:
    """How many differing bits each part must bear: they add up to ``limit`` - 2."""
    spare = max(0, limit - len(PARTS) + 1)
    return [spare // 3 + (i < spare % 3) for i in range(3)]


def _cluster(homes: np.ndarray, members: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A star for each cluster that the links from ``homes`` to ``members`` make."""
    values = np.unique(np.concatenate([homes, members]))
    label, place = np.arange(len(values)), np.searchsorted(values, members)
    linked = False
    for at in range(0, len(homes), 256):
        some = homes[at : at + 256]
        near = np.bitwise_count(some[:, None] ^ members[None, :]) <= limit
        near &= some[:, None] != members[None, :]
        for row in np.flatnonzero(near.any(axis=1)):
            linked = True
            names = np.unique(label[np.append(place[near[row]], np.searchsorted(values, some[row]))])
            if len(names) > 1:
                label[np.isin(label, names)] = names[0]
    if not linked:
        return []
    moved = np.flatnonzero(label != np.arange(len(values)))
    return list(zip(values[moved].view(np.int64).tolist(), values[label[moved]].view(np.int64).tolist(), strict=True))


def _pairs_of_small(groups: list[tuple[np.ndarray, np.ndarray]], limit: int) -> list[tuple[int, int]]:
    """The links of many small groups at once."""
    if not groups:
        return []
    counts = [(len(h), len(m)) for h, m in groups]
    left = np.concatenate([np.repeat(h, len(m)) for h, m in groups])
    right = np.concatenate([np.tile(m, n) for (_, m), (n, _) in zip(groups, counts, strict=True)])
    keep = (np.bitwise_count(left ^ right) <= limit) & (left != right)
    return list(zip(left[keep].view(np.int64).tolist(), right[keep].view(np.int64).tolist(), strict=True))


def _compare(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block (part, anchor, h, r): compares each block's homes with its members."""

    def finish(key: np.ndarray, home: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        small, edges = [], []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bits)], strict=True):
            if b - a < 3:
                if b - a < 2 or (bits[a:b] == bits[a]).all():
                    continue
            homes, members = bits[a:b][home[a:b]], bits[a:b][~home[a:b]]
            if not len(homes) or not len(members):
                continue
            if len(homes) * len(members) <= 256:
                small.append((homes, members))
            else:
                edges += _cluster(homes, members, limit)
        edges += _pairs_of_small(small, limit)
        if edges:
            a, b = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        held.append((key, batch.column(4).to_numpy(zero_copy_only=False).astype(bool), batch.column(5).to_numpy().view(np.uint64)))
        last = np.flatnonzero(np.any(key != key[-1], axis=1))
        if len(last):  # all but the batch's last block are whole
            cut = int(last[-1]) + 1
            whole = [*held[:-1], tuple(x[:cut] for x in held[-1])]
            yield from finish(*(np.concatenate([w[i] for w in whole]) for i in range(3)))
            held = [tuple(x[cut:] for x in held[-1])]
    if held:
        yield from finish(*(np.concatenate([w[i] for w in held]) for i in range(3)))


def links(nodes: DataFrame, limit: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within ``limit`` bits; ``nodes`` has distinct ``bits``."""
    extra = shares(limit)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            bits = batch.column(0).to_numpy().view(np.uint64)
            for part, covering in enumerate(coverings()):
                row, anchor, home = covering.copies(bits, extra[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), part, np.int32)), pa.array(anchor.astype(np.int32)), pa.array(home), pa.array(bits[row].view(np.int64))],
                    names=["part", "anchor", "home", "bits"],
                )

    copies = saved(nodes.select("bits").mapInArrow(deal, "part int, anchor int, home boolean, bits long"), "copies")
    # At most 2 * 4,096 + 262,144 rows, whatever the input: the anchors are fixed.
    sizes = copies.groupBy("part", "anchor").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("members"))
    large = sizes.where(F.col("members") > block).select("part", "anchor", F.ceil(F.col("homes") / block).cast("int").alias("hs"), F.ceil(F.col("members") / block).cast("int").alias("rs"))
    own = F.xxhash64("bits")
    dealt = (
        copies.join(F.broadcast(large), ["part", "anchor"], "left")
        .withColumn("hs", F.greatest(F.coalesce("hs", F.lit(1)), F.lit(1)))
        .withColumn("rs", F.coalesce("rs", F.lit(1)))
        .withColumn("role", F.explode(F.when(F.col("home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("role"), F.col("rs")).otherwise(F.col("hs")) - 1)))
        .select(
            "part",
            "anchor",
            F.when(F.col("role"), F.pmod(own, "hs")).otherwise(F.col("copy")).cast("int").alias("h"),
            F.when(F.col("role"), F.col("copy")).otherwise(F.pmod(own, "rs")).cast("int").alias("r"),
            "role",
            "bits",
        )
    )
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["part", "anchor", "h", "r"]
    return dealt.repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(lambda x: _compare(x, limit), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, limit: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of every row: component_id is the smallest id reachable over links."""
    marked = saved(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = saved(marked.groupBy("bits").agg(F.min(id_col).alias("least")), "nodes")
    named = components(links(nodes, limit)).withColumnRenamed("node", "bits")
    linked = saved(nodes.join(named, "bits"), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    # One row a component; a hot component's nodes stay where they are while the table is small.
    least = F.broadcast(least) if linked.count() <= BROADCAST_ROWS else least
    found = linked.join(least, "component").select("bits", "component_id")
    named = nodes.join(found, "bits", "left").select("bits", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(named, "bits").select(id_col, F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
