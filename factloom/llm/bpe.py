"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by joining vocabulary strings.

Texts are cut into the pre-tokenizer's words for a whole batch at once.  Each different word of the
batch is then encoded once: its symbols form a doubly linked list, every mergeable neighbour pair
waits in a heap under (rank, position), and an entry whose pair has changed meanwhile is stale and
skipped.  A worker remembers the words it has met, up to a bound in bytes.  Decoding concatenates
the vocabulary strings of a batch's ids.

Cases: null text encodes as the empty text (no ids); null ids decode to the empty text; ids outside
the vocabulary add nothing and broken UTF-8 becomes U+FFFD; a text of any length is taken whole (its
ids must fit a binary value, 2 GB); repeated rows give repeated rows; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm import codepoints
from factloom.llm.shared import SLICE_BYTES, by_bytes, gathered, only, text_bytes

#: Classes of characters by which the pre-tokenizer of byte-level vocabularies parts words.
_CLASSES = (r"\s", r"\p{L}", r"\p{N}")
_SPACE, _LETTER, _NUMBER = 0, 1, 2
#: Endings that it cuts off behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Bytes of words and ids that one worker remembers, in two generations of half of them.
REMEMBERED = 64 << 20
#: What a remembered word takes beyond its own bytes and those of its ids, and the longest that is remembered.
_OVERHEAD, _LONGEST = 160, 48
_ID_BITS, _AT_BITS = 20, 36
_ID_MASK, _AT_MASK = (1 << _ID_BITS) - 1, (1 << _AT_BITS) - 1


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain}
    rest = (b for b in range(256) if chr(b) not in shown)
    return shown | {chr(256 + i): b for i, b in enumerate(list(rest))}


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


@cache
def character_classes() -> np.ndarray:
    """The pre-tokenizer's class of every code point; letters and digits younger than the library's tables are marks to it."""
    from tokenizers import pre_tokenizers

    known = codepoints.table(_CLASSES).copy()
    parted = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    young = [c for c in np.flatnonzero((known == _LETTER) | (known == _NUMBER)).tolist() if unicodedata.category(chr(c)) == "Cn"]
    # Behind one of its kind such a character makes no word of its own.
    asked = "".join(f"{'a' if known[c] == _LETTER else '1'}{chr(c)}\n\n" for c in young)
    begins = {span[0] for _, span in parted(asked)}
    for i, c in enumerate(young):
        if 4 * i + 1 in begins:
            known[c] = len(_CLASSES)
    return known


def word_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a word of the pre-tokenizer begins at each byte; texts begin at ``begins``.

    A word is an apostrophe with one of ``ENDINGS``, or a run of letters, of digits or of other marks,
    each with the blank before it; else it is white space, which leaves its last character to what follows.
    """
    n = len(data)
    kind = codepoints.classes(data, character_classes())
    first = np.zeros(n + 1, bool)
    first[begins] = True
    change = kind[1:] != kind[:-1]
    start = first[:n].copy()
    start[1:] |= change
    last = np.flatnonzero((kind[:-1] == _SPACE) & change & ~first[1:n])
    at = last.copy()
    for _ in range(3):  # back to the lead byte
        at -= (data[at] & 0xC0) == 0x80
    start[at] = True
    start[last[data[last] == 0x20] + 1] = False
    mark = np.flatnonzero((data[:-1] == 0x27) & start[:-1] & (kind[1:] == _LETTER) & ~first[1:n])
    if len(mark):
        a, beyond = data[mark + 1], np.minimum(mark + 2, n - 1)
        b = np.where((mark + 2 < n) & ~first[beyond], data[beyond], 0)
        size = np.zeros(len(mark), np.int64)
        for ending in map(str.encode, ENDINGS):
            size[(a == ending[0]) & (len(ending) == 1 or b == ending[-1])] = len(ending)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        behind = mark + 1 + size
        start[behind[behind < n]] = True
    return start


class ByteBpe:
    """A byte-level BPE vocabulary read from the JSON file of the tokenizers library."""

    def __init__(self, source: bytes, remembered: int = REMEMBERED):
        spec = json.loads(source)
        before, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        as_byte = byte_symbols()
        vocab = model["vocab"]
        strings = {i: bytes(map(as_byte.__getitem__, token)) for token, i in vocab.items()}
        self.of_byte = [vocab[c] for c, _ in sorted(as_byte.items(), key=lambda x: x[1])]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[left] << _ID_BITS | vocab[right], rank << _ID_BITS | vocab[left + right])
        self.special: dict[bytes, bytes] = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"unsupported added token {token['content']!r}")
            self.special[token["content"].encode()] = np.array([token["id"]], "<u4").tobytes()
            strings[token["id"]] = token["content"].encode()
        self.special_pattern = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # All strings in one buffer; the place behind the last id is the empty string.
        size = max(strings) + 2
        self.string_sizes = np.array([len(strings.get(i, b"")) for i in range(size)], np.int64)
        self.string_begins = np.cumsum(self.string_sizes) - self.string_sizes
        self.strings = np.frombuffer(b"".join(strings.get(i, b"") for i in range(size)), np.uint8)
        self.limit, self.held = remembered // 2, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-tokenizer word."""
        merges, n = self.merges, len(word)
        symbols = [self.of_byte[b] for b in word]
        if n == 1:
            return symbols
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for at in range(n - 1):
            found = merges.get(symbols[at] << _ID_BITS | symbols[at + 1])
            if found is not None:
                queue.append(found << _AT_BITS | at)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            at, found = entry & _AT_MASK, entry >> _AT_BITS
            left, after = symbols[at], following[at]
            if left < 0 or after >= n or merges.get(left << _ID_BITS | symbols[after]) != found:
                continue  # stale: one of the two symbols is gone or has grown
            made = symbols[at] = found & _ID_MASK
            symbols[after] = -1
            after = following[at] = following[after]
            if after < n:
                previous[after] = at
                found = merges.get(made << _ID_BITS | symbols[after])
                if found is not None:
                    heappush(queue, found << _AT_BITS | at)
            before = previous[at]
            if before >= 0:
                found = merges.get(symbols[before] << _ID_BITS | made)
                if found is not None:
                    heappush(queue, found << _AT_BITS | before)
        return [s for s in symbols if s >= 0]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        return [packed_ids(self.merge(w)) for w in words]

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of different words, remembered ones first."""
        found = list(map(self.young.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        unknown = []
        for i in missing:
            known = self.old.get(words[i]) or self.special.get(words[i])
            if known is None:
                unknown.append(i)
            found[i] = known
        for i, made in zip(unknown, self.merge_all([words[i] for i in unknown]), strict=True):
            found[i] = made
        for i in missing:
            word = words[i]
            if len(word) <= _LONGEST:
                self.young[word] = found[i]
                self.held += len(word) + len(found[i]) + _OVERHEAD
                if self.held > self.limit:  # the younger half stays
                    self.old, self.young, self.held = self.young, {}, 0
        return found

    def _special_places(self, data: np.ndarray, begins: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens stand, each inside one text."""
        held = data.tobytes()
        if self.special_pattern is None or not any(s in held for s in self.special):
            return []
        found, at = [], 0
        while match := self.special_pattern.search(held, at):
            a, b = match.span()
            if np.searchsorted(begins, a, "right") == np.searchsorted(begins, b, "left"):
                found.append((a, b))
                at = b
            else:  # it runs over the end of a text
                at = a + 1
        return found

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of each text begin and, last, the end)."""
        data, at = text_bytes(texts)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        special = self._special_places(data, at[:-1])
        start = word_starts(data, np.unique(np.concatenate([at, np.array(special, np.int64).ravel()])) if special else at)
        for a, b in special:
            start[a + 1 : b] = False
        starts = np.flatnonzero(start)
        offsets = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = self.ids_of(words.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begins = np.cumsum(lengths) - lengths
        index = words.indices.to_numpy()
        ids, ends = gathered(np.frombuffer(b"".join(found), "<u4"), begins[index], lengths[index])
        return ids, ends[np.searchsorted(starts, at)]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of ids; those of each text begin at ``at``, whose last is the end."""
        known = np.minimum(ids, len(self.string_sizes) - 1)
        data, ends = gathered(self.strings, self.string_begins[known], self.string_sizes[known])
        cuts = ends[at]
        found = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        try:
            found.validate(full=True)
        except pa.ArrowInvalid:  # some text is broken
            held = data.tobytes()
            return pa.array([held[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())
        return found

    def decode(self, ids: bytes | None) -> str:
        """The text of packed ids."""
        numbers = np.frombuffer(ids or b"", "<u4")
        return self.decode_all(numbers, np.array([0, len(numbers)]))[0].as_py()


class LibraryBpe(ByteBpe):
    """The same ids with words merged by the tokenizers library."""

    def __init__(self, source: bytes, remembered: int = 2 * REMEMBERED):
        from tokenizers import Tokenizer

        super().__init__(source, remembered)
        self.model = Tokenizer.from_buffer(source).model
        self.shown = {b: c for c, b in byte_symbols().items()}

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        tokens, shown = self.model.tokenize, self.shown
        return [packed_ids([t.id for t in tokens(w.decode("latin-1").translate(shown))]) for w in words]


def worker_bpe(kind: type, source: bytes) -> ByteBpe:
    """This worker's vocabulary, built once per process."""
    held, key = only("bpe"), (kind.__name__, hash(source))
    if key not in held:
        held.clear()
        held[key] = kind(source)
    return held[key]


def vocabulary(spark, path: str):
    """The vocabulary file, read on the driver and broadcast; its size is fixed (some 2 MB)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def packed(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The ids of each text as a binary value of little-endian unsigned 32-bit integers."""
    if 4 * int(at[-1] - at[0]) >= 2**31:
        raise OverflowError("the ids of a batch do not fit into one binary array of 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * (at - at[0])).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids[at[0] : at[-1]], "<u4"))])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, n_tokens, ids[, decoded]) of every row: ids are packed little-endian 32-bit integers.

    ``decoded`` adds the text that the ids decode to.
    """
    source = vocabulary(df.sparkSession, path)
    id_type = df.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.StringType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(ByteBpe, source.value)
        for batch in by_bytes(batches, 1, slice_bytes):
            ids, at = bpe.encode_all(batch.column(1))
            columns = [batch.column(0), pa.array(np.diff(at)), packed(ids, at)]
            if decoded:
                columns.append(bpe.decode_all(ids, at))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of packed ids."""
    source = vocabulary(df.sparkSession, path)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(ByteBpe, source.value)
        for batch in batches:
            held = batch.column(1).fill_null(b"")
            for part in by_bytes([pa.RecordBatch.from_arrays([batch.column(0), held], names=["id", "ids"])], 1):
                data, at = text_bytes(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), bpe.decode_all(np.frombuffer(data.tobytes(), "<u4"), at >> 2)], names=[id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)
