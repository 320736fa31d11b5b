"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut into pretokens by the vocabulary's pattern.  The distinct pretokens of a slice that
are not yet known are laid out by length in padded matrices, one row each, one byte id per cell.
Each round, every row that still has a mergeable pair merges its leftmost pair of least rank and
all rows are compacted by one cell; ranks of pairs come from a hash table kept in two arrays, and
only the two pairs beside a merge are looked up again.  Rows without a mergeable pair leave the
matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, texts

#: Bytes of the pretokens that a task remembers, about; beyond it the memory starts anew.
CACHE_BYTES = 48 << 20
#: Bytes that a remembered pretoken takes beside its own letters and ids.
ENTRY_BYTES = 200
SLICE_BYTES = 1 << 20
#: Pretokens beyond this length are merged with a heap, where a matrix would take a round per merge.
LONGEST_ROW = 256
#: Cells of one matrix at most.
MATRIX_CELLS = 1 << 20
#: Texts are cut, where it surely is a boundary of pretokens, after about so many characters.
STRETCH = 1 << 20
NONE = np.int32(2**31 - 1)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PairTable:
    """Open-addressing hash table from a pair of ids to the id that they merge into."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(10, int(len(pairs) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, NONE, dtype=np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        values = np.array(list(pairs.values()), dtype=np.int32)
        slots = self.slots(keys)
        self.probes = 0
        while len(keys):  # each round places one key per free slot, the others step on
            self.probes += 1
            free = self.keys[slots] < 0
            _, first = np.unique(slots[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slots[placed]] = keys[placed]
            self.values[slots[placed]] = values[placed]
            rest = np.ones(len(keys), dtype=bool)
            rest[placed] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & (size - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, or NONE.  A negative id (padding) merges with nothing."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self.slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out.reshape(shape)


class ByteBPE:
    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.bytes_of = {i: token for token, i in self.ranks.items()}
        self.by_decimal = {str(i).encode(): token for i, token in self.bytes_of.items()}
        ranks = self.ranks
        self.single = np.array([ranks[bytes([k])] for k in range(256)], dtype=np.int32)
        pairs = {}
        for token, merged in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left, right] = merged
        self.pairs, self.table = pairs, PairTable(pairs)
        pattern = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
        self.split = regex.compile(pattern).findall
        self.boundary = regex.compile("[A-Za-z](?= [A-Za-z])").search
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.held = 0

    def merge_long(self, raw: bytes) -> list[int]:
        """Ids of one long pretoken: a heap of pairs over a linked list."""
        ids, pairs = [int(self.single[b]) for b in raw], self.pairs
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(pairs[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            n = after[k]
            if ids[k] != left or n >= len(ids) or ids[n] != right:
                continue
            ids[k], ids[n], after[k] = rank, -1, after[n]
            if after[n] < len(ids):
                before[after[n]] = k
            for at in (before[k], k):
                if at >= 0 and after[at] < len(ids) and (p := (ids[at], ids[after[at]])) in pairs:
                    heapq.heappush(heap, (pairs[p], at, *p))
        return [i for i in ids if i >= 0]

    def merge_matrix(self, raws: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of pretokens of at most ``width`` bytes, all merged together."""
        lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        flat = np.frombuffer(b"".join(raws), dtype=np.uint8)
        ids = np.full((len(raws), width), -1, dtype=np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.single[flat]
        ranks = self.table(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(raws))
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            ended = least == NONE
            if ended.any():
                for row, cells in zip(rows[ended].tolist(), ids[ended]):
                    yield row, cells[cells >= 0]
                going = ~ended
                rows, ids, ranks, at, least = rows[going], ids[going], ranks[going], at[going], least[going]
                if not len(rows):
                    return
            n, w = ids.shape
            every = np.arange(n)
            ids[every, at] = least
            keep = np.ones((n, w), dtype=bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), dtype=bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(n, w - 2)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.table(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < w - 2)
            ranks[right, at[right]] = self.table(ids[right, at[right]], ids[right, at[right] + 1])

    def learn(self, pretokens: Iterable[str]) -> None:
        """Work out the ids of pretokens; each is kept as its decimal ids, a space before each."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for pretoken in pretokens:
            raw = pretoken.encode()
            if len(raw) > LONGEST_ROW:
                self.known[pretoken] = "".join(f" {i}" for i in self.merge_long(raw)).encode()
            else:
                # widths 2, 4, 6, 8, 12, 16, 24, ...: little padding, few matrices
                width = 2
                while width < len(raw):
                    width += max(2, 1 << (width.bit_length() - 2))
                buckets.setdefault(width, []).append((pretoken, raw))
        for width, items in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for start in range(0, len(items), step):
                block = items[start : start + step]
                for row, ids in self.merge_matrix([raw for _, raw in block], width):
                    self.known[block[row][0]] = (" " + " ".join(map(str, ids.tolist()))).encode()

    def pretokens(self, text: str) -> list[str]:
        if len(text) <= 2 * STRETCH:
            return self.split(text)
        found, at = [], 0
        while at < len(text):
            cut = self.boundary(text, at + STRETCH)
            end = cut.end() if cut else len(text)
            found += self.split(text[at:end])
            at = end
        return found

    def encode(self, batch: list[str]) -> list[bytes]:
        """The decimal ids of each text, joined by one space."""
        cut = [self.pretokens(text) for text in batch]
        wanted = set().union(*cut)
        if self.held > CACHE_BYTES:
            self.forget()
        known = self.known
        new = wanted - known.keys()
        self.learn(new)
        self.held += sum(ENTRY_BYTES + len(pretoken) + len(known[pretoken]) for pretoken in new)
        return [b"".join(map(known.__getitem__, pretokens))[1:] for pretokens in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_decimal.__getitem__, ids.split(b" "))) if ids else b""


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(ranks_path, pattern)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: the id, ``n_tokens`` and the token ids (``ids``, an array of int).

    With ``digests`` the ids are decoded again, and ``ids_sha256`` (of the decimal ids joined by a
    space) and ``decoded_sha256`` (of the decoded bytes) stand in place of the ids.  A null or empty
    text has no tokens; repeated rows give repeated results.  A narrow pass: no shuffle.
    """
    source = texts(df, id_col, text_col)
    fields = [T.StructField(id_col, source.schema[0].dataType), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        bpe.forget()  # the tables serve the worker's next tasks, what a task remembers goes
        for part in slices(batches, 1, SLICE_BYTES):
            encoded = bpe.encode(part.column(1).to_pylist())
            columns = [part.column(0), pa.array([ids.count(b" ") + bool(ids) for ids in encoded], pa.int64())]
            if digests:
                columns.append(pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded]))
                columns.append(pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in encoded]))
            else:
                columns.append(pa.array([np.array(ids.split(), dtype=np.int32) for ids in encoded], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        bpe.forget()

    return source.mapInArrow(encode, T.StructType(fields))


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of each array of ids (``raw``, binary); null or empty ids give no bytes."""
    source = df.select(id_col, ids_col)
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType), T.StructField("raw", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = coder(ranks_path, pattern).bytes_of
        for batch in batches:
            raw = [b"".join(map(bytes_of.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "raw"])

    return source.mapInArrow(decode, schema)
