"""Byte-level BPE encoding and decoding by rank files.

Texts are cut by pretoken (no regex); the slices are looked up in a bounded cache and the missing ones are merged together:
every row of a matrix is one slice, and each round merges the lowest-ranked pair of every row that has one.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common, pretoken

#: Slices that an encoder keeps, and bytes of them and their codes.
CACHE_PIECES, CACHE_BYTES = 400_000, 32 << 20
#: Slices longer than this are not kept.
LONGEST_KEPT = 256
#: Texts of so many characters are cut and encoded at a time.
CHUNK_CHARS = 1_000_000
MATRIX_BYTES = 48
#: Tokens decoded at a time.
RUN = 100_000
#: Rows decoded at a time.
DECODED_ROWS = 1_000
NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ranks of byte strings -> ids and back. The vocabulary must hold all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = np.array([len(b) for b in self.bytes_of], np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.keys = self.values = None  # built when first needed: a worker that only decodes does without
        self.cache: dict[bytes, bytes] = {}

    def _pairs(self) -> None:
        ranks, pairs = self.ranks, {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pairs (a, b); NONE if they don't merge. Ids under 0 are padding."""
        if self.keys is None:
            self._pairs()
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """One slice of any length, by a heap of pairs over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, ranks, of = len(ids), self.ranks, self.bytes_of
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(of[ids[i]] + of[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], k = r, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (x := ranks.get(of[r] + of[ids[k]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            h = before[i]
            if h >= 0 and (x := ranks.get(of[ids[h]] + of[r])) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32 bits) of each slice."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(p) > MATRIX_BYTES:
                out[i] = np.array(self.merge_long(p), "<i4").tobytes()
            else:
                by_width.setdefault(-(-len(p) // 4) * 4, []).append(i)
        for width, rows in by_width.items():
            for k in range(0, len(rows), 20_000):
                self._merge_matrix([pieces[i] for i in rows[k : k + 20_000]], rows[k : k + 20_000], width, out)
        return out

    def _merge_matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width)[None, :] < size[:, None], self.single[raw], -1)
        ranks, row = self.rank(ids[:, :-1], ids[:, 1:]), np.array(rows)
        while True:
            m = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            best = ranks[np.arange(len(ids)), m] if ranks.shape[1] else np.full(len(ids), NONE)
            if (over := best == NONE).any():
                flat = ids[over].astype("<i4")
                for i, x, n in zip(row[over].tolist(), flat, (flat >= 0).sum(1).tolist()):
                    out[i] = x[:n].tobytes()
                ids, ranks, row, m, best = ids[~over], ranks[~over], row[~over], m[~over], best[~over]
            if not len(ids):
                return
            every = np.arange(len(ids))
            ids[every, m] = best
            w = ids.shape[1]
            ids = np.take_along_axis(ids, np.arange(w - 1)[None, :] + (np.arange(w - 1)[None, :] > m[:, None]), 1)
            ranks = np.take_along_axis(ranks, np.arange(w - 2)[None, :] + (np.arange(w - 2)[None, :] >= m[:, None]), 1)
            if not ranks.shape[1]:
                continue
            has = m < w - 2
            ranks[every[has], m[has]] = self.rank(ids[every[has], m[has]], ids[every[has], m[has] + 1])
            has = m > 0
            ranks[every[has], m[has] - 1] = self.rank(ids[every[has], m[has] - 1], ids[every[has], m[has]])

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids (little-endian 32 bits) of each text."""
        return encode_pieces(texts, self.cache, self.merge)

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])

    def decode_at(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """As decode, RUN tokens at a time, each run put where the offsets say; offsets that aren't those of the ids raise."""
        if len(ids) != len(ends) or (np.diff(ends, prepend=0) != self.length[ids]).any():
            raise ValueError("offsets are not those of the ids")
        out, at = bytearray(int(ends[-1]) if len(ends) else 0), 0
        for k in range(0, len(ids), RUN):
            upto = int(ends[min(k + RUN, len(ids)) - 1])
            out[at:upto] = self.decode(ids[k : k + RUN].tolist())
            at = upto
        return bytes(out)


def encode_pieces(texts: list[str], cache: dict[bytes, bytes], encode_new: Callable[[list[bytes]], list[bytes]]) -> Iterator[bytes]:
    """For each text, the cached codes of its slices joined; encode_new gives those of slices that the cache lacks.

    Most slices are in the cache, so each is looked up once there. What a full cache held of these texts goes on to the next one.
    """
    at, size = 0, sum(map(len, cache))
    while at < len(texts):
        upto, chars = at, 0
        while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= CHUNK_CHARS):
            chars += len(texts[upto])
            upto += 1
        pieces, counts = pretoken.byte_pieces(texts[at:upto])
        codes = list(map(cache.get, pieces))
        missing = [i for i, c in enumerate(codes) if c is None] if None in codes else []
        new = list({pieces[i] for i in missing})
        if len(cache) + len(new) > CACHE_PIECES or size + sum(map(len, new)) > CACHE_BYTES:
            kept = {p: c for p, c in zip(pieces, codes) if c is not None}
            cache.clear()
            cache.update(kept)
            size = sum(map(len, cache))
        found = dict(zip(new, encode_new(new)))
        for i in missing:
            codes[i] = found[pieces[i]]
        short = {p: c for p, c in found.items() if len(p) <= LONGEST_KEPT}
        cache.update(short)
        size += sum(map(len, short))
        k = 0
        for n in counts.tolist():
            yield b"".join(codes[k : k + n])
            k += n
        at = upto


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(read_ranks(path))
    return _encoders[path]


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c for n, c in zip(batch.schema.names, batch.columns) if n != name] + [values], names=[n for n in batch.schema.names if n != name] + [name])


def _encoding(ranks_path: str, text_col: str, ids_col: str, offsets_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for whole in batches:
            for batch in common.slices(whole, text_col):
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                codes = list(enc.encode_batch(texts))
                offsets = np.zeros(len(codes) + 1, np.int32)
                np.cumsum([len(c) // 4 for c in codes], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(codes), "<i4")))
                ends = [np.cumsum(enc.length[np.frombuffer(c, "<i4")], dtype=np.int32) for c in codes]
                ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ends) if ends else np.zeros(0, np.int32)))
                yield _replaced(_replaced(batch, ids_col, ids), offsets_col, ends)
        enc.cache.clear()  # workers outlive their tasks

    return run


def _decoding(ranks_path: str, ids_col: str, offsets_col: str, out_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for whole in batches:
            for at in range(0, whole.num_rows, DECODED_ROWS):
                batch = whole.slice(at, DECODED_ROWS)
                col = batch.column(batch.schema.get_field_index(ids_col))
                ends = batch.column(batch.schema.get_field_index(offsets_col)) if offsets_col in batch.schema.names else [pa.scalar(None)] * len(col)
                out = [
                    enc.decode_at(v.values.to_numpy(), e.values.to_numpy()) if v.is_valid and e.is_valid else enc.decode(v.as_py() or [])
                    for v, e in zip(col, ends)
                ]
                yield _replaced(batch, out_col, pa.array(out, pa.binary()))

    return run


def _encoded_schema(docs: DataFrame, ids_col: str, offsets_col: str) -> T.StructType:
    return common.added(docs.schema, (ids_col, T.ArrayType(T.IntegerType())), (offsets_col, T.ArrayType(T.IntegerType())))


def encode(docs: DataFrame, ranks_path: str, *, text_col: str = "text", ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """docs with ids and offsets (array<int>) added: each text by the pattern and the ranks, without special tokens, and where each
    token ends in the text's bytes.

    Null text counts as empty and has no ids. Columns named like ids_col or offsets_col are replaced, others may have any names. Rows
    stand for themselves; ties, repeats and empty tables need no care. Texts of any length are encoded whole, those beyond a few MB
    one at a time.
    """
    return common.mapped(docs, _encoding(ranks_path, text_col, ids_col, offsets_col), _encoded_schema(docs, ids_col, offsets_col))


def decode(df: DataFrame, ranks_path: str, *, ids_col: str = "ids", offsets_col: str = "offsets", out_col: str = "decoded") -> DataFrame:
    """df with the bytes of its ids added (binary; null ids: empty), by their offsets if df has them (not null). Ids outside the
    vocabulary and offsets of other ids raise. A column named like out_col is replaced, others may have any names; rows stand for
    themselves, repeated ones too; an empty table stays empty. Tokens of a row are decoded RUN at a time.
    """
    return common.mapped(df, _decoding(ranks_path, ids_col, offsets_col, out_col), common.added(df.schema, (out_col, T.BinaryType())))


def encode_and_decode(docs: DataFrame, ranks_path: str, *, text_col: str = "text", ids_col: str = "ids", offsets_col: str = "offsets", out_col: str = "decoded") -> DataFrame:
    """What decode gives of what encode gives, by one worker a task: two mapInArrow in a row are two workers with an encoder each."""
    encoding, decoding = _encoding(ranks_path, text_col, ids_col, offsets_col), _decoding(ranks_path, ids_col, offsets_col, out_col)
    schema = common.added(_encoded_schema(docs, ids_col, offsets_col), (out_col, T.BinaryType()))
    return common.mapped(docs, lambda batches: decoding(encoding(batches)), schema)
