"""Token-ID output: files of independent zstandard frames with a trailing seek table and per-frame checksums.

Layout of a file (the public zstd seekable format, with an index in a skippable frame before the seek table)::

    frame*                      zstd frames; each holds whole documents: n u32, width u32, then n x (known u8), n x (doc_id i64),
                                n x (n_tokens u32), and all ids as little-endian u16 or u32 (width 2 or 4)
    index                       skippable frame 0x184D2A5D: for each frame first doc_id i64, last doc_id i64, n_docs u32, n_tokens u64
    seek table                  skippable frame 0x184D2A5E: for each frame compressed size u32, size u32, low 32 bits of XXH64 u32;
                                then number of frames u32, descriptor 0x80, magic 0x8F92EAB1

A reader fetches the tail, then only the frames whose range of ids holds the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

INDEX_MAGIC, SEEK_MAGIC, END_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
FRAME_TOKENS = 1 << 16
INDEX = struct.Struct("<qqIQ")

_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str):
    """(tokenizer, fast): fast if texts can be cut by pretoken and each slice encoded by the library's model alone."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        byte_level = t.pre_tokenizer is not None and repr(t.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        letters = np.zeros(256, "<u4")  # the code point that the model has for a byte
        letters[shown], letters[hidden] = shown, range(256, 256 + len(hidden))
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        _tokenizers[path] = t, byte_level and t.normalizer is None, letters, special, {}
    return _tokenizers[path]


def encode_texts(texts: list[str], path: str, end_id: int | None, width: int) -> list[bytes]:
    """Ids of each text by the tokenizers library, end_id after each, as little-endian integers of `width` bytes."""
    t, fast, letters, special, cache = _tokenizer(path)
    kind = f"<u{width}"
    end = b"" if end_id is None else np.array([end_id], kind).tobytes()
    if not fast:
        return [np.array(e.ids, kind).tobytes() + end for x in texts for e in t.encode_batch([x], add_special_tokens=False)]
    model = t.model

    def new(pieces: list[bytes]) -> list[bytes]:
        shown = letters[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
        ids, ends, at, tokens_of = [], [], 0, model.tokenize
        for n in map(len, pieces):
            ids += [y.id for y in tokens_of(shown[at : at + n])]
            ends.append(len(ids) * width)
            at += n
        raw = np.array(ids, kind).tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    odd = {i for i, x in enumerate(texts) if any(s in x for s in special)}  # the library treats these strings in its own way
    out = [c + end for c in bpe.encode_pieces(["" if i in odd else x for i, x in enumerate(texts)], cache, new)]
    for i in odd:
        out[i] = np.array(t.encode(texts[i], add_special_tokens=False).ids, kind).tobytes() + end
    return out


def tokenize(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, width: int = 2) -> DataFrame:
    """(doc_id, codes): the ids of each text as binary, a row for each row of docs, equal ones too. Null text: empty. Texts of any length
    are encoded whole. An empty table stays empty. Other columns are ignored, whatever their names. width: bytes of an id (2 for
    vocabularies under 65,536)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, "text"):
                codes = encode_texts([x or "" for x in b.column(1).to_pylist()], tokenizer_path, end_id, width)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=["doc_id", "codes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, codes binary")


class Writer:
    """Writes documents to one file; done() gives what the manifest holds of it."""

    def __init__(self, fs, path: str, width: int):
        self.out, self.path, self.width = fs.open_output_stream(path, compression=None), path, width
        self.seek, self.index, self.held, self.tokens = [], [], [], 0
        self.docs = self.all_tokens = 0

    def add(self, doc_id: int | None, codes: bytes) -> None:
        self.held.append((doc_id, codes))
        self.tokens += len(codes) // self.width
        if self.tokens >= FRAME_TOKENS:
            self._frame()

    def _frame(self) -> None:
        ids = [d for d, _ in self.held]
        counts = [len(c) // self.width for _, c in self.held]
        raw = b"".join([
            struct.pack("<II", len(ids), self.width),
            np.array([d is not None for d in ids], np.uint8).tobytes(),
            np.array([d or 0 for d in ids], "<i8").tobytes(),
            np.array(counts, "<u4").tobytes(),
            *[c for _, c in self.held],
        ])
        packed = zstandard.ZstdCompressor(level=3).compress(raw)
        self.out.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        known = [d for d in ids if d is not None] or [0]
        self.index.append((min(known), max(known), len(ids), sum(counts)))
        self.docs += len(ids)
        self.all_tokens += sum(counts)
        self.held, self.tokens = [], 0

    def done(self) -> tuple[int, int, int]:
        if self.held:
            self._frame()
        index = b"".join(INDEX.pack(*x) for x in self.index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, END_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.out.close()
        return len(self.seek), self.docs, self.all_tokens


class Reader:
    """Random access to one file: frames by number, documents by id."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != END_MAGIC or flags != 0x80:
            raise ValueError(f"{uri}: no seek table")
        low = size - 9 - 12 * frames - 8
        self.seek = [struct.unpack_from("<III", t, 12 * i) for t in [self.file.read_at(12 * frames, low + 8)] for i in range(frames)]
        self.index = [INDEX.unpack_from(t, INDEX.size * i) for t in [self.file.read_at(INDEX.size * frames, low - INDEX.size * frames)] for i in range(frames)]
        self.offsets = np.concatenate([[0], np.cumsum([x[0] for x in self.seek])]).astype(int).tolist()

    def frame(self, i: int) -> list[tuple[int | None, np.ndarray]]:
        """The documents of a frame; raises if its checksum fails."""
        packed, size, check = self.seek[i]
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(self.file.read_at(packed, self.offsets[i]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i}: checksum does not match")
        n, width = struct.unpack_from("<II", raw)
        known = np.frombuffer(raw, np.uint8, n, 8)
        ids = np.frombuffer(raw, "<i8", n, 8 + n).tolist()
        ends = np.cumsum(np.frombuffer(raw, "<u4", n, 8 + 9 * n).astype(np.int64))
        codes = np.frombuffer(raw, f"<u{width}", offset=8 + 13 * n)
        return [(d if k else None, codes[a:b]) for k, d, a, b in zip(known.tolist(), ids, [0, *ends[:-1].tolist()], ends.tolist())]

    def documents(self, wanted: set[int]) -> dict[int, np.ndarray]:
        """The ids of the wanted documents, from the frames that can hold them."""
        out = {}
        for i, (low, high, _, _) in enumerate(self.index):
            if any(low <= w <= high for w in wanted):
                out |= {d: c for d, c in self.frame(i) if d in wanted}
        return out


MANIFEST = "part int, file string, n_frames int, n_docs long, n_tokens long"


def write(tokens: DataFrame, uri: str, *, width: int = 2) -> DataFrame:
    """Writes (doc_id, codes) to files under uri in ascending doc_id order (null first; equal ids by their codes) and returns the manifest.

    A task writes a file of its own name, and only files of tasks that ended are in the manifest, so lost or repeated tasks leave
    no trace in what is read. An empty table gives an empty manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(uri)
        part, writer = TaskContext.get().partitionId(), None
        for b in batches:
            for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if writer is None:
                    fs.create_dir(path, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
                    writer = Writer(fs, f"{path}/{name}", width)
                writer.add(d, c)
        if writer is not None:
            frames, docs, n = writer.done()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{uri}/{name}"], "n_frames": pa.array([frames], pa.int32()), "n_docs": [docs], "n_tokens": [n]})

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "codes")
    return common.cut(ordered.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, codes) of all documents of a manifest; start: ids of all documents before it. codes: little-endian u32.

    Null and repeated ids are read as they were written, an empty manifest gives no rows; a file is read frame by frame, however long.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over files, not documents
    files = manifest.select("file", "n_frames", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = Reader(file)
                for i in range(len(r.seek)):
                    rows = r.frame(i)
                    n = np.array([len(c) for _, c in rows], np.int64)
                    start = base + np.cumsum(n) - n
                    base += int(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(start), pa.array(n), pa.array([c.astype("<u4").tobytes() for _, c in rows], pa.binary())], names=["doc_id", "start", "n_tokens", "codes"])

    n = max(1, manifest.count())
    return files.select("file", "base").repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, codes binary")


def crc32(codes: bytes) -> int:
    return zlib.crc32(codes)


def new_folder(spark: SparkSession) -> str:
    uri = common.new_path(spark, "tokens")
    return uri if "://" in uri else f"file://{uri}"
