"""Substring deduplication by relative Lempel-Ziv parsing.

A word goes if a window of WINDOW words that covers it also starts in a document with a smaller id; only factors of WINDOW words or
more can therefore matter, and that is the unit of the index.

1. Reference blocks. The windows of all documents are dealt by their hash; a block holds, for each window that two documents share,
   where it starts first: the smallest document, and the place there. Only windows that can occur twice are sent: each is represented
   by its smallest GRAM-word hash (equal windows share it), and only those whose representative occurs in two documents go on. That
   moves about 2 / (WINDOW - GRAM + 2) of the words.
2. Parsing. A document is factored from left to right: a factor starts where a window is in some block, in a smaller document, and is
   as long as the following words follow one another in that reference. At its end the parse goes back by up to WINDOW - 1 words: a
   window across the boundary may be in another reference and begins the next factor. Factors are (start, end, document, place).

The reference of a window is its smallest document, not the one with the longest match: that may split a factor in two that overlap,
which cover the same words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, fingerprint

WINDOW, GRAM = 50, 8
BATCH_BYTES = 4 << 20
FACTORS = "array<struct<start:long,end:long,doc_id:long,place:long>>"


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, about BATCH_BYTES at a time (a longer text alone), with the index of the first."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8")
        if held and size + len(raw) > BATCH_BYTES:
            yield first, held
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def _represented(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    return fingerprint.sliding_min(fingerprint.windows(hashes, gram), window - gram + 1)


def factors(at: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse: (start, end, document, place there) of each factor, in words. at: places of the windows that start in a smaller
    document, ascending; doc, place: where."""
    if not len(at):
        return []
    on = (np.diff(at) == 1) & (np.diff(place) == 1) & (doc[1:] == doc[:-1])  # the reference goes on as the document does
    first = np.flatnonzero(np.concatenate([[True], ~on]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return list(zip(at[first].tolist(), (at[last] + window).tolist(), doc[first].tolist(), place[first].tolist()))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, n_words, n_removed, kept, kept_sha256, factors), one row per row of docs; kept: the words left, joined by one
    space, where some were removed (null: the whole text stays); factors: what was removed and where it stands first (null: nothing).

    Null and empty texts have no words. A null id is neither smaller nor larger than another: such rows keep all. Rows of one id don't
    remove each other's words. Windows are judged on the input. Texts of any length are parsed whole, those beyond a few MB one at a
    time. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, texts in _chunks(b.column(1).to_pylist()):
                offsets, h = fingerprint.words(texts)
                ok, owner = fingerprint.inside(offsets, window, len(h))
                m, owner = _represented(h, window, gram)[ok], owner[ok]
                if len(m):
                    new = np.concatenate([[True], (m[1:] != m[:-1]) | (owner[1:] != owner[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(m[new].view(np.int64)), pa.array(ids[first + owner[new]].astype(np.int64))], names=["anchor", "doc_id"])

    seen = d.filter("doc_id is not null").mapInArrow(anchors, "anchor long, doc_id long")
    shared = seen.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    hits = common.cut(seen.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "anchors")
    repeated = common.cut(d.join(hits, "doc_id"), "repeated")
    common.discard(hits)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held = b.column(0).to_pylist(), b.column(2)
            for begin, texts in _chunks(b.column(1).to_pylist()):
                for i, text in enumerate(texts, begin):
                    _, h = fingerprint.words([text])
                    at = np.flatnonzero(np.isin(_represented(h, window, gram).view(np.int64), held[i].values.to_numpy()))
                    w, first = np.unique(fingerprint.windows(h, window)[at], return_index=True)
                    if len(w):
                        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), ids[i])), pa.array(at[first].astype(np.int32))], names=["w", "doc_id", "place"])

    def merged(run):
        """Small batches joined to larger ones."""

        def out(batches):
            held, n = [], 0
            for b in run(batches):
                held.append(b)
                n += b.num_rows
                if n >= 50_000:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, n = [], 0
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        return out

    entries = repeated.mapInArrow(merged(indexed), "w long, doc_id long, place int")
    blocks = entries.groupBy("w").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("most")).filter("first.doc_id < most").select("w", "first")
    found = entries.select("w", "doc_id").join(blocks, "w").filter("doc_id > first.doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("w", "first")).alias("found"))
    found = common.cut(found, "found")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, key, text, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                raw = (text or "").encode("utf-8")
                _, h = fingerprint.words([raw])
                w, first = (held.values.field(i) for i in range(2))
                w, doc, place = w.to_numpy(), first.field(0).to_numpy(), first.field(1).to_numpy()
                order = np.argsort(w)
                own = fingerprint.windows(h, window).view(np.int64)
                hit = order[np.minimum(np.searchsorted(w, own, sorter=order), len(w) - 1)]
                at = np.flatnonzero(w[hit] == own)
                parsed = factors(at, doc[hit[at]], place[hit[at]], window)
                if not parsed:
                    continue  # another text of the same id
                keep = np.ones(len(h), bool)
                for x, y, _, _ in parsed:
                    keep[x:y] = False
                kept = b" ".join([p for p, k in zip(raw.split(), keep.tolist()) if k])
                parsed = [dict(zip(("start", "end", "doc_id", "place"), f)) for f in parsed]
                out.append({"doc_id": doc_id, "key": key, "n_removed": len(h) - int(keep.sum()), "kept": kept.decode("utf-8"), "kept_sha256": hashlib.sha256(kept).hexdigest(), "factors": parsed})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("factors", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "doc_id", "place")])))])
    cleaned = repeated.select("doc_id", F.xxhash64("text").alias("key"), "text").join(found, "doc_id")
    cleaned = cleaned.mapInArrow(parse, f"doc_id long, key long, n_removed long, kept string, kept_sha256 string, factors {FACTORS}")
    cleaned = common.cut(cleaned.dropDuplicates(["doc_id", "key"]), "cleaned")
    common.discard(repeated, found)
    whole = F.sha2(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), common.BLANK, " ")), 256)
    out = d.select("doc_id", F.xxhash64("text").alias("key"), common.n_words(F.col("text")).alias("n_words"), whole.alias("__sha"))
    out = out.join(cleaned, ["doc_id", "key"], "left")
    return out.select("doc_id", "key", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "kept", F.coalesce("kept_sha256", "__sha").alias("kept_sha256"), "factors")
