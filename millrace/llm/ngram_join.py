"""N-gram Jaccard join by prefix trees.

1. Documents with equal shingle sets are one class.
2. Candidates, exactly: sizes fall into bands, so that linked sets lie in one band or in two that adjoin. In a band, linked sets
   differ in at most D shingles; the hash space is cut into more than D ranges, so linked sets agree in a whole range at least, and
   two sets that agree in a range of several shingles are seldom strangers. Every set sends one signature a range (about 0.5 of its
   shingles at 85 %), for its own band and the next. There are more ranges than D by a margin, so a linked pair meets in T at least.
   All signatures have one order, those of few shingles first, of these the most frequent: each set leaves out its first T - 1 that
   meet any. What a pair shares is in the same order for both, so a linked pair keeps the last that it shares; sets that meet too few
   are out. Strangers meet in signatures of one or two shingles that many have; without these the blocks (components of the rest)
   don't grow together as the table grows. Signatures that are left and meet are edges.
3. In a block the sets are globally ordered (the most frequent shingle first, so that paths are shared) and stored in a trie. A set
   is looked up by one traversal that carries the overlap of the shared path; a subtree is left as soon as the overlap so far plus
   what can remain of either side misses the bound, and taken whole as soon as the overlap is enough for its largest set. What
   leaves a block are link counts, weighted by the rows of a class, and a spanning forest, never its pairs.
4. Blocks over BLOCK_TOKENS are dealt into tiles by band and hash. A tile meets the tiles of its band and of the next, each two once;
   no block is cut off, none is held whole. Counting every link of one block grows with its square, whatever the layout.

Texts are read three times, and those of candidates (found by a bitmap of fixed size, then by a join) shuffled once; no table of
shingles is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, fingerprint, graph
from .substring import _chunks

#: Shingles that one task's trie holds at most, but for a single longer set.
BLOCK_TOKENS = 200_000
#: Signatures gathered in a worker before they are sent, at 10 bytes each.
SEND = 1_000_000
#: Rows that a worker gets at a time: texts, sets, or signatures sent together. More of them only take memory, here and in the JVM.
BATCH_ROWS = 500
#: Candidate edges name a class by so many bits of its digest: equal ones join blocks, which loses nothing.
NODE = (1 << 40) - 1
RECORD = 11
#: Ranges beyond the most differences, as a share of these: what a linked set must meet at least, but for its empty ranges.
MARGIN = 0.15
#: What seven bits of a mark say: so many common signatures at least. Steps of 8 % from 64 on.
AT_LEAST = np.array([*range(64), *[int(64 * 1.08**i) for i in range(64)]], np.int64)
#: Bits of the map of candidates' rows, and of one of its pieces (as Spark's bitmap functions make them).
BITS, PIECE_BITS = 1 << 24, 1 << 15


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text (A-Z as a-z); the whole sequence if it is shorter; none without words."""
    offsets, h = fingerprint.words([t.translate(fingerprint.LOWER) for t in texts])
    w = fingerprint.windows(h, k)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(w[a : b - k + 1]))
        else:
            out.append(fingerprint.windows(h[a:b], b - a) if b > a else h[:0])
    return out


def digest(tokens: np.ndarray) -> int:
    """64 bits of a set of hashes."""
    return int(fingerprint.mix(fingerprint.mix(tokens).sum(dtype=np.uint64)[None] + np.uint64(len(tokens))).view(np.int64)[0])


class Bands:
    """Bands of sizes, by percent: first size, most differences of a linked pair whose larger set is in the band, ranges, and how many
    of these agree at least."""

    def __init__(self, percent: int):
        self.percent, low, rows = percent, 1, []
        while low < 1 << 40:
            high = low * 100 // percent
            d = 2 * high * (100 - percent) // (100 + percent)
            agree = 2 + math.ceil((MARGIN + 2 * math.exp(-percent * low / 100 / d / (1 + MARGIN))) * d) if d else 0  # some ranges are empty
            rows.append((low, d + agree, agree))
            low = high + 1
        self.low, self.ranges, self.agree = (np.array(x, np.int64) for x in zip(*rows))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, mark): linked sets have some in common. mark says for which band (own: 0, next: 128) a signature is, plus the
    place in AT_LEAST of how many signatures of that mark the set has in common with any that it links with there, at least. The two
    top bits of a signature say of how many shingles it is (1, 2, 3, more). Where a difference is impossible, there are none: such sets
    link if equal only."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    begin = np.cumsum(n) - n
    mixed, own = fingerprint.mix(flat), np.repeat(np.arange(len(sets)), n)
    owners, found, marks = [], [], []
    for step in (0, 1):
        g = bands.of(np.maximum(n, 1)) + step
        m = np.where(n > 0, bands.ranges[g], 0)
        at = np.flatnonzero(np.repeat(m > 0, n))
        if not len(at):
            continue
        o = own[at]
        r = ((flat[at] >> np.uint64(32)) * m[o].astype(np.uint64)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (r[1:] != r[:-1])]))
        kind = np.minimum(np.diff(np.append(first, len(o))), 4) - 1
        sums, o, r = np.add.reduceat(mixed[at], first), o[first], r[first]
        label = fingerprint.mix(r + (g[o].astype(np.uint64) << np.uint64(40)) + np.uint64(1))
        owners.append(o)
        found.append(fingerprint.mix(sums + label) >> np.uint64(2) | kind.astype(np.uint64) << np.uint64(62))
        empty = m - np.bincount(o, minlength=len(sets))
        mark = 128 * step + np.searchsorted(AT_LEAST, np.maximum(bands.agree[g] - empty, 1), "right") - 1
        marks.append(mark[o])
        for i in np.flatnonzero((m > 0) & (empty >= bands.agree[g])).tolist():
            # Linked sets may agree in empty ranges only. Both then are here and share a shingle of these first ones in hash order.
            some = sets[i][: n[i] - -(-n[i] * bands.percent // 100) + 1]
            owners.append(np.full(len(some), i))
            marks.append(np.full(len(some), mark[i]))
            found.append(fingerprint.mix(some ^ np.uint64(g[i] + 3)) >> np.uint64(2))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(found), np.concatenate(marks)


def _pack(nodes: np.ndarray, sigs: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """(len, RECORD) bytes: 40 bits of node and signature, 8 of the mark."""
    out = np.empty((len(nodes), RECORD), np.uint8)
    out[:, :5] = nodes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 5:10] = sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 10] = marks
    return out


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, RECORD)
    both = np.zeros((2, len(rows), 8), np.uint8)
    both[0, :, :5], both[1, :, :5] = rows[:, :5], rows[:, 5:10]
    return both[0].view("<i8")[:, 0], both[1].view("<i8")[:, 0], rows[:, 10].astype(np.int32)


def _met(nodes: np.ndarray, sigs: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The records, each once, whose signature another node has too, and how many nodes have it."""
    order = np.lexsort((nodes, sigs))
    nodes, sigs, marks = nodes[order], sigs[order], marks[order]
    new = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1])])
    nodes, sigs, marks = nodes[new], sigs[new], marks[new]
    first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    many = np.diff(np.append(first, len(sigs)))
    many = np.repeat(many, many)
    met = many > 1
    return nodes[met], sigs[met], marks[met], many[met]


class Trie:
    """Ordered sets as a compressed trie over their sorted sequence: a node is a range of sets and the part of the path it adds."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        n = len(sets)
        common_len = [0] * (n + 1)
        for i in range(1, n):
            a, b = sets[i - 1], sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common_len[i] = int(differ[0]) if len(differ) else m
        # nodes: low, high, from, to (path positions), children
        self.low, self.high, self.start, self.end, self.kids = [], [], [], [], []
        self.least, self.most, self.deepest = [], [], []
        todo = [(0, n, 0, -1)]
        while todo:
            low, high, depth, parent = todo.pop()
            upto = min(common_len[low + 1 : high]) if high - low > 1 else len(sets[low])
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.start.append(depth)
            self.end.append(upto)
            self.kids.append([])
            self.least.append(min(sizes[low:high]))
            self.most.append(max(sizes[low:high]))
            self.deepest.append(max(len(s) for s in sets[low:high]))
            if parent >= 0:
                self.kids[parent].append(node)
            if high - low > 1:
                at = low
                for i in range(low + 1, high + 1):
                    if i == high or common_len[i] == upto:
                        if not (i - at == 1 and len(sets[at]) == upto):  # a set that ends here stays with the node
                            todo.append((at, i, upto, node))
                        at = i
        self.same = [False] * len(self.low)


def ordered(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Sets of hashes as ascending ranks in their global order: frequent ones first, then by hash. Hashes of one set only are left out."""
    flat = np.concatenate(sets)
    tokens, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(tokens))
    flat, shared, out, a = rank[at], counts[at] > 1, [], 0
    for s in sets:
        b = a + len(s)
        out.append(np.sort(flat[a:b][shared[a:b]]))
        a = b
    return out


def count_block(sets: list[np.ndarray], sizes: list[int], weights: list[int], percent: int, first: list[bool] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spanning forest of the links of sets (global ranks, ascending; sizes count dropped members too), and for each set the weights of
    all it links with. first: only links between these sets and the others."""
    held = sorted((i for i in range(len(sets)) if first is None or not first[i]), key=lambda i: sets[i].astype(">i8").tobytes())
    looked = held if first is None else [i for i in range(len(sets)) if first[i]]
    parent, out, counts = list(range(len(sets))), [], np.zeros(len(sets), np.int64)
    if not held or not looked:
        return out, counts
    trie = Trie([sets[i] for i in held], [sizes[i] for i in held])
    ranks = np.unique(np.concatenate(sets))
    sets = [np.searchsorted(ranks, s) for s in sets]
    mask = np.zeros(len(ranks), bool)
    upto = np.concatenate([[0], np.cumsum([weights[i] for i in held])]).tolist()
    change = np.zeros(len(held) + 1, np.int64)  # of the counts from one held set to the next

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def need(a: int, b: int) -> int:
        return -(-percent * (a + b) // (100 + percent))

    def link(q: int, low: int, high: int, same: bool) -> None:
        counts[q] += upto[high] - upto[low]
        change[low] += weights[q]
        change[high] -= weights[q]
        for i in held[low : low + 1 if same else high]:
            if (a := find(i)) != (b := find(q)):
                out.append((q, i))
                parent[a] = b

    for k, q in enumerate(looked):
        after = k + 1 if first is None else 0  # the sets before it have looked it up
        own, n = sets[q], sizes[q]
        mask[own] = True
        stack = [(0, 0)]
        while stack:
            node, overlap = stack.pop()
            low, high = trie.low[node], trie.high[node]
            least, most = trie.least[node], trie.most[node]
            if high <= after or 100 * most < percent * n or 100 * n < percent * least:
                continue
            start, end = trie.start[node], trie.end[node]
            left = len(own)
            if end > start:
                path = sets[held[low]][start:end]
                overlap += int(np.count_nonzero(mask[path]))
                left -= int(np.searchsorted(own, path[-1], "right"))
            if overlap >= need(n, most):
                link(q, max(low, after), high, trie.same[node])
                trie.same[node] = trie.same[node] or low >= after
                continue
            if overlap + min(left, trie.deepest[node] - end) < need(n, max(least, -(-percent * n // 100))):
                continue
            # sets that end at this node come first in its range
            i = low
            while i < high and len(sets[held[i]]) == end:
                if i >= after and overlap >= need(n, sizes[held[i]]):
                    link(q, i, i + 1, True)
                i += 1
            stack.extend((x, overlap) for x in reversed(trie.kids[node]))
        mask[own] = False
    counts[held] += np.cumsum(change)[:-1]
    return out, counts


def likely(df: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The rows of df whose columns (long) are those of a row of wanted, by position, and few others: one in BITS / rows of wanted. What
    is broadcast is a bitmap of hashes, of 2 MB at most for any tables."""
    at = lambda names: F.pmod(F.xxhash64(*names), F.lit(BITS)).cast("int")
    bits = wanted.select(at(wanted.columns).alias("at")).groupBy(F.shiftright("at", 15).alias("piece")).agg(F.bitmap_construct_agg((F.col("at") % PIECE_BITS).cast("long")).alias("bits"))
    at_, piece, bits_ = common.fresh(df.columns, "at", "piece", "bits")
    found = df.withColumn(at_, at(columns)).join(F.broadcast(bits.toDF(piece, bits_)), F.shiftright(at_, 15) == F.col(piece))
    byte = F.conv(F.hex(F.substring(bits_, F.shiftright(F.col(at_) % PIECE_BITS, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return found.filter(F.getbit(byte, F.col(at_) % 8) == 1).select(*df.columns)


def similar(docs: DataFrame, *, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id, group_id, key), one row per row of docs; sets with a Jaccard similarity of percent / 100 or more link.

    n_links is the number of other rows that a row links with. Null texts and texts without words have empty sets and link with
    nothing. Texts of any length are taken whole; a worker holds one at a time beyond a few MB. A component's id is its smallest
    known doc_id. Rows with equal texts or ids are linked as rows; null ids are never smallest. An empty table gives an empty
    result. Other columns are ignored, whatever their names. group_id (null for empty sets) numbers the components; key is a hash of
    the row's text. Shingles, and whole sets, are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    bands = Bands(percent)
    few = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(BATCH_ROWS)}
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))

    # 1. Classes.
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d = [], []
            for _, texts in _chunks(b.column(1).to_pylist()):
                sets = shingle_sets(texts, k)
                n += [len(s) for s in sets]
                d += [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["doc_id", "key", "n", "cid"])

    with common.settings(spark, **few):
        rows = common.cut(keyed.mapInArrow(common.trimmed(digests), "doc_id long, key long, n long, cid long"), "rows")
    classes = rows.filter("n > 0").groupBy("cid").agg(F.max("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("r"), F.count("*").alias("weight"))
    classes = classes.select("cid", "n", "weight", F.col("r.doc_id").alias("rep"), F.col("r.key").alias("rep_key"), F.col("cid").bitwiseAND(F.lit(NODE)).alias("node"))
    classes = common.cut(classes, "classes")

    # 2. Candidates.
    buckets = 4 * common.parts(spark)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def send():
            records, to = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(to, kind="stable")
            records, ends = records[order], np.cumsum(np.bincount(to, minlength=buckets)).tolist()
            found = [(i, records[a:b].tobytes()) for i, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([r for _, r in found], pa.binary())], names=["bucket", "records"])

        for b in batches:
            for _, texts in _chunks(b.column(0).to_pylist()):
                sets = [s for s in shingle_sets(texts, k) if len(s)]
                ids = [digest(s) for s in sets]
                fresh = [i for i, d in enumerate(ids) if d not in seen and not seen.add(d)]  # copies within what is sent together
                ids, sets = np.array([ids[i] for i in fresh], np.int64), [sets[i] for i in fresh]
                o, s, m = signatures(sets, bands)
                held.append((_pack(ids[o] & NODE, s >> np.uint64(24), m), ((s & np.uint64(0xFFFFFF)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)))
                size += len(s)
                if size >= SEND:
                    yield send()
                    held, size, seen = [], 0, set()
        if size:
            yield send()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None

        def solve():
            node, sig, mark, many = _met(*_unpack(b"".join(held)))
            return pa.RecordBatch.from_arrays([pa.array(sig | bucket << 40), pa.array(node), pa.array(mark), pa.array(many, pa.int32())], names=["place", "node", "mark", "many"])

        for b in batches:
            for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i != bucket:
                    if held:
                        yield solve()
                    held, bucket = [], i
                held.append(r)
        if held:
            yield solve()

    dealt = keyed.select("text").mapInArrow(common.trimmed(sent), "bucket int, records binary").repartition("bucket").sortWithinPartitions("bucket")
    with common.settings(spark, **few):
        matches = common.cut(dealt.mapInArrow(common.trimmed(meet), "place long, node long, mark int, many int"), "matches")
    turn = F.row_number().over(Window.partitionBy("node", "mark").orderBy(F.shiftright("place", 38).bitwiseAND(F.lit(3)), F.desc("many"), "place"))
    enough = F.array(*[F.lit(int(x)) for x in AT_LEAST])[F.col("mark").bitwiseAND(F.lit(127))]
    kept = common.cut(matches.withColumn("turn", turn).filter(F.col("turn") >= enough).select("place", "node"), "kept")
    common.discard(matches)
    least = kept.groupBy("place").agg(F.min("node").alias("v"), F.max("node").alias("most")).filter("v < most").drop("most")
    least = common.cut(least, "least")  # so that what many sets have in common can be split where they meet its least
    edges = common.cut(kept.join(least, "place").filter("node > v").select(F.col("node").alias("u"), "v").distinct(), "candidates")
    common.discard(kept, least)
    blocks = graph.components(edges)
    blocks = blocks.unionByName(blocks.select(F.col("root").alias("node"), "root").distinct()).toDF("node", "block")
    low = F.array(*[F.lit(int(x)) for x in bands.low])
    band = F.aggregate(low, F.lit(-1), lambda a, x: a + (x <= F.col("n")).cast("int"))
    alive = common.cut(classes.join(blocks, "node").select("block", "cid", "n", "weight", "rep", "rep_key", band.alias("band")), "alive")
    common.discard(edges)

    # 4. Units of a block: (0, 0) if it is small, or else two tiles. A tile is (band, part); its number is band << 32 | part.
    size = alive.groupBy("block").agg(F.sum("n").alias("total"))
    per_band = alive.groupBy("block", "band").agg(F.ceil(2 * F.sum("n") / block_tokens).cast("int").alias("tiles"))
    size = size.join(per_band.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("band", "tiles"))).alias("tiles")), "block")  # one entry a band, about 100 at most
    size = common.cut(size, "sizes")  # so that a large block's rows can be split where they meet it
    placed = alive.join(size, "block")
    name = lambda g, i: F.shiftleft(g.cast("long"), 32) + i
    every = lambda g: F.transform(F.sequence(F.lit(1), F.coalesce(F.col("tiles")[g], F.lit(0))), lambda i: name(g, i))
    tile = F.when(F.col("total") > block_tokens, name(F.col("band"), F.pmod(F.xxhash64("cid"), F.col("tiles")[F.col("band")]).cast("int") + 1)).otherwise(F.lit(0).cast("long"))
    around = F.flatten(F.array(*[F.when(F.col("tiles")[F.col("band") + d].isNotNull(), every(F.col("band") + d)).otherwise(F.array().cast("array<bigint>")) for d in (-1, 0, 1)]))
    others = F.when(F.col("total") > block_tokens, around).otherwise(F.array(F.lit(0).cast("long")))
    placed = placed.select("block", "cid", "n", "weight", "rep", "rep_key", tile.alias("tile"), others.alias("others"))

    # 3. Links.
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest, cid = [i for i, x in enumerate(b.schema.names) if x != "text"], b.column(b.schema.names.index("cid")).to_pylist()
            for at, texts in _chunks(b.column(b.schema.names.index("text")).to_pylist()):
                sets = shingle_sets(texts, k)
                ok = [i for i, s in enumerate(sets) if digest(s) == cid[at + i]]
                cols = [b.column(i).slice(at, len(texts)).take(pa.array(ok, pa.int64())) for i in rest]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([sets[i].tobytes() for i in ok], pa.binary())], names=[*[b.schema.names[i] for i in rest], "tokens"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = {}, None

        def solve():
            units = list(held.items())
            sets = ordered([np.frombuffer(x[3], np.uint64) for _, x in units])
            apart = None if key[1] == key[2] else [x[2] == key[1] for _, x in units]
            found, n = count_block(sets, [x[0] for _, x in units], [x[1] for _, x in units], percent, apart)
            n = [(units[i][0], int(x)) for i, x in enumerate(n) if x]
            u, v = [units[a][0] for a, _ in found] + [c for c, _ in n], [units[b][0] for _, b in found] + [None] * len(n)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([None] * len(found) + [x for _, x in n], pa.int64())], names=["u", "v", "n_links"])

        for b in batches:
            for block, a, z, cid, n, weight, tile, tokens in zip(*[c.to_pylist() for c in b.columns]):
                if (block, a, z) != key:
                    if len(held) > 1:
                        yield solve()
                    held, key = {}, (block, a, z)
                held[cid] = (n, weight, tile, tokens)
        if len(held) > 1:
            yield solve()

    same = (F.col("key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    near = likely(keyed, alive.select("rep_key", "rep"), "key", "doc_id")
    texts = near.join(placed, same).select("block", "cid", "n", "weight", "tile", "others", "text")
    sets = texts.mapInArrow(common.trimmed(full), "block long, cid long, n long, weight long, tile long, others array<long>, tokens binary")
    units = sets.withColumn("other", F.explode("others")).select("block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("z"), "cid", "n", "weight", "tile", "tokens")
    units = units.repartition("block", "a", "z").sortWithinPartitions("block", "a", "z")
    with common.settings(spark, **few):
        found = common.cut(units.mapInArrow(common.trimmed(local), "u long, v long, n_links long"), "links")
    roots = graph.components(found.filter("v is not null").select("u", "v")).toDF("cid", "root")
    known = classes.select("cid", "weight", "rep").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    others = found.filter("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("n_links").alias("others"))
    known = known.join(least, "root").join(others, "cid", "left")
    known = known.select("cid", "root", "component_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.withColumn("cid", F.when(F.col("n") > 0, F.col("cid"))).join(known, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("root").alias("group_id"), "key")


def one_of_each(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of similar(): that of the smallest id (null last), of equal ids that of the smallest text hash.

    Rows without words are groups of their own and stay, as do null texts; an empty table stays empty. Texts of any length are taken
    whole. Of rows equal in id and text, one stays (any, if other columns differ). Columns may have any names.
    """
    found = similar(docs, k=k, percent=percent, id_col=id_col, text_col=text_col)
    best = found.filter("group_id is not null").groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("b"))
    best = common.cut(best.select(F.col("b.doc_id").alias("id"), F.col("b.key").alias("best")).distinct(), "best")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(~F.col(text_col).rlike(common.WORD), F.lit(True)).alias("bare"))
    stay = keyed.filter("not bare").join(best, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("best"))).dropDuplicates(["id", "best"]).select("row.*")
    return stay.unionByName(keyed.filter("bare").select("row.*"))
