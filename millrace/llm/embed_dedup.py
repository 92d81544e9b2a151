"""Embedding near-duplicates: PCA-ordered tiled comparison.

Unit vectors are rotated to the principal axes of the corpus, which keeps every product. Within a group (label, length) they are
ordered along a grid of the first axes and cut into tiles of TILE vectors, STRIP tiles in a row being a strip. Two strips meet, and two
tiles of theirs are compared, only if their boxes on these axes are near enough for a pair to reach the threshold; a body is sent once
for each strip that its strip meets. In a comparison the leading axes are summed first; a pair is given up as soon as its partial
product plus the product of the two suffix norms stays under the threshold, and rows and columns without a pair left are dropped
before the next axes. Pairs within CLOSE of the threshold are decided on the input vectors, in exact arithmetic. Equal vectors are one
vector with a weight. A comparison yields link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

#: Vectors in a tile (fewer if they are long: at most TILE_NUMBERS components), tiles in a strip, axes of the grid.
TILE, TILE_NUMBERS, STRIP, AXES = 1024, 1 << 20, 8, 4
#: Products this near to the threshold are decided exactly; roundings of unit vectors, rotation and sums are far smaller.
CLOSE = 1e-9
SLACK = 1e-12


def find(parent: np.ndarray | list, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def reaches(x: list[float], y: list[float], threshold: float) -> bool:
    """Whether the cosine of x and y is threshold or more, exactly."""
    x, y, t = [Fraction(v) for v in x], [Fraction(v) for v in y], Fraction(threshold)
    dot = sum(p * q for p, q in zip(x, y))
    bound = t * t * sum(p * p for p in x) * sum(q * q for q in y)
    return dot * dot >= bound if t > 0 and dot > 0 else t <= 0 and (dot >= 0 or dot * dot <= bound)


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, inputs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b (rotated unit vectors of the inputs) with a cosine of at least threshold; for a tile with itself, each pair once."""
    d = a.shape[1]
    steps = sorted({min(d, x) for x in (8, 16, 32, d)})
    suffix = [np.sqrt(np.maximum(0, (x[:, ::-1] ** 2).cumsum(1)[:, ::-1])) for x in (a, b)]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    part, at = np.zeros((len(a), len(b))), 0
    for upto in steps:
        part += a[rows, at:upto] @ b[cols, at:upto].T
        at = upto
        if at == d:
            break
        alive = part + suffix[0][rows, at][:, None] * suffix[1][cols, at][None, :] >= threshold - SLACK
        r, c = alive.any(1), alive.any(0)
        rows, cols, part = rows[r], cols[c], part[np.ix_(r, c)]
        if not len(rows):
            return rows, cols
    i, j = np.nonzero(part >= threshold - CLOSE)
    value, i, j = part[i, j], rows[i], cols[j]
    keep = (i < j) if same else np.ones(len(i), bool)
    for k in np.flatnonzero(keep & (value < threshold + CLOSE)).tolist():
        keep[k] = reaches(inputs[0][i[k]].tolist(), inputs[1][j[k]].tolist(), threshold)
    return i[keep], j[keep]


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype("f8")
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(raw: list[bytes], kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) of the vectors in raw, by length."""
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(kind).itemsize
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, np.frombuffer(b"".join([raw[i] for i in at.tolist()]), kind).reshape(-1, d)


def _moments(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum of u u' of the unit vectors, by length."""
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _by_length(b.column(0).to_pylist(), kind):
                u = _units(x)
                sums[d] = sums.get(d, 0) + u.T @ u
        if sums:
            salt = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_pydict({"dim": pa.array(list(sums), pa.int32()), "salt": pa.array([salt] * len(sums), pa.int32()), "m": pa.array([m.tobytes() for m in sums.values()], pa.binary())})

    return run


def _added(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a group's matrices, one at a time."""
    total, first = 0, None
    for b in tables:
        first = b if first is None else first
        for m in b.column("m"):
            total = total + np.frombuffer(m.as_buffer())
    yield pa.RecordBatch.from_arrays([first.column("dim")[:1], first.column("salt")[:1], pa.array([total.tobytes()], pa.binary())], names=["dim", "salt", "m"])


def _apart(l: str, r: str) -> str:
    """SQL: squared distance of two boxes."""
    return " + ".join(f"power(greatest(0D, {l}.low[{i}] - {r}.high[{i}], {r}.low[{i}] - {l}.high[{i}]), 2)" for i in range(AXES))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tile: int = TILE, strip: int = STRIP) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors; vectors of one non-null label link at a cosine of threshold or more.

    Null, empty and zero vectors, and those with null, NaN or infinite components or a null label, link with nothing, as do vectors
    of different lengths. Repeated rows are vectors of their own and link with each other. A component's id is its smallest known
    vec_id; null ids are never smallest. An empty table gives an empty result. Other columns are ignored, whatever their names. Long
    vectors make smaller tiles. Matrices of length x length numbers are summed in executors; one a length is sent to the driver.
    """
    single = isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)
    kind, number = ("<f4", "float") if single else ("<f8", "double")
    x = F.col(vec_col).cast(f"array<{number}>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), x.alias("x"))
    fine = F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    plain = F.transform("x", lambda v: v + F.lit(0.0).cast(number))  # -0 as 0
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("x", F.when(F.col("fine"), plain))
    rows = common.cut(rows.withColumn("key", F.when(F.col("fine"), F.sha2(F.to_json(F.struct("label", "x")), 256))), "vectors")
    kinds = rows.filter("fine").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("x").alias("x"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for v in b.column(b.schema.get_field_index("x"))]
            names = [n for n in b.schema.names if n != "x"]
            size = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(raw, pa.binary()), pa.array([len(r) // size for r in raw], pa.int32())], names=[*names, "x", "dim"])

    kinds = kinds.withColumn("cid", F.monotonically_increasing_id())
    kinds = common.cut(kinds.mapInArrow(packed, "key string, least long, weight long, label string, cid long, x binary, dim int"), "kinds")

    matrix = "dim int, salt int, m binary"
    moments = kinds.select("x").mapInArrow(_moments(kind), matrix).groupBy("dim", "salt").applyInArrow(_added, matrix).groupBy("dim").applyInArrow(_added, matrix)
    axes = {r.dim: np.ascontiguousarray(np.linalg.eigh(np.frombuffer(bytes(r.m)).reshape(r.dim, r.dim))[1][:, ::-1]) for r in moments.collect()}  # one a length

    def rotated(x: np.ndarray) -> np.ndarray:
        return _units(x) @ axes[x.shape[1]]

    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + CLOSE

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cell of the grid (bits of the axes' coordinates in turn), first coordinate and coordinates of the box axes."""
        for b in batches:
            raw = b.column(b.schema.get_field_index("x")).to_pylist()
            cell, lead = np.zeros(len(raw), np.int64), np.zeros((len(raw), AXES))
            for d, at, x in _by_length(raw, kind):
                lead[at, : min(d, AXES)] = rotated(x)[:, :AXES]
            steps = np.clip((lead + 1) * (2 / reach), 0, 255).astype(np.int64)
            for bit in range(7, -1, -1):
                for i in range(AXES):
                    cell = cell << 1 | steps[:, i] >> bit & 1
            names = ["label", "dim", "cid", "weight", "x"]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names], pa.array(cell), pa.array(lead.tobytes()[i * 8 * AXES : (i + 1) * 8 * AXES] for i in range(len(raw)))], names=[*names, "cell", "lead"])

    placed = common.cut(kinds.select("label", "dim", "cid", "weight", "x").mapInArrow(place, "label string, dim int, cid long, weight long, x binary, cell long, lead binary"), "placed")

    def cut_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, part, n, in_strip = None, [], TaskContext.get().partitionId() << 32, 0, 0

        def tiles():
            nonlocal n, in_strip
            if held:
                n += 1
                in_strip += 1
                lead = np.frombuffer(b"".join([h[4] for h in held])).reshape(-1, AXES)
                yield pa.RecordBatch.from_pydict({
                    "label": [group[0]], "dim": pa.array([group[1]], pa.int32()), "strip": [part + first], "tile": [part + n], "low": [lead.min(0).tolist()], "high": [lead.max(0).tolist()],
                    "cids": pa.array([np.array([h[1] for h in held], "<i8").tobytes()], pa.binary()), "weights": pa.array([np.array([h[2] for h in held], "<i8").tobytes()], pa.binary()),
                    "x": pa.array([b"".join([h[3] for h in held])], pa.binary()),
                })
                held.clear()

        first = 1
        for b in batches:
            for label, dim, _, cid, weight, x, lead in zip(*[c.to_pylist() for c in b.columns]):
                if (label, dim) != group or len(held) >= max(1, min(tile, TILE_NUMBERS // dim)):
                    yield from tiles()
                    if (label, dim) != group or in_strip >= strip:
                        first, in_strip = n + 1, 0
                    group = (label, dim)
                held.append((None, cid, weight, x, lead))
        yield from tiles()

    order = ["label", "dim", "cell", "cid"]
    laid = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "weight", "x", "lead")
    body = "label string, dim int, strip long, tile long, low array<double>, high array<double>, cids binary, weights binary, x binary"
    tiles = common.cut(laid.mapInArrow(cut_tiles, body), "tiles")
    common.discard(placed)
    box = [F.array(*[f(F.col(c)[i]) for i in range(AXES)]).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    strips = common.cut(tiles.groupBy("label", "dim", "strip").agg(*box), "strips")
    near = F.expr(f"l.label = r.label AND l.dim = r.dim AND l.strip <= r.strip AND {_apart('l', 'r')} <= {reach * reach!r}D")
    pairs = strips.alias("l").join(strips.alias("r"), near).select(F.col("l.strip").alias("a"), F.col("r.strip").alias("z"))
    ends = pairs.select("a", "z", F.explode(F.array_distinct(F.array("a", "z"))).alias("strip"))
    met = tiles.drop("label").join(ends, "strip").select("a", "z", "strip", "tile", "dim", "low", "high", "cids", "weights", "x")
    met = met.repartition("a", "z").sortWithinPartitions("a", "z", "strip", "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(p: dict, q: dict):
            same = p is q
            if not same and (np.maximum(0, np.maximum(p["low"] - q["high"], q["low"] - p["high"])) ** 2).sum() > reach * reach:
                return
            i, j = linked_pairs(p["u"], q["u"], threshold, same, (p["x"], q["x"]))
            if not len(i):
                return
            na, nb = np.zeros(len(p["u"]), np.int64), np.zeros(len(q["u"]), np.int64)
            np.add.at(na, i, q["weights"][j])
            np.add.at(na if same else nb, j, p["weights"][i])
            shift = 0 if same else len(na)
            parent, us, vs = list(range(len(na) + len(nb))), [], []
            for a, b in zip(i.tolist(), (j + shift).tolist()):
                x, y = find(parent, a), find(parent, b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    us.append(a)
                    vs.append(b)
            ends = p["cids"] if same else np.concatenate([p["cids"], q["cids"]])
            ia, ib = np.flatnonzero(na), np.flatnonzero(nb)
            counted = [p["cids"][ia], q["cids"][ib]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*counted, ends[us]])),
                    pa.array([None] * (len(ia) + len(ib)) + ends[vs].tolist(), pa.int64()),
                    pa.array(np.concatenate([na[ia], nb[ib], np.zeros(len(us), np.int64)])),
                ],
                names=["cid", "other", "links"],
            )

        left, unit = [], None  # tiles of the unit's first strip: those of the second pass by, one at a time
        for b in batches:
            for a, z, s, _, dim, low, high, cids, weights, x in zip(*[c.to_pylist() for c in b.columns]):
                if (a, z) != unit:
                    left, unit = [], (a, z)
                x = np.frombuffer(x, kind).reshape(-1, dim)
                t = {"x": x, "u": rotated(x), "low": np.array(low), "high": np.array(high), "cids": np.frombuffer(cids, "<i8"), "weights": np.frombuffer(weights, "<i8")}
                if s == a:
                    left.append(t)
                if s == z:
                    for p in left:
                        yield from links(p, t)

    found = common.cut(met.mapInArrow(compare, "cid long, other long, links long"), "links")
    common.discard(tiles, strips)
    counts = found.filter("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    roots = graph.components(found.filter("other is not null").select(F.col("cid").alias("u"), F.col("other").alias("v")))
    kinds = kinds.select("key", "cid", "least", "weight").join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    kinds = common.cut(kinds.withColumn("root", F.coalesce("root", "cid")), "roots")
    ids = kinds.groupBy("root").agg(F.min("least").alias("component_id"))
    kinds = kinds.join(ids, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(kinds, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
