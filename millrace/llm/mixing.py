"""Mixing sources to target weights by Pareto order sampling.

A source's target is spread over its documents by their length: a document of size class k = floor(log2(words)) should be taken
e = min(most, c * w) times, where w rises from 1/4 under 8 words to 1 from 256 words on (scraps are likelier to be left out), and the
source's c makes the expected words the target. floor(e) whole copies are certain, and the fraction that remains is the inclusion
probability p of one more copy: unequal within a source. Documents are ranked by their random odds divided by their inclusion odds,
q = (u / (1 - u)) / (p / (1 - p)), and the first of that order are taken until the words that the certain copies leave are reached. u
comes from the md5 of seed, id and text, so reruns agree, whatever the partitioning.

A source may hold most rows: no window or group holds a source. Texts are read twice: for their sizes, which are written, and for the
result. The place in the order where the target is reached is found by two histograms of BINS bins of q / (1 + q) for each source; only
the rows of one bin of the second, about one in BINS * BINS of a source, are ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BINS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> and target: shares by weight (by code point order of source, null last, repeating), each at most
    `most` times its size, the excess given to the others by weight until none is above. One row a source; an empty table gives none."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__k") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("__k", F.row_number().over(by_name) - 1).withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("__cap") / F.col("__w"), "__k")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({
        "__left": F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
        "__open": F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
    })
    level = F.col("__left") / F.col("__open")
    t = t.withColumn("__level", F.when(level * F.col("__w") <= F.col("__cap"), level))
    t = t.withColumn("__level", F.first("__level", ignorenulls=True).over(everything))
    return t.select("source", "source_size", F.coalesce(F.least(F.col("__cap"), F.col("__level") * F.col("__w")), F.col("__cap")).alias("target"))


def _uniform(seed: str, key: Column, text: Column) -> Column:
    """52 bits of md5(seed:key:text), in (0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _class(size: Column) -> Column:
    """floor(log2(size)), by its binary digits; 0 for nothing."""
    return (F.length(F.bin(size)) - 1).cast("int")


def _weight(k: Column) -> Column:
    return F.least(F.greatest(k, F.lit(2)), F.lit(8)) / F.lit(8.0)


def copies_by_class(classes: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """(source, class, words) and targets() -> and sure (certain copies), p (probability of one more) and goal (the source's words that the
    certain copies leave). About 40 rows a source."""
    t = classes.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    t = t.withColumn("w", _weight(F.col("class")))
    fill = Window.partitionBy("source").orderBy(F.col("w").desc(), F.col("class").desc())
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("words").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("words")).over(fill.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("c", F.try_divide(F.col("target") - full * F.lit(float(most)), rest))
    t = t.withColumn("c", F.first(F.when(F.col("c") * F.col("w") <= float(most), F.col("c")), ignorenulls=True).over(every))
    e = F.coalesce(F.least(F.col("c") * F.col("w"), F.lit(float(most))), F.lit(float(most)))
    t = t.withColumn("sure", F.floor(e)).withColumn("p", e - F.floor(e))
    t = t.withColumn("goal", F.col("target") - F.sum(F.col("sure") * F.col("words")).over(Window.partitionBy("source")))
    return t.select("source", "class", "words", "source_size", "target", "sure", "p", "goal")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with columns size, source_size, target (of the row's source) and copies (0 .. most) added.

    Null text or source: size 0, a source of its own; texts without words are never taken more than once and count nothing. Repeated
    rows count each for itself; those equal in id and text share one u and are told apart by nothing: any of them may be taken. Texts
    of any length are one document, taken whole or not. Columns of docs named like an added one are replaced (not so id, text and
    source: rename them before), others may have any names. Empty docs give an empty result. The words taken of a source are within
    half a document of its target.
    """
    out = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c not in out]
    of, k, u, at, fine, sure, p, goal, cut_at, cut_fine, done = common.fresh([*docs.columns, *out], "of", "class", "u", "at", "fine", "sure", "p", "goal", "cut_at", "cut_fine", "done")
    size = common.n_words(F.col(text_col))
    sizes = docs.select(F.col(source_col).alias("source"), size.alias("size"), _uniform(seed, F.col(id_col), F.col(text_col)).alias("u"))
    sizes = common.cut(sizes.withColumn("class", _class(F.col("size"))), "sizes")
    classes = common.cut(sizes.groupBy("source", "class").agg(F.sum("size").cast("long").alias("words")), "classes")
    plan = targets(classes.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")), weights, share, most)
    plan = common.cut(copies_by_class(classes, plan, most), "plan")
    rows = plan.count()

    def ranked(df: DataFrame, chance: Column, u: Column) -> tuple[Column, Column]:
        """The two bins of a row; null where no further copy is open."""
        q = (u / (1 - u)) / (chance / (1 - chance))
        x = F.when(chance > 0, F.least(q / (1 + q), F.lit(1 - 2.0**-52)) * BINS)
        return F.floor(x), F.floor((x - F.floor(x)) * BINS)

    open_ = sizes.join(common.small(plan.withColumnRenamed("source", "of").withColumnRenamed("class", "k"), rows), F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("k")))
    a, b = ranked(open_, F.col("p"), F.col("u"))
    open_ = open_.filter("p > 0").select("source", "size", "goal", a.alias("at"), b.alias("fine"))

    def reached(bins: DataFrame, name: str) -> DataFrame:
        """(source, goal, words, name, done): the last bin whose begin the goal reaches, and the words before it. BINS rows a source."""
        upto = Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("done", F.col("start") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
        best = bins.filter("done <= goal").groupBy("source").agg(F.max_by(F.struct(name, "done"), name).alias("best"))
        return best.select(F.col("source").alias("of"), F.col(f"best.{name}").alias(f"cut_{name}"), F.col("best.done").alias("done"))

    bins = open_.groupBy("source", "goal", "at").agg(F.sum("size").alias("words")).withColumn("start", F.lit(0).cast("long"))
    first = common.cut(reached(bins, "at"), "first")
    n = first.count()
    bins = open_.join(common.small(first, n), F.col("source").eqNullSafe(F.col("of")) & (F.col("at") == F.col("cut_at")))
    bins = bins.groupBy("source", "goal", F.col("done").alias("start"), "fine").agg(F.sum("size").alias("words"))
    second = reached(bins, "fine")
    cuts = first.select(F.col("of").alias("source"), "cut_at").join(second, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumnRenamed("source", "of")
    full = plan.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    renamed = {"source": of, "class": k, "sure": sure, "p": p, "goal": goal, "cut_at": cut_at, "cut_fine": cut_fine, "done": done}
    full = common.cut(full.drop("words"), "cuts").withColumnsRenamed(renamed)

    d = docs.select(*kept, size.alias("size"), _uniform(seed, F.col(id_col), F.col(text_col)).alias(u))
    d = d.join(common.small(full, rows), F.col(source_col).eqNullSafe(F.col(of)) & (_class(F.col("size")) == F.col(k)))
    a, b = ranked(d, F.col(p), F.col(u))
    d = d.withColumns({at: a, fine: b})
    before = F.coalesce((F.col(at) < F.col(cut_at)) | (F.col(at) == F.col(cut_at)) & (F.col(fine) < F.col(cut_fine)), F.lit(False))
    edge = F.coalesce((F.col(at) == F.col(cut_at)) & (F.col(fine) == F.col(cut_fine)), F.lit(False))
    far = d.filter(~edge).withColumn("copies", F.col(sure) + before.cast("long"))
    q = (F.col(u) / (1 - F.col(u))) / (F.col(p) / (1 - F.col(p)))
    order = Window.partitionBy(of).orderBy(q, "size").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.col(done) + F.coalesce(F.sum("size").over(order), F.lit(0))
    near = d.filter(edge).withColumn("copies", F.col(sure) + (passed + F.col("size") / 2 <= F.col(goal)).cast("long"))
    return far.select(*kept, *out).unionByName(near.select(*kept, *out))
