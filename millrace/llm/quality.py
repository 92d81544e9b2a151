"""Quality rules with risk-controlled thresholds, in SQL functions only.

Each rule compares one ratio of a document with a ladder of cutoffs; step g of all ladders together is one candidate filter, and the
steps run from lax to strict, so that what step g rejects is rejected by every later one. A document's own step is the first that
rejects it. On the labelled documents of good quality that pass the base rules, in each stratum (language), a step is proven if the
exact binomial test rejects "its risk of a false rejection exceeds RISK" at level ERROR / strata: Bonferroni over the strata, and
fixed-sequence testing along the steps, which needs no further correction as it stops at the first step that is not proven. One
test a step, not one a rule, keeps the power: 0 of 217 rejected proves a step at four strata, 3 of 500 too.

With probability 1 - ERROR, for all strata at once, at most RISK of the good documents that pass the base rules are rejected by the
cutoffs. The base rules are given and not part of that bound. A stratum with too few labels gets base rules only: see proven().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: rule: (numerator, denominator, direction, cutoffs from lax to strict)
RULES: dict[str, tuple[str, str, int, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "word_chars", 1, (0.4, 0.3, 0.2, 0.15, 0.1, 0.06, 0.04, 0.02)),
    "capitals": ("n_capitals", "word_chars", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35)),
    "marks": ("n_marks", "word_chars", 1, (0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25)),
    "dup_lines": ("n_dup_lines", "n_lines", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35)),
    "repeats": ("n_repeat_words", "n_words", 1, (0.2, 0.2, 0.2, 0.19, 0.18, 0.17, 0.16, 0.15)),
    "long_words": ("word_chars", "n_words", 1, (30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0)),
    "short_words": ("word_chars", "n_words", -1, (1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.25, 2.5)),
}
STEPS = 8
RISK, ERROR = 0.02, 0.05
MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with MEASURES (long) and base_failed added. Null text: none of each. Texts of any length are measured whole, as one row.
    Columns of docs named like an added one are replaced, others may have any names; rows stand for themselves."""
    w_, lines_, hashes_, sorted_ = common.fresh([*docs.columns, *MEASURES], "words", "lines", "hashes", "sorted")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn(w_, F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0)))
    d = d.withColumn(lines_, F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w = F.col(w_)
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    d = d.withColumn(hashes_, F.when(F.size(w) >= 5, window).otherwise(F.array().cast("array<bigint>")))
    h = F.col(hashes_)
    d = d.withColumn(sorted_, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col(sorted_)

    def again(j: Column) -> Column:
        x = F.get(s, j)["x"]
        return F.coalesce(x == F.get(s, j - 1)["x"], F.lit(False)) | F.coalesce(x == F.get(s, j + 1)["x"], F.lit(False))

    at = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), again), lambda j: F.get(s, j)["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    lines = F.col(lines_)
    counted = common.settled(d, {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_capitals": F.char_length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
        "n_marks": F.char_length(F.regexp_replace(text, r"[\p{L}\p{N}\x20\x09-\x0D]+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(s.isNotNull(), covered).otherwise(F.lit(0)).cast("long"),
    })
    counted = counted.drop(w_, lines_, hashes_, sorted_)
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def step() -> Column:
    """The first step that rejects a row; STEPS + 1 if none does."""
    out = []
    for top, low, sign, cutoffs in RULES.values():
        passes = F.lit(0)
        for x in cutoffs:
            beyond = (F.col(top) > F.col(low) * x) if sign > 0 else (F.col(top) < F.col(low) * x)
            passes = passes + (~beyond).cast("int")
        out.append(passes + 1)
    return F.least(*out)


def _log_factorial(n: Column) -> Column:
    """log n!, by Stirling's series; exact to 1e-12 beyond 20, a product below."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)])
    return F.when(n > 20, series).otherwise(F.get(table, F.least(n, F.lit(20)).cast("int")))


def log_tail(k: Column, n: Column, risk: float) -> Column:
    """log P(X <= k), X binomial (n, risk), for k up to the mean n * risk (0 beyond, where no test could reject).

    Summed from k down: below the mean the terms fall at least as fast as a normal tail, so 12 deviations hold all that doubles can.
    """
    odds = math.log((1 - risk) / risk)
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(risk) + (n - k) * math.log1p(-risk)
    terms = F.least(k, F.ceil(12 * F.sqrt(n * risk)) + 50)
    down = F.when(terms > 0, F.sequence(F.lit(0).cast("long"), terms - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        log = a["log"] + F.log((k - j) / (n - k + j + 1)) + odds
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    tail = first + F.aggregate(down, start, add, lambda a: F.log(a["sum"]))
    return F.when(k <= n * risk, tail).otherwise(F.lit(0.0))


def proven(rows: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR, *, id_col: str = "doc_id") -> DataFrame:
    """(stratum, n, step): the good labels of each stratum and its strictest proven step (0: none). rows: id, stratum and measured().

    labels (doc_id, quality): a document labelled more than once counts as its lowest quality; null labels and ids don't count. Rows of
    one id count each. A null stratum is one of its own. Without labels there are no rows.
    """
    good = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    seen = rows.filter("not base_failed").select(F.col(id_col).alias("doc_id"), F.col(stratum).alias("stratum"), step().alias("step")).join(good, "doc_id", "left_semi")
    seen = seen.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum((F.col("step") <= g).cast("long")).alias(f"k{g}") for g in range(1, STEPS + 1)])
    strata = seen.agg(F.count("*").alias("strata"))
    tested = seen.join(F.broadcast(strata))  # one row
    last, ok = F.lit(0), F.lit(True)
    for g in range(1, STEPS + 1):
        ok = ok & (log_tail(F.col(f"k{g}"), F.col("n"), risk) <= F.log(F.lit(error) / F.col("strata")))
        last = last + ok.cast("int")
    return tested.select("stratum", "n", last.alias("step"))


def judged(rows: DataFrame, steps: DataFrame, stratum: str = "lang") -> DataFrame:
    """rows with kept added: false if base_failed or rejected by the proven step of its stratum."""
    own, upto, names = *common.fresh([*rows.columns, "kept"], "stratum", "upto"), [c for c in rows.columns if c != "kept"]
    steps = common.small(steps.select(F.col("stratum").alias(own), F.col("step").alias(upto)))
    d = rows.join(steps, F.col(stratum).eqNullSafe(F.col(own)), "left")
    return d.select(*names, (~F.col("base_failed") & (step() > F.coalesce(F.col(upto), F.lit(0)))).alias("kept"))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", **limits: float) -> DataFrame:
    """docs with MEASURES, base_failed and kept added.

    Null and empty texts have no words and fail the base rules. Null strata are a stratum of their own; strata without enough
    labels get base rules only. Repeated rows are judged each for itself. Texts of any length are measured whole, and once: the table
    is written with its measures and read for the cutoffs and for the judgement. Columns of docs named like an added one are replaced
    (not so the id or the stratum: rename them before), others may have any names. Empty docs or labels give an empty result or base
    rules only.
    """
    known = common.cut(measured(docs, text_col), "measured", codec="zstd")
    steps = common.cut(proven(known, labels, stratum, id_col=id_col, **limits), "steps")
    return judged(known, steps, stratum)
