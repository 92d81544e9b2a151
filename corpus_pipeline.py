"""Documents to training tokens: quality rules, near-duplicates, personal data, source mixing, byte-level BPE."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, common, mixing, ngram_join, pii, quality

RANKS = "byte_bpe_multi_50k.tiktoken"


def _beside(docs: DataFrame, added: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(docs), where columns of docs named like one that step adds keep their values and names."""
    clash = [c for c in docs.columns if c in added]
    own = dict(zip(clash, common.fresh([*docs.columns, *added], *[f"own_{c}" for c in clash])))
    done = step(docs.withColumnsRenamed(own)) if own else step(docs)
    return done.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, whole rows.

    Null and empty texts have no words and go. Equal rows are judged each for itself, so all stay or all go; ties need no care. Texts
    of any length are measured whole. Empty documents stay empty; without labels the base rules alone decide. Further columns, of any
    name, are kept.
    """
    labels = common.table(spark, sf_dir, "labels")
    return _beside(docs, (*quality.MEASURES, "base_failed", "kept"), lambda d: quality.quality(d, labels).filter("kept"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a Jaccard similarity of 0.8 or more over five-word shingles: that of the smallest id.

    Null texts and texts without words are in no group and stay. Of rows equal in id and text one stays, of equal ids the one with the
    smaller text hash, null ids come last. Texts of any length are compared whole. Empty documents stay empty. Further columns, of any
    name, are kept.
    """
    return ngram_join.one_of_each(docs, k=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars, if there, follows the text.

    Null texts stay null, empty ones empty. Of spans that overlap, the one that starts first names the replacement, of equal starts the
    kind listed first. Equal rows are changed alike. Texts of any length are searched whole. Empty documents stay empty. Further
    columns, of any name, are kept.
    """

    def changed(d: DataFrame) -> DataFrame:
        found = pii.find(d).withColumn("text", pii.redact(F.col("text"), F.col("spans")))
        return found.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in d.columns else found

    return _beside(docs, ("base", "spans"), changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice.

    Null texts and texts without words have size 0 and may be taken; a null source is a source of its own. Equal rows count each for
    itself, and of rows equal in id and text any may be taken. Texts of any length are taken whole or not. Empty documents stay empty.
    Further columns, of any name, are kept.
    """

    def taken(d: DataFrame) -> DataFrame:
        mixed = mixing.mix(d)
        return mixed.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias(*common.fresh(mixed.columns, "copy")))

    return _beside(docs, ("size", "source_size", "target", "copies"), taken)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens, decoded_sha256 of each document; the ids are decoded again, and anything but the text raises.

    Null texts count as empty and have no ids. Equal rows, such as copies from the mix, give equal rows. Texts of any length are
    encoded whole. Empty documents give an empty result. Further columns are left out.
    """
    ranks = public_tokenizers.path(RANKS)
    back = bpe.encode_and_decode(docs.select("doc_id", "source", "lang", "text"), ranks)
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    ids = F.when(whole, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to the text")))
    return back.select("doc_id", "source", "lang", ids.alias("ids"), F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("pii", redact),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: BPE merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut(docs, name)
    return docs
