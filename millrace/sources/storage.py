"""Committed databases: one Parquet folder a table and version, and a JSON manifest; exports; encrypted columns.

Files are reached through Hadoop's file systems, so any store that Spark writes works. A commit writes new folders, then a new
manifest under the next number; the highest number counts, so a commit is there as a whole or not at all, and nothing is overwritten that
a plan may still read.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decrypt, encrypt

MANIFEST = "manifest-{}.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file: written beside path and then renamed, so that it is never there in part. Raises if path exists."""
    fs, p = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(draft, p):
        fs.delete(draft, False)
        raise OSError(f"could not write {path}: it exists")


def write_table(df: DataFrame, root: str, name: str, *, order: list[str] | None = None, codec: str = "zstd", key: str | None = None) -> str:
    """A new folder under root. Rows are laid out by the first column of `order`, so that look-ups on it skip files, and files hold Bloom
    filters of the others, so that those for one value do. With a key, every column is encrypted."""
    folder = f"{name}-{uuid.uuid4().hex}"
    first, *others = order or [None]
    if first:
        df = df.repartitionByRange(first).sortWithinPartitions(first)
    if key:
        df = sealed_rows(df, key)
    write = df.write.option("compression", codec)
    for c in [] if key else others:
        write = write.option(f"parquet.bloom.filter.enabled#{c}", "true")
    write.parquet(f"{root}/{folder}")
    return folder


def read_table(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None) -> DataFrame:
    return opened_rows(spark.read.parquet(path), schema, key) if key else spark.read.schema(schema).parquet(path)


def manifests(spark: SparkSession, root: str) -> list[int]:
    """Versions of the manifest, ascending."""
    fs, p = _fs(spark, root)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for x in names if (m := re.fullmatch(MANIFEST.replace("{}", r"(\d+)").replace(".", r"\."), x)))


def save_manifest(spark: SparkSession, root: str, data: dict) -> None:
    """The next version. The one before stays until this one is in place; of two commits at a time, the second fails."""
    old = manifests(spark, root)
    write_text(spark, f"{root}/{MANIFEST.format((old or [0])[-1] + 1)}", json.dumps(data))
    for v in old[:-1]:
        fs, p = _fs(spark, f"{root}/{MANIFEST.format(v)}")
        fs.delete(p, False)


def load_manifest(spark: SparkSession, root: str) -> dict | None:
    old = manifests(spark, root)
    return json.loads(read_text(spark, f"{root}/{MANIFEST.format(old[-1])}")) if old else None


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes doubled, empty text told from null, line breaks kept when read by read_csv()."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", r"\N").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", r"\N").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sealed(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """df with text columns encrypted."""
    return df.withColumns({c: encrypt(F.col(f"`{c}`"), key) for c in columns})


def opened(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    return df.withColumns({c: decrypt(F.col(f"`{c}`"), key) for c in columns})


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def sealed_rows(df: DataFrame, key: str) -> DataFrame:
    """df with every column encrypted, of any type."""
    return df.select(*[F.aes_encrypt(F.to_json(F.struct(F.col(f"`{c}`").alias("v")), _JSON), F.lit(key), F.lit("GCM")).alias(c) for c in df.columns])


def opened_rows(df: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    plain = lambda f: F.aes_decrypt(F.col(f"`{f.name}`"), F.lit(key), F.lit("GCM")).cast("string")
    return df.select(*[F.from_json(plain(f), T.StructType([T.StructField("v", f.dataType)]), _JSON)["v"].alias(f.name) for f in schema])
