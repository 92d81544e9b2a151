"""Declared type words to Spark types; unknown words are strings."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_WORDS = {
    "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "SMALLINT": T.ShortType(), "TINYINT": T.ByteType(),
    "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(),
}


def spark_type(word: str) -> T.DataType:
    name, *sizes = re.findall(r"\w+", word.upper())
    if name in ("DECIMAL", "NUMERIC"):
        return T.DecimalType(*(int(s) for s in sizes)) if sizes else T.DecimalType(38, 0)
    return _WORDS.get(name, T.StringType())
