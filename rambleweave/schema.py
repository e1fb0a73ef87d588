"""The fixed shapes of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_L = T.ArrayType(T.StringType())

DOCUMENTS = T.StructType(
    [
        T.StructField("id", _S), T.StructField("title", _S), T.StructField("aliases", _L), T.StructField("type", _S), T.StructField("path", _S),
        T.StructField("mtime", T.TimestampType()), T.StructField("size", T.LongType()), T.StructField("refs", _L), T.StructField("tags", _L), T.StructField("text", _S),
    ]
)
LINKS = "a string, b string"
RENAMES = "old_id string, new_id string"
TOUCH = "seq long, ts long, target string, src string"
BLOCK = "id long, content string, text string, modified long, parent long, left_id long"
BLOCK_ALIAS = "name string, block long, pos int"
BLOCK_REF = "f long, t long"
COLUMNS = DOCUMENTS.fieldNames()
