"""A filter of fixed size for keys: a bitmap of hashes that is broadcast whatever the number of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 2 MB. With very many keys it lets more rows through, which an exact join must remove.
FILTER_BITS = 1 << 24


def _bit(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def bitmap_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The bits of the keys, in at most FILTER_BITS / 32768 pieces of 4 kB: part, bitmap."""
    bits = rows.select(_bit(keys).alias("bit"))
    return bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def within_bitmap(rows: DataFrame, keys: list[str], bits: DataFrame) -> DataFrame:
    """The rows whose keys may be among those of the bitmap: all that are, and some that aren't."""
    probe = rows.withColumn("_bit", _bit(keys)).withColumns({"_part": F.bitmap_bucket_number("_bit"), "_pos": F.bitmap_bit_position("_bit")})
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("_pos") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = probe.join(F.broadcast(bits.withColumnRenamed("part", "_part")), "_part")
    return met.where(F.getbit(byte, F.pmod(F.col("_pos"), F.lit(8)).cast("int")) == 1).select(*rows.columns)
