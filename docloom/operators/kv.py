"""Key-value reads over tables with a string or binary key: point, half-open range, prefix, usage by tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.values import name

TENANT = 16


def _lit(df: DataFrame, key: str, value) -> Column:
    return F.lit(bytes(value) if isinstance(value, (bytes, bytearray)) else value)


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; None if there is none."""
    own = bytearray(prefix)
    while own and own[-1] == 0xFF:
        own.pop()
    if not own:
        return None
    own[-1] += 1
    return bytes(own)


def get(df: DataFrame, key_value, key: str = "key") -> DataFrame:
    return df.filter(name(key) == _lit(df, key, key_value))


def scan(df: DataFrame, lo, hi=None, key: str = "key") -> DataFrame:
    """lo <= key < hi; an empty hi is no bound. Plain comparisons, which the scan can use to skip files."""
    out = df.filter(name(key) >= _lit(df, key, lo))
    return out.filter(name(key) < _lit(df, key, hi)) if hi else out


def prefix_scan(df: DataFrame, prefix, key: str = "key") -> DataFrame:
    if isinstance(prefix, str):
        return df.filter(name(key).startswith(prefix))
    return scan(df, prefix, successor(prefix), key)


def delete_prefix(df: DataFrame, prefix, key: str = "key") -> DataFrame:
    """What is left."""
    if isinstance(prefix, str):
        return df.filter(~name(key).startswith(prefix))
    high = successor(prefix)
    return df.filter((name(key) < F.lit(prefix)) | ((name(key) >= F.lit(high)) if high else F.lit(False)))


def tenant_usage(df: DataFrame, key: str = "key", value: str = "value", width: int = TENANT) -> DataFrame:
    """Live bytes of values by the first `width` bytes of the key."""
    return df.groupBy(F.substring(name(key), 1, width).alias("tenant")).agg(F.sum(F.octet_length(name(value))).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("keys"))


def duplicate_keys(batch: DataFrame, key: str = "key") -> DataFrame:
    return batch.groupBy(name(key)).count().filter("count > 1")
