"""Versions of documents: newest per key, snapshots at a sequence number or time, expiry, compaction, change feeds.

A change row has `_id`, `_seq`, `_ord`, `op` ('upsert' or 'delete'), a body and `_expires_at` (unix ms; null or 0: never).
A change is told from all others by its key, `_seq` and `_ord`. The newest versions' numbers are found by a hash aggregate
over keys and numbers alone, which combines before the shuffle; bodies are then met by a hash join with these, where they are: no
window, no sort of bodies, and no second shuffle of the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.values import name

CHANGE = ["_seq", "_ord"]


def alive(now_ms: int | Column, expires: str = "_expires_at") -> Column:
    """Visible while now <= the time of expiry."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return F.coalesce(name(expires), F.lit(0)).isin(0) | (now <= name(expires))


def newest(changes: DataFrame, key: str | list[str] = "_id", order: list[str] | None = None) -> DataFrame:
    """The newest version of each key, deletes included."""
    keys, order = [key] if isinstance(key, str) else key, order or [c for c in CHANGE if c in changes.columns]
    place = name(order[0]).cast("decimal(38,0)")
    for c in order[1:]:
        place = place * F.lit(str(1 << 63)).cast("decimal(20,0)") + name(c)
    place = place.cast("decimal(38,0)")  # a number of fixed width, which a hash aggregate can hold
    own = F.struct(*[name(k).alias(f"k{i}") for i, k in enumerate(keys)])  # null keys are equal within a struct
    last = changes.groupBy(own.alias("__key")).agg(F.max(place).alias("__place"))
    # no place is above the last, so >= is equality; as it is no key of the join, the groups stay where they are
    return changes.join(last.hint("shuffle_hash"), (own == F.col("__key")) & (place >= F.col("__place")), "left_semi")


def snapshot(changes: DataFrame, seq: int | None = None, now_ms: int | None = None, key: str = "_id", order: list[str] | None = None) -> DataFrame:
    """The documents as of a sequence number: newest versions up to it, without deletes and, at now_ms, expired ones."""
    order = order or [c for c in CHANGE if c in changes.columns]
    seen = changes if seq is None else changes.filter(name(order[0]) <= seq)
    out = newest(seen, key, order).filter("op <> 'delete'")
    return out.filter(alive(now_ms)) if now_ms is not None and "_expires_at" in changes.columns else out


def seq_at(changes: DataFrame, time, ts: str = "_ts", seq: str = "_seq") -> DataFrame:
    """One row: the greatest sequence number of a change at or before the time."""
    return changes.filter(name(ts) <= F.lit(time)).agg(F.max(name(seq)).alias("seq"))


def changes_after(changes: DataFrame, seq: int, ordinal: int = -1) -> DataFrame:
    """The feed strictly after (seq, ordinal), in order."""
    at = (F.col("_seq") > seq) | ((F.col("_seq") == seq) & (F.col("_ord") > ordinal))
    return changes.filter(at).orderBy("_seq", "_ord")


def all_versions(changes: DataFrame, key: str = "_id") -> DataFrame:
    return changes.orderBy(name(key), F.desc("_seq"), F.desc("_ord"))


def compact(changes: DataFrame, watermark: int, now_ms: int | None = None, key: str = "_id") -> DataFrame:
    """What readers at or after the watermark need: newer versions, and the newest up to it unless deleted or expired.

    An expired version goes together with all older ones of its key.
    """
    newer, older = changes.filter(F.col("_seq") > watermark), changes.filter(F.col("_seq") <= watermark)
    base = snapshot(older, None, now_ms, key)
    return newer.unionByName(base)


def derived_expiry(value: Column, seconds: int) -> Column:
    """field_ms + seconds; never (0) without a number; held at the largest long."""
    most = (1 << 63) - 1
    add = seconds * 1000
    v = value.cast("bigint")
    return F.coalesce(F.when(v > most - add, F.lit(most)).otherwise(F.try_add(v, F.lit(add))), F.lit(0).cast("bigint"))
