"""Change feeds as streams over the changelog's files.

The file source sees published commits only, each once for a checkpoint. Events are delivered at least once; each
batch is sorted by (_seq, _ord) before it is handed on. Expiry and compaction make no events.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.errors import LimitExceeded
from docloom.sources.store import CHANGES, Collection


def stream(collection: Collection, after_seq: int | None = None) -> DataFrame:
    """The events of a collection as an unbounded table, from after a sequence number (None: all that are kept)."""
    engine = collection.engine
    out = engine.spark.readStream.schema(CHANGES).option("basePath", f"{engine.path}/changes").parquet(f"{engine.path}/changes")
    out = out.filter((F.col("collection") == collection.name) & (F.col("_seq") > F.lit(engine.catalog["kept_from"])))
    out = out.filter(F.col("_seq") > after_seq) if after_seq is not None else out
    return out.select("_seq", "_ord", "op", "_id", "body", "_ts")


MOST_WATCHES = 128  # of an engine at a time


def watch(collection: Collection, handle: Callable[[DataFrame, int], None], checkpoint: str, resume: str | None = None, once: bool = False, deadline: float | None = None) -> StreamingQuery:
    """Calls handle(events in order, batch id). Without a token the feed starts after the present end.

    once: stops when all that is there has been handled. deadline: seconds that a call may take; the feed of a slower
    consumer ends with an error, and goes on from the checkpoint when it is started again.
    """
    mine = f"watch {collection.engine.catalog['id']} "
    if sum((w.name or "").startswith(mine) for w in collection.spark.streams.active) >= MOST_WATCHES:
        raise LimitExceeded(f"more than {MOST_WATCHES} feeds of one engine")

    def timed(df: DataFrame, i: int) -> None:
        began = time.monotonic()
        handle(df.orderBy("_seq", "_ord"), i)
        if deadline is not None and time.monotonic() - began > deadline:
            raise LimitExceeded(f"a slow consumer: more than {deadline} s for a batch")

    own = collection._after_token(resume or collection.token())
    past = (F.col("_seq") > own.seq) | ((F.col("_seq") == own.seq) & (F.col("_ord") > own.ordinal))
    events = stream(collection).filter(past)
    writer = events.writeStream.queryName(mine + uuid.uuid4().hex).foreachBatch(timed).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
