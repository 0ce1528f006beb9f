"""Mates of a stream joined with each other, wherever the micro-batches are cut.

Fragments' names are dealt to a fixed number of groups, and a group's state holds the reads that
still wait for their mate. A read meets the longest waiting one that points back at it from the
other side, and both are used up; copies therefore pair as often as the rarer side comes. What
the watermark leaves behind expires. A group pairs all its names at once, so that Python runs
once for each group and not for each name. Reads that wait long make a state as large as the
stream: it is packed, and on_disk() keeps it out of the executors' heap.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GROUPS = 2048  # part of the checkpoint, like the number of state partitions
PAIR = "name string, target_id bigint, lo bigint, hi bigint, read_l string, read_r string"
MATCH = ["name", "target_id", "lo", "hi", "first"]  # first as the forward read has it
QUEUED = pa.schema(
    [("name", pa.string()), ("target_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]
    + [("first", pa.bool_()), ("reversed", pa.bool_()), ("read", pa.string()), ("until", pa.int64())]
)


STORE = "spark.sql.streaming.stateStore"
ON_DISK = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # All stores of an executor share this memory, however many partitions the state has.
    f"{STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{STORE}.rocksdb.maxMemoryUsageMB": "256",
    # A batch rewrites every group that it reaches, so each version kept is a copy of the state.
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@contextmanager
def on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside hold their state in local files; a checkpoint must always be started so."""
    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    for k, v in ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _packed(waiting: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, QUEUED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.Table.from_pandas(waiting[QUEUED.names], QUEUED, preserve_index=False))
    return out.getvalue().to_pybytes()


def _unpacked(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(state).read_all().to_pandas()


def _pairing(horizon_ms: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        rows = []
        if state.exists:
            waiting = _unpacked(state.get[0])
            rows.append(waiting[waiting["until"] > mark])
        if not state.hasTimedOut and (come := list(parts)):
            new = pd.concat(come, ignore_index=True).sort_values(["ts", "at"], kind="stable")
            back = new["reversed"].eq(True)
            until = new["ts"].astype("datetime64[ms]").astype("int64") + horizon_ms
            new = new.assign(first=new["first"].eq(True) ^ back, reversed=back, until=until)
            rows.append(new[QUEUED.names])
        queue = pd.concat(rows, ignore_index=True) if rows else QUEUED.empty_table().to_pandas()
        # The k-th read of one side meets the k-th of the other, those that waited before the new.
        queue["k"] = queue.groupby([*MATCH, "reversed"], sort=False, dropna=False).cumcount()
        back = queue["reversed"].astype(bool)
        queue["row"] = queue.index
        found = queue[~back].merge(queue[back], on=[*MATCH, "k"], suffixes=("_l", "_r"))
        left = queue[~queue["row"].isin(found["row_l"]) & ~queue["row"].isin(found["row_r"])]
        if len(left):
            state.update((_packed(left),))
            state.setTimeoutTimestamp(max(int(left["until"].min()), mark + 1))
        elif state.exists:
            state.remove()
        yield found[["name", "target_id", "lo", "hi", "read_l", "read_r"]]

    return step


def pair_stream(reads: DataFrame, time: str, horizon: str, order: str = "line_no") -> DataFrame:
    """reads(name, target_id, left, mate_l, first, reversed, order, time, ...) of a stream to
    (name, target_id, left, right, read_l, read_r), a row for each pair of mates.

    order puts equal reads of one time in their turn. A read without its mate is given up once
    the watermark has passed it by the horizon; reads without mate_l are none of this join's.
    """
    payload = F.struct(*[F.col(c) for c in reads.columns if c not in ("name", "target_id", "mate_l", time)])
    kind = reads.select(payload.alias("p")).schema["p"].dataType
    name_kind = reads.schema["name"].dataType.simpleString()
    rev, at, mate = F.col("reversed"), F.col("left").cast("bigint"), F.col("mate_l").cast("bigint")
    rows = reads.withWatermark(time, horizon).filter(F.col("mate_l").isNotNull())
    rows = rows.select(
        "name",
        F.col("target_id").cast("bigint").alias("target_id"),
        F.when(rev, mate).otherwise(at).alias("lo"),
        F.when(rev, at).otherwise(mate).alias("hi"),
        "first",
        "reversed",
        F.col(order).alias("at"),
        F.col(time).alias("ts"),
        F.to_json(payload).alias("read"),
    ).filter("lo <= hi and target_id is not null")
    rows = rows.withColumns({"part": F.pmod(F.xxhash64("name"), F.lit(GROUPS)), "name": F.col("name").cast("string")})
    span = int(rows.sparkSession.range(1).select((F.expr(f"interval {horizon}") + F.timestamp_seconds(F.lit(0))).cast("double")).first()[0] * 1000)
    pairs = rows.groupBy("part").applyInPandasWithState(
        _pairing(span), PAIR, "waiting binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    read = lambda c: F.from_json(c, kind).alias(c)
    found = pairs.select(F.col("name").cast(name_kind), "target_id", read("read_l"), read("read_r"))
    return found.select("name", "target_id", F.col("read_l.left").alias("left"), F.col("read_r.right").alias("right"), "read_l", "read_r")
