"""Packets of a stream as flows of both directions, folded in state until a flow has been quiet.

A flow is kept as mergeable sums in a session window, so packets may come in any order within the
watermark: a packet joins every open flow of its endpoints that is at most the pause away, and so may
join two flows to one. The watermark gives the flow out at the end of the pause. State is one row for
each open flow. ``packet``, ``merged`` and ``joined`` say the same of a list of packets in plain Python.
"""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.values import endpoints

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packet(ms: int, from_low: bool, size: float, name: str | None) -> tuple:
    """A packet as a flow of its own: milliseconds of the first packet, who sent it, milliseconds of the
    last, packets and bytes of the low and of the high endpoint, the earliest name and its milliseconds."""
    low = int(from_low)
    return (ms, from_low, ms, low, 1 - low, size * low, size * (1 - low), name, None if name is None else ms)


def merged(a: tuple, b: tuple) -> tuple:
    """Two parts of one flow as one; at equal times the low endpoint began, and the smaller name counts."""
    began = min(a, b, key=lambda x: (x[0], not x[1]))
    name = min((x for x in (a, b) if x[7] is not None), key=lambda x: (x[8], x[7]), default=a)
    return (began[0], began[1], max(a[2], b[2]), *(x + y for x, y in zip(a[3:7], b[3:7], strict=True)), name[7], name[8])


def joined(flows: Iterable[tuple], pause: int) -> list[tuple]:
    """Flows in order of time, those at most the pause apart merged."""
    out: list[tuple] = []
    for f in sorted(flows, key=lambda x: (x[0], not x[1])):
        if out and f[0] - out[-1][2] <= pause:
            out[-1] = merged(out[-1], f)
        else:
            out.append(f)
    return out


@contextmanager
def state_store(spark: SparkSession):
    """The state store for many open flows, which need not fit into memory, while queries are started."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(setting, before) if before is not None else spark.conf.unset(setting)


def fold_stream(packets: DataFrame, pause: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Flows from a stream of (src, sport, dst, dport, proto, ts, bytes, name), ts being a timestamp.

    The endpoint of a flow's first packet is its client; the earliest name is kept. A flow comes out
    when the watermark is ``pause`` seconds past its last packet. Packets that are ``pause`` seconds later
    than the watermark, whose flows have come out, are dropped. Times are kept in milliseconds; null bytes
    count 0.
    """
    text = lambda end: F.concat_ws(" ", F.col(f"_e.{end}.ip").cast("string"), F.col(f"_e.{end}.port").cast("string"))
    ends = endpoints(F.col("src").cast("string"), F.col("sport"), F.col("dst").cast("string"), F.col("dport"))
    t = packets.withColumn("ts", F.timestamp_millis(F.unix_millis("ts"))).withWatermark("ts", late).withColumn("_e", ends)
    forward = (F.col("src").cast("string") == F.col("_e.low.ip")) & (F.col("sport") == F.col("_e.low.port"))
    t = t.select(text("low").alias("low"), text("high").alias("high"), F.col("proto").cast("string").alias("proto"), "ts", F.unix_millis("ts").alias("ms"), forward.alias("from_low"), F.coalesce(F.col("bytes").cast("double"), F.lit(0.0)).alias("bytes"), "name")
    low = F.coalesce("from_low", F.lit(False))
    sums = {
        "_began": F.min(F.struct(F.col("ms"), (~low).alias("from_high"))), "last": F.max("ms"), "_named": F.min(F.when(F.col("name").isNotNull(), F.struct("ms", "name"))),
        "packets_low": F.sum(low.cast("long")), "packets_high": F.sum((~low).cast("long")),
        "bytes_low": F.sum(F.when(low, F.col("bytes")).otherwise(0.0)), "bytes_high": F.sum(F.when(~low, F.col("bytes")).otherwise(0.0)),
    }
    folded = t.groupBy(F.session_window("ts", f"{pause} seconds"), "low", "high", "proto").agg(*[c.alias(name) for name, c in sums.items()])
    folded = folded.withColumns({"first": F.col("_began.ms"), "from_low": ~F.col("_began.from_high"), "name": F.col("_named.name")})
    side = lambda a, b: F.when(F.col("from_low"), F.col(a)).otherwise(F.col(b))
    part = lambda c, i: F.split(c, " ")[i]
    client, server = side("low", "high"), side("high", "low")
    return folded.select(
        part(client, 0).alias("client"), part(client, 1).alias("client_port"), part(server, 0).alias("server"), part(server, 1).alias("server_port"), "proto",
        (F.col("first") / 1000.0).alias("first"), (F.col("last") / 1000.0).alias("last"), side("packets_low", "packets_high").alias("packets_out"),
        side("packets_high", "packets_low").alias("packets_in"), side("bytes_low", "bytes_high").alias("bytes_out"), side("bytes_high", "bytes_low").alias("bytes_in"), "name",
    )
