"""Viewers' live queues as state: events wait by priority, and are given away one by one when a viewer asks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import live

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INPUT = {"viewer": "string", "at": "timestamp_ntz", "kind": "string", "id": "long", "priority": "double", "lat": "double", "lon": "double", "geo_radius_m": "int", "cam_lat": "double", "cam_lon": "double", "cam_altitude": "double"}
TAKEN = "viewer string, at timestamp_ntz, id long, priority double, lat double, lon double, geo_radius_m int, cam_lat double, cam_lon double, cam_altitude double"
#: At one time events come before what viewers ask.
ORDER = {"event": 0, "clear": 1, "take": 2}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that begin inside keep their state as this operator needs it."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class ViewerQueue(StatefulProcessor):
    """The queue of one viewer: at most `depth` events by id, the lowest go first; what waits already isn't queued again, what was given away may be."""

    def __init__(self, depth: int = live.QUEUE_DEPTH):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "id long", "priority double, place long, lat double, lon double, geo_radius_m int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        held = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        before, out = dict(held), []
        place = max((v[1] for v in held.values()), default=0)
        batch = pd.concat(list(rows), ignore_index=True)
        batch["_o"] = batch["kind"].map(ORDER)
        for r in batch.sort_values(["at", "_o", "id"], kind="stable").itertuples():
            if r.kind == "clear":
                held.clear()
            elif r.kind == "take":
                if held:
                    i = min(held, key=lambda x: (-held[x][0], held[x][1]))
                    v = held.pop(i)
                    out.append((key[0], r.at, i, v[0], v[2], v[3], v[4], r.cam_lat, r.cam_lon, r.cam_altitude))
            elif int(r.id) not in held:
                place += 1
                held[int(r.id)] = (r.priority, place, r.lat, r.lon, None if pd.isna(r.geo_radius_m) else int(r.geo_radius_m))
                if len(held) > self.depth:
                    held.pop(max(held, key=lambda x: (-held[x][0], held[x][1])))
        for i in before.keys() - held.keys():
            self.waiting.removeKey((i,))
        for i in held.keys():
            if before.get(i) != held[i]:
                self.waiting.updateValue((i,), held[i])
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in TAKEN.split(", ")]).astype({"geo_radius_m": "Int32"})

    def close(self) -> None:
        pass


def dequeue(events: DataFrame, asks: DataFrame, depth: int = live.QUEUE_DEPTH) -> DataFrame:
    """(viewer, at, id, priority, fly): what each viewer of a stream is given, in turn, the event of highest priority that waits for them, and whether the camera has to fly to it.

    events are a stream with viewer, received_at and what priorities and places need; asks are a stream of viewer, at, kind (`take` or `clear`), and the camera's lat, lon and altitude.
    A priority is that of the time when an event came, ties go to the first. Of two with one time and kind the smaller id is first. State is `depth` events a viewer; a task reads a viewer's
    narrow rows of one batch. Start the query inside `rocksdb`.
    """
    nothing = lambda *cs: [F.lit(None).cast(INPUT[c]).alias(c) for c in cs]
    came = events.select(
        "viewer", F.col("received_at").alias("at"), F.lit("event").alias("kind"), "id", F.round(live.priority(F.col("received_at")), 9).alias("priority"), "lat", "lon", F.col("geo_radius_m").cast("int").alias("geo_radius_m"), *nothing("cam_lat", "cam_lon", "cam_altitude")
    )
    asked = asks.select("viewer", "at", "kind", *nothing("id", "priority"), *nothing("lat", "lon", "geo_radius_m"), *[F.col(c).cast("double").alias(f"cam_{c}") for c in ("lat", "lon", "altitude")])
    given = came.unionByName(asked).groupBy("viewer").transformWithStateInPandas(ViewerQueue(depth), TAKEN, "Append", "None")
    angle = live.angle_deg(F.col("lat"), F.col("lon"), F.col("cam_lat"), F.col("cam_lon"))
    seen = angle < live.VISIBLE_DEG + live.VISIBLE_DEG_BY_ALTITUDE * F.least(F.col("cam_altitude"), F.lit(2.0))
    presented = seen & (F.col("cam_altitude") <= live.target_altitude(F.col("geo_radius_m")) * 1.6)
    return given.select("viewer", "at", "id", "priority", (~presented).alias("fly"))
