"""Streaming forms: the rules of the batch counters in keyed state, with limits on how long it lives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import quad_holds


def stream_traffic_minutes(counts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Rounded mean of each zone and minute of a stream (zone, ts, n); a minute is given out when the watermark has passed it."""
    minute = counts.withWatermark("ts", late).groupBy("zone", F.window("ts", "1 minute").alias("w"))
    return minute.agg(F.bround(F.avg("n")).cast("long").alias("mean")).select("zone", F.col("w.start").alias("minute"), "mean")


def stream_keep_spaced(rows: DataFrame, keys: list[str], gap: float, late: str = "10 minutes") -> DataFrame:
    """Rows (keys, ts, t) at least ``gap`` seconds after the last kept one of their key; state is the last kept time.

    Rows of one micro-batch are put in order first. State goes when the watermark is ``gap`` past it.
    """
    columns = rows.columns

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("t", kind="stable")
        last = state.get[0] if state.exists else float("-inf")
        keep = []
        for t in pdf["t"]:
            keep.append(t - last >= gap)
            if keep[-1]:
                last = t
        state.update((last,))
        state.setTimeoutTimestamp(max(int(pdf["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(gap * 1000) + 1)
        yield pdf[keep][columns]

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    watched = rows.withWatermark("ts", late)
    return watched.groupBy(*keys).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def stream_alert_cooldown(alerts: DataFrame, seconds: float = 120.0, late: str = "10 minutes") -> DataFrame:
    """Alerts to send: at most one a key in ``seconds``."""
    return stream_keep_spaced(alerts, ["key"], seconds, late)


def in_band(rows: DataFrame, near: float) -> DataFrame:
    """Points at a line (ax, ay, bx, by) that count: ``near`` or further away, and within the band of their side where the line has one."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    d = (dx * (F.col("v") - F.col("ay")) - dy * (F.col("u") - F.col("ax"))) / F.hypot(dx, dy)
    rows = rows.where(F.abs(d) >= near)
    if not {"positive", "negative"} <= set(rows.columns):
        return rows
    band = F.when(d > 0, F.col("positive")).otherwise(F.col("negative"))
    corners = [(F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), *((band[i]["x"], band[i]["y"]) for i in (1, 0))]
    return rows.where(band.isNull() | quad_holds(corners, F.col("u"), F.col("v"))).drop("positive", "negative")


def stream_line_crossings(pixels: DataFrame, lines: DataFrame, near: float = 0.008, memory: float = 2.0, pause: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """Crossings of a stream (session, camera, person_id, ts, t, u, v); state is a person's last counted point at a line.

    The rules are those of the batch form, bands and lines that are too short among them. State goes when the watermark is past what a later point could use.
    """
    joined = in_band(pixels.join(F.broadcast(lines.where("hypot(bx - ax, by - ay) >= 0.001")), "camera"), near).withWatermark("ts", late)  # a plan's lines

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("t", kind="stable")
        seen, t0, u0, v0, d0, crossed = state.get if state.exists else (False, 0.0, 0.0, 0.0, 0.0, -1e18)
        out = []
        for r in pdf.itertuples():
            dx, dy = r.bx - r.ax, r.by - r.ay
            size = (dx * dx + dy * dy) ** 0.5
            d = (dx * (r.v - r.ay) - dy * (r.u - r.ax)) / size
            if abs(d) < near:
                continue
            if seen and d * d0 < 0 and r.t - t0 <= memory:
                k = abs(d0) / (abs(d0) + abs(d))
                at = ((u0 + k * (r.u - u0) - r.ax) * dx + (v0 + k * (r.v - v0) - r.ay) * dy) / (size * size)
                if 0 <= at <= 1 and r.t - crossed >= pause:
                    crossed = r.t
                    out.append((*key, r.t, "entry" if (1 if d > 0 else -1) == r.entry_side else "exit"))
            seen, t0, u0, v0, d0 = True, r.t, r.u, r.v, d
        state.update((seen, t0, u0, v0, d0, crossed))
        state.setTimeoutTimestamp(max(int(pdf["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(max(memory, pause) * 1000) + 1)
        yield pd.DataFrame(out, columns=["session", "camera", "line_id", "person_id", "t", "direction"])

    types = dict(joined.dtypes)
    schema = f"session {types['session']}, camera {types['camera']}, line_id {types['line_id']}, person_id {types['person_id']}, t double, direction string"
    return joined.groupBy("session", "camera", "line_id", "person_id").applyInPandasWithState(step, schema, "seen boolean, t double, u double, v double, d double, crossed double", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_alert_log(path: str, parts: int = 16):
    """``foreachBatch`` function that keeps one row a key: first time, greatest peak, last duration; a replayed batch changes nothing.

    The log is cut by the key's hash into ``parts`` folders, and a batch reads and writes those only that its keys
    fall into: each part's rows go to a folder of the batch's number, of which the newest before the batch counts.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("key").agg(F.min("t").alias("start"), F.max("peak").alias("peak"), F.max("t").alias("last_t"), F.max_by("duration", "t").alias("duration"))
        new = new.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).persist()
        touched = sorted(r.part for r in new.select("part").distinct().collect())  # ``parts`` numbers at most
        for part in touched:
            own = new.where(F.col("part") == part).drop("part")
            old = [e for e in _epochs(spark, f"{path}/part={part}") if e < epoch]
            if old:
                before = spark.read.schema(own.schema).parquet(f"{path}/part={part}/epoch={max(old)}")
                own = own.unionByName(before).groupBy("key").agg(F.min("start").alias("start"), F.max("peak").alias("peak"), F.max_by("duration", "last_t").alias("duration"), F.max("last_t").alias("last_t")).select(*own.columns)
            own.coalesce(1).write.mode("overwrite").parquet(f"{path}/part={part}/epoch={epoch}")
        new.unpersist()

    return put


def _epochs(spark, path: str) -> list[int]:
    """Numbers of the finished ``epoch=`` folders, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = [f.getPath() for f in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return [int(p.getName().removeprefix("epoch=")) for p in done]


def read_alert_log(spark, path: str, parts: int = 16) -> DataFrame:
    """The log as ``upsert_alert_log`` keeps it: the newest folder of each part."""
    found = [(part, epochs) for part in range(parts) if (epochs := _epochs(spark, f"{path}/part={part}"))]
    return spark.read.parquet(*(f"{path}/part={part}/epoch={max(epochs)}" for part, epochs in found))
