"""Stays of people in zones and the events they make."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import zone_of


def of_person():
    """Rows of a person."""
    return Window.partitionBy("session", "person_id")


@dataclass(frozen=True)
class Params:
    """Thresholds in metres and seconds; ``scale`` stretches those of length for relative plans."""

    step: float = 0.2
    tolerance: float = 1.0
    dwell: float = 5.0
    away: float = 10.0
    queue: float = 8.0
    queue_speed: float = 0.35
    crowd: int = 3
    crowd_density: float = 0.25
    crowd_speed: float = 0.5
    crowd_seconds: int = 5
    scale: float = 1.0


def assign_zone(positions: DataFrame, zones: list[dict]) -> DataFrame:
    """Add zone_id: the zone each position counts for, -1 for none. Zones are a plan's, a hundred at most."""
    return positions.withColumn("zone_id", zone_of(zones)("x", "y"))


def zone_runs(pos: DataFrame) -> DataFrame:
    """Runs of consecutive positions of a person in one zone (-1 too): run number, first and last t, rows."""
    order = of_person().orderBy("t")
    rows = pos.withColumn("new", F.coalesce((F.lag("zone_id").over(order) != F.col("zone_id")).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.drop("new")


def run_table(runs: DataFrame) -> DataFrame:
    return runs.groupBy("session", "person_id", "run", "zone_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


def merge_runs(pdf: pd.DataFrame, step: float, tolerance: float, interior: set[int]) -> list[list]:
    """Stays of one person as [zone, first, last, runs] from its runs in order.

    Leftmost first, two runs of one zone with a gap shorter than ``tolerance`` between them become one with what
    lies between; then interior runs shorter than that go to the run before (the first one to the next), and
    neighbours of one zone fuse.
    """
    return merged_runs(pdf[["zone_id", "first_t", "last_t", "run"]].itertuples(index=False), step, tolerance, interior)


def merged_runs(runs: Iterable[tuple], step: float, tolerance: float, interior: set[int]) -> list[list]:
    """``merge_runs`` of (zone, first, last, run)."""
    left: list[list] = []
    for zone, first, last, run in runs:
        left.append([zone, first, last, [run]])
        while len(left) >= 3 and left[-3][0] == left[-1][0] and left[-1][1] - left[-3][2] - step < tolerance:
            b, c = left.pop(), left.pop()
            left[-1][2] = b[2]
            left[-1][3] += c[3] + b[3]
    done: list[list] = []
    for stay in left:
        if done and done[-1][0] == stay[0]:  # parted by a short interior run that went to the one before
            done[-1][2] = stay[2]
            done[-1][3] += stay[3]
        elif done and _brief(done[0], step, tolerance, interior) and len(done) == 1:  # only the first can still be short: this one takes it
            stay[1], stay[3] = done[0][1], done[0][3] + stay[3]
            done = [stay]
        elif done and _brief(stay, step, tolerance, interior):
            done[-1][2] = stay[2]
            done[-1][3] += stay[3]
        else:
            done.append(stay)
    return done


def _brief(stay: list, step: float, tolerance: float, interior: set[int]) -> bool:
    """Whether a stay is inside a business and shorter than ``tolerance``."""
    return stay[0] in interior and stay[2] + step - stay[1] < tolerance


def _by_person(runs: DataFrame, *more: str) -> DataFrame:
    """A row a person with its runs in order: (run, zone_id, first_t, last_t, ``more``), for rows (session, person_id, run, zone_id, ...)."""
    return runs.groupBy("session", "person_id").agg(F.array_sort(F.collect_list(F.struct("run", "zone_id", "first_t", "last_t", *more))).alias("runs"))


def _merged(batch: pa.RecordBatch, zones: list[dict], p: Params) -> tuple:
    """Runs of a batch of people as one struct, and the stays of each person in places of that."""
    interior = {z["zone_id"] for z in zones if z["type"] == "INTERIOR"}
    lists = batch.column("runs")
    runs, cut = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(int)
    zone, first, last = (pc.struct_field(runs, c).to_pylist() for c in ("zone_id", "first_t", "last_t"))
    each = [merged_runs(zip(zone[a:b], first[a:b], last[a:b], range(a, b)), p.step, p.tolerance, interior) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    return runs, each


def merge_stays(runs: DataFrame, zones: list[dict], p: Params = Params()) -> DataFrame:
    """(session, person_id, run, stay, zone_id): which stay each run belongs to. Works on runs, which are few a person, of many people at once."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, each = _merged(batch, zones, p)
            rows = [(i, k, zone, at) for i, merged in enumerate(each) for k, (zone, _, _, held) in enumerate(merged, 1) for at in held]
            who, stay, zone, at = (pa.array(v) for v in zip(*rows)) if rows else (pa.array([], pa.int64()),) * 4
            yield pa.RecordBatch.from_pydict({"session": batch.column("session").take(who), "person_id": batch.column("person_id").take(who), "run": pc.struct_field(table, "run").take(at), "stay": stay.cast(pa.int64()), "zone_id": zone.cast(pa.int32())})

    people = _by_person(run_table(runs))
    kinds = {f.name: f.dataType.simpleString() for f in people.schema}
    return people.mapInArrow(merge, f"session {kinds['session']}, person_id {kinds['person_id']}, run long, stay long, zone_id int")


def merged_stays(runs: DataFrame, zones: list[dict], p: Params = Params()) -> DataFrame:
    """``stays`` of the runs that ``merge_stays`` puts together, in one pass: a run goes along with its speeds, and nothing is joined back."""
    rows = runs.groupBy("session", "person_id", "run", "zone_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("confidence").alias("sure"), F.count("confidence").alias("n"), F.collect_list("speed").alias("speeds"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, each = _merged(batch, zones, p)
            first, last, sure, n = (pc.struct_field(table, c).to_numpy(zero_copy_only=False) for c in ("first_t", "last_t", "sure", "n"))
            lists = pc.struct_field(table, "speeds")
            cut = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(int)
            speeds = lists.flatten().to_numpy(zero_copy_only=False)
            out = []
            for i, merged in enumerate(each):
                for k, (zone, _, _, held) in enumerate(merged, 1):
                    paces = np.concatenate([speeds[cut[j] : cut[j + 1]] for j in held])
                    many = n[held].sum()
                    out.append((i, k, zone, first[held].min(), last[held].max() + p.step, sure[held][n[held] > 0].sum() / many if many else None, float(np.median(paces)) if len(paces) else None))
            who, stay, zone, start, end, mean, median = (list(v) for v in zip(*out)) if out else ([],) * 7
            who, number = pa.array(who, pa.int64()), lambda v: pa.array(v, pa.float64())
            yield pa.RecordBatch.from_pydict({"session": batch.column("session").take(who), "person_id": batch.column("person_id").take(who), "stay": pa.array(stay, pa.int64()), "zone_id": pa.array(zone, pa.int32()), "start_s": number(start), "end_s": number(end), "confidence": number(mean), "median_speed": number(median)})

    people = _by_person(rows, "sure", "n", "speeds")
    kinds = {f.name: f.dataType.simpleString() for f in people.schema}
    return people.mapInArrow(merge, f"session {kinds['session']}, person_id {kinds['person_id']}, stay long, zone_id int, start_s double, end_s double, confidence double, median_speed double")


def stays(runs: DataFrame, merged: DataFrame | None = None, step: float = 0.2) -> DataFrame:
    """Stays with start, end (last t and a step), mean confidence and exact median of speeds; each run is one without ``merged``."""
    rows = runs.withColumn("stay", F.col("run"))
    if merged is not None:
        rows = runs.drop("zone_id").join(merged, ["session", "person_id", "run"])
    return rows.groupBy("session", "person_id", "stay", "zone_id").agg(
        F.min("t").alias("start_s"), (F.max("t") + step).alias("end_s"), F.avg("confidence").alias("confidence"), F.percentile("speed", F.lit(0.5)).alias("median_speed")
    )


def spatial_events(stay: DataFrame, zones: DataFrame, p: Params = Params()) -> DataFrame:
    """EXPOSURE, ENTER, RETURN, DWELL, EXIT and QUEUE events of stays; ``zones`` has zone_id, type and local_id."""
    order = of_person().orderBy("stay")
    rows = stay.withColumn("nth", F.row_number().over(order)).withColumn("of", F.count("*").over(of_person()))
    rows = rows.join(F.broadcast(zones.select("zone_id", "type", "local_id")), "zone_id")
    same = Window.partitionBy("session", "person_id", "local_id", "type").orderBy("stay")
    rows = rows.withColumn("left_at", F.when(F.col("type") == "INTERIOR", F.lag("end_s").over(same)))
    size = F.col("end_s") - F.col("start_s")
    shop = F.col("type") == "INTERIOR"

    def event(when, name, start, end=None, weight=None):
        return F.when(when, F.struct(F.lit(name).alias("event_type"), F.col(start).alias("start_s"), (F.col(end) if end else F.lit(None).cast("double")).alias("end_s"), (F.col("confidence") * (F.lit(1.0) if weight is None else weight)).alias("confidence")))

    found = F.array(
        event(F.col("type") == "FRONTAGE", "EXPOSURE", "start_s", "end_s"),
        event(shop, "ENTER", "start_s", None, F.when(F.col("nth") == 1, 0.5).otherwise(1.0)),
        event(shop & (F.col("start_s") - F.col("left_at") >= p.away), "RETURN", "start_s"),
        event(shop & (size >= p.dwell), "DWELL", "start_s", "end_s"),
        event(shop & (F.col("nth") < F.col("of")), "EXIT", "end_s"),
        event((F.col("type") == "COLA") & (size >= p.queue) & (F.col("median_speed") <= p.queue_speed * p.scale), "QUEUE", "start_s", "end_s"),
    )
    return rows.select("session", "person_id", "zone_id", "local_id", "stay", F.inline(F.array_compact(found)))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session", "event_type").agg(F.count("*").alias("n"))
