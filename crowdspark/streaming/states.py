"""Streaming counters with state by cell, zone, visitor or entry: a micro-batch reads and writes what it touches, not a session's whole state.

They are twins of batch forms like those of ``live``, with the same columns (``ts`` for the watermark) and the same rules: rows are
put in order of ``t``, a sample has to come whole in one micro-batch, older rows are left out, and all of a key goes once the watermark
is ``keep`` seconds past its last row. Keyed map states need the RocksDB state store; a session that names another gets it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import geometry as G
from ..operators.plans import best_entry, unit

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Touched:
    """A key's map state within a micro-batch: an entry is read when first asked for and written once, at the end, if it changed."""

    def __init__(self, state, whole: bool):
        self.state, self.changed = state, set()
        self.now = {tuple(k): tuple(v) for k, v in state.iterator()} if whole else {}

    def get(self, key: tuple) -> tuple | None:
        if key not in self.now:
            self.now[key] = self.state.getValue(key)
        return self.now[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        """``value`` for ``key``; None takes the entry away."""
        self.now[key] = value
        self.changed.add(key)

    def write(self) -> None:
        for key in self.changed:
            if self.now[key] is not None:
                self.state.updateValue(key, self.now[key])
            elif self.state.containsKey(key):
                self.state.removeKey(key)


class Samples(StatefulProcessor):
    """Runs ``step(key, t, dt, rows of that t, states)`` over a key's samples; ``dt`` is the time since the last one, 2 s at most.

    ``maps`` names the map states with their key and value schemas; those in ``whole`` are read in full each micro-batch.
    """

    def __init__(self, maps: dict[str, tuple[str, str]], step: Callable, columns: list[str], keep: float, whole: tuple[str, ...] = ()):
        self.maps, self.step, self.columns, self.keep, self.whole = maps, step, columns, keep, whole

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "last_t double, due long")
        self.states = {name: handle.getMapState(name, key, value) for name, (key, value) in self.maps.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("t", kind="stable")
        last, due = self.clock.get() or (None, None)
        held = {name: Touched(state, name in self.whole) for name, state in self.states.items()}
        out = []
        for t, sample in pdf.groupby("t", sort=True):
            if last is None or t > last:
                out += self.step(key, float(t), 0.0 if last is None else min(float(t) - last, 2.0), sample, held)
                last = float(t)
        for state in held.values():
            state.write()
        if due is not None:
            self.handle.deleteTimer(due)
        due = max(int(pdf["at_ms"].max()), timerValues.getCurrentWatermarkInMs()) + int(self.keep * 1000) + 1
        self.handle.registerTimer(due)
        self.clock.update((last, due))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.clock, *self.states.values()):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def by_sample(rows: DataFrame, keys: list[str], maps: dict[str, tuple[str, str]], step: Callable, schema: str, late: str = "10 minutes", keep: float = 3600.0, whole: tuple[str, ...] = ()) -> DataFrame:
    """What ``step`` returns over the samples of each key; see ``Samples``."""
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    watched = rows.withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    return watched.groupBy(*keys).transformWithStateInPandas(Samples(maps, step, columns, keep, whole), schema, "append", "eventTime")


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _seen(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows with a place, without those marked ``predicted``."""
    rows = rows.dropna(subset=["x", "y"])
    return rows[~rows["predicted"].fillna(False).astype(bool)] if "predicted" in rows else rows


def _ids(people: pd.Series) -> list:
    """Ids as Python values; a column of whole numbers with nulls comes as floats."""
    return [None if pd.isna(p) else int(p) if isinstance(p, float) else p for p in people.tolist()]


def stream_heat_cells(obs: DataFrame, grid: float, **options) -> DataFrame:
    """Cells that a sample touches, with their seconds, peak and visitors so far; the last row of a cell is its total."""

    def step(key, t, dt, rows, held):
        cells, visitors, here, out = held["cells"], held["visitors"], {}, []
        people = _seen(rows).sort_values(["person_id", "camera", "x", "y"]).drop_duplicates("person_id", keep="last")
        at = (np.floor(people[c].to_numpy(float) / grid).astype(int).tolist() for c in "xy")
        for p, *cell in zip(_ids(people["person_id"]), *at):
            here.setdefault(tuple(cell), []).append(p)
        for cell, ids in here.items():
            seconds, peak, visits = cells.get(cell) or (0.0, 0, 0)
            new = [p for p in ids if visitors.get((*cell, p)) is None]
            for p in new:
                visitors.put((*cell, p), (True,))
            total = (seconds + len(ids) * dt, max(peak, len(ids)), visits + len(new))
            cells.put(cell, total)
            out.append((*key, t, *cell, *total))
        return out

    maps = {"cells": ("cx int, cy int", "seconds double, peak long, visits long"), "visitors": (f"cx int, cy int, person_id {_kind(obs, 'person_id')}", "seen boolean")}
    return by_sample(obs, ["session"], maps, step, "session string, t double, cx int, cy int, seconds double, peak long, visits long", **options)


def stream_zone_occupancy(people: DataFrame, zones: list[dict], rules: dict[int, tuple[int, float]], **options) -> DataFrame:
    """Zones at each sample: people, and so far person-seconds, peak, visitors, how long the crowd of the rule lasts, alert."""

    def step(key, t, dt, rows, held):
        totals, visitors, out = held["zones"], held["visitors"], []
        rows = _seen(rows)
        x, y, ids = rows["x"].to_numpy(float), rows["y"].to_numpy(float), np.array([*_ids(rows["person_id"]), None], object)[:-1]
        for z in zones:
            zone = z["zone_id"]
            seconds, peak, since, visits = totals.get((zone,)) or (0.0, 0, None, 0)
            inside = set(ids[G.inside(x, y, z["vertices"])])
            n, (least, dwell) = len(inside), rules.get(zone, (None, None))
            new = [p for p in inside if visitors.get((zone, p)) is None]
            for p in new:
                visitors.put((zone, p), (True,))
            hit = least is not None and n >= least
            since = (t if since is None else since) if hit else None
            duration = t - since if hit else 0.0
            total = (seconds + n * dt, max(peak, n), since, visits + len(new))
            totals.put((zone,), total)
            out.append((*key, zone, t, n, total[0], total[1], total[3], duration, bool(hit and duration >= dwell)))
        return out

    maps = {"zones": ("zone_id int", "seconds double, peak long, since double, visits long"), "visitors": (f"zone_id int, person_id {_kind(people, 'person_id')}", "seen boolean")}
    return by_sample(people, ["session"], maps, step, "session string, zone_id int, t double, count long, seconds double, peak long, visits long, duration double, alert boolean", **options)


def stream_visit_matching(visits: DataFrame, ttl: float = 3600.0, threshold: float = 0.94, margin: float = 0.08, **options) -> DataFrame:
    """Exits matched to earlier entries of their business, which a match uses up; state are the entries of the last ``ttl``, each by itself."""

    def step(key, t, dt, rows, held):
        state, out = held["open"], []
        for own in [k for k, v in state.now.items() if v is not None and t - k[0] > ttl]:
            state.put(own, None)
        for n, (kind, vector, bag) in enumerate(sorted(zip(rows["kind"], rows["vector"], rows["bag"]), key=lambda r: r[0])):
            v = unit(vector)
            if kind == "entry":
                state.put((t, n), (v.tolist(), bool(bag)))
                continue
            waiting = sorted(k for k, e in state.now.items() if e is not None)
            told, used = best_entry(v, t, bag, [(k[0], *state.now[k]) for k in waiting], threshold, margin)
            if used is not None:
                state.put(waiting[used], None)
            out.append((*key, t, *told))
        return out

    maps = {"open": ("t double, n int", "vector array<double>, bag boolean")}
    return by_sample(visits, ["session", "business_id"], maps, step, "session string, business_id string, t double, matched boolean, changed boolean, similarity double", whole=("open",), **options)
