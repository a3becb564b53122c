"""Streaming twins of the live counters: the rules of the batch forms, one sample after the other, in keyed state.

Every function takes a stream with ``ts`` (event time, for the watermark) beside the columns of its batch form and gives
out rows as samples come in. Rows of a micro-batch are put in order of ``t`` first; a sample has to come whole in one
micro-batch, and rows older than what a key has seen are left out, as is what the watermark has passed. State is a JSON
text by key and goes once the watermark is ``keep`` past its last row. Counters whose state grows with cells, visitors or entries
are in ``states``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[tuple, dict, float, pd.DataFrame], list]


def by_sample(rows: DataFrame, keys: list[str], step: Step, schema: str, late: str = "10 minutes", keep: float = 3600.0, closing: Callable[[tuple, dict], list] | None = None, strict: bool = True) -> DataFrame:
    """Run ``step(key, state, t, rows of that t)`` over the samples of each key; what it returns are output rows.

    ``state`` is a dict that JSON can hold, empty at first; it keeps ``last_t`` of itself. ``closing`` gives rows when
    the state of a key goes. With ``strict`` a sample at the time of the last one is left out too.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        if held.hasTimedOut:
            held.remove()
            out = closing(key, state) if closing else []
        else:
            pdf, out = pd.concat(list(batches)).sort_values("t", kind="stable"), []
            for t, sample in pdf.groupby("t", sort=True):
                last = state.get("last_t")
                if last is None or t > last or (t == last and not strict):
                    out += step(key, state, float(t), sample)
                    state["last_t"] = float(t)
            held.update((json.dumps(state),))
            held.setTimeoutTimestamp(max(int(pdf["ts"].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + int(keep * 1000) + 1)
        yield pd.DataFrame(out, columns=names)

    watched = rows.withWatermark("ts", late)
    return watched.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def _step(state: dict, t: float) -> float:
    """Time since the last sample, 2 s at most."""
    return min(max(t - state["last_t"], 0.0), 2.0) if "last_t" in state else 0.0


def stream_crowd_clusters(obs: DataFrame, radius: float, least: int, dwell: float = 10.0, **options) -> DataFrame:
    """Crowds of each sample, carried on from those of the sample before."""

    def step(key, state, t, rows):
        x, y = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        count = (np.hypot(x[:, None] - x, y[:, None] - y) <= radius).sum(axis=1)
        before, current, out = state.get("circles", []), [], []
        for n, a, b in sorted(zip(count.tolist(), x.tolist(), y.tolist()), reverse=True):
            if n >= least and all(np.hypot(a - c, b - d) >= radius for c, d, _ in current):
                near = [(float(np.hypot(a - c, b - d)), i) for i, (c, d, _) in enumerate(before) if np.hypot(a - c, b - d) <= radius]
                since = before.pop(min(near)[1])[2] if near else t
                current.append([a, b, since])
                out.append((*key, t, a, b, n, since, t - since, t - since >= dwell))
        state["circles"] = current
        return out

    return by_sample(obs, ["session"], step, "session string, t double, x double, y double, count long, since double, duration double, alert boolean", **options)


def stream_camera_counting(counts: DataFrame, interval: float, **options) -> DataFrame:
    """Totals of a camera after each sample; the last row is what the batch form gives."""

    def step(key, state, t, rows):
        n = int(rows["n"].iloc[0])
        dt = t - state["last_t"] if "last_t" in state else 0.0
        dt = dt if dt <= 1.5 * interval else 0.0
        state["seconds"] = state.get("seconds", 0.0) + state.get("n", 0) * dt
        state["observed"] = state.get("observed", 0.0) + dt
        if "peak" not in state or n > state["peak"]:
            state["peak"], state["peak_at"] = n, t
        state["n"] = n
        return [(*key, t, n, state["peak"], state["peak_at"], state["seconds"], state["observed"])]

    return by_sample(counts, ["session", "camera"], step, "session string, camera string, t double, count long, peak long, peak_at double, person_seconds double, observed_s double", **options)


def stream_crowd_episodes(counts: DataFrame, threshold: int, dwell: float, interval: float, reason: str = "fin", **options) -> DataFrame:
    """Episodes as they close; those still open when their state goes close with ``reason``."""

    def close(key, state, end, why):
        done = state.pop("run", None)
        return [(*key, done["since"], done["confirmed"], end, done["peak"], end - done["since"], why)] if done and done["confirmed"] is not None else []

    def step(key, state, t, rows):
        n, out = int(rows["n"].iloc[0]), []
        if "last_t" in state and t - state["last_t"] > 1.5 * interval:
            out += close(key, state, state["last_t"], "interrupción")
        if n < threshold:
            return out + close(key, state, t, "umbral despejado")
        run = state.setdefault("run", {"since": t, "confirmed": None, "peak": 0})
        run["peak"] = max(run["peak"], n)
        if run["confirmed"] is None and t - run["since"] >= dwell:
            run["confirmed"] = t
        return out

    schema = "session string, camera string, start double, confirmed double, end double, peak long, duration double, reason string"
    return by_sample(counts, ["session", "camera"], step, schema, closing=lambda key, state: close(key, state, state["last_t"], reason), **options)


def stream_zone_flow(pos: DataFrame, gap: float = 1.0, **options) -> DataFrame:
    """Entries and exits that two observations in a row confirm."""

    def step(key, state, t, rows):
        inside = bool(rows["inside"].iloc[0])
        if "last_t" not in state or t - state["last_t"] > gap:
            state.update(value=None, run=0, known=inside)
        state["run"] = state["run"] + 1 if state["value"] == inside else 1
        state["value"] = inside
        if state["run"] != 2:
            return []
        before, state["known"] = state["known"], inside
        return [(*key, t, "entry" if inside else "exit")] if before != inside else []

    return by_sample(pos, ["session", "zone_id", "person_id"], step, "session string, zone_id int, person_id long, t double, direction string", **options)


def stream_session_metrics(samples: DataFrame, **options) -> DataFrame:
    """Person-seconds, observed seconds and rising alerts of a session after each sample (session, t, people, alerts)."""

    def step(key, state, t, rows):
        dt, people, alerts = _step(state, t), int(rows["people"].iloc[0]), int(rows["alerts"].iloc[0])
        state["ps"], state["s"] = state.get("ps", 0.0) + dt * people, state.get("s", 0.0) + dt
        state["rises"] = state.get("rises", 0) + max(0, alerts - state.get("alerts", 0))
        state["alerts"] = alerts
        return [(*key, t, state["ps"], state["s"], state["rises"])]

    return by_sample(samples, ["session"], step, "session string, t double, person_seconds double, observed_s double, alerts long", **options)


def stream_size_filter(boxes: DataFrame, sure: float = 0.6, share: float = 0.62, last: int = 60, least: int = 3, **options) -> DataFrame:
    """Boxes (session, camera, t, track, h, score, border) with ``keep``, against the camera's last sure heights."""

    def step(key, state, t, rows):
        good = rows[rows["score"] >= sure].sort_values("track")
        heights = state["heights"] = (state.get("heights", []) + good["h"].tolist())[-last:]
        usual = float(np.median(heights)) if len(heights) >= least else None
        small = (rows["score"] < sure) & ~rows["border"] & (False if usual is None else rows["h"] < share * usual)
        return [(*key, t, track, not s) for track, s in zip(rows["track"].tolist(), small.tolist())]

    return by_sample(boxes, ["session", "camera"], step, "session string, camera string, t double, track long, keep boolean", **options)


def stream_static_clutter(tracks: DataFrame, age: float = 2.0, still: float = 8.0, score: float = 0.6, **options) -> DataFrame:
    """Tracks (session, camera, t, track, u, v, w, score, border) with ``suppressed``; one that misses a sample starts anew."""

    def step(key, state, t, rows):
        held, now, out = state.get("tracks", {}), {}, []
        for r in rows.itertuples():
            own = held.get(str(r.track)) or {"u": r.u, "v": r.v, "clock": t, "far": 0.0, "sum": 0.0, "n": 0}
            own["clock"] = t if r.border else own["clock"]
            own["far"] = max(own["far"], float(np.hypot(r.u - own["u"], r.v - own["v"])))
            own["sum"], own["n"] = own["sum"] + r.score, own["n"] + 1
            now[str(r.track)] = own
            quiet = t - own["clock"] >= age - 1e-9 and own["far"] < max(still, 0.25 * r.w) and own["sum"] / own["n"] < score
            out.append((*key, t, r.track, bool(quiet)))
        state["tracks"] = now
        return out

    return by_sample(tracks, ["session", "camera"], step, "session string, camera string, t double, track long, suppressed boolean", **options)
