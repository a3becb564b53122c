"""One position a person and instant: merged views, no jumps, speeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_time():
    """Rows of a person in time."""
    return Window.partitionBy("session", "person_id").orderBy("t")


def consolidate(obs: DataFrame, step: float = 0.2, tick: Column | None = None, bin_epsilon: float = 0.0, dealt: bool = False) -> DataFrame:
    """Confidence-weighted mean of the views of a person in one instant, ``floor(t / step)`` unless ``tick`` is given.

    Rows are dealt out by (session, person) first, so the sum and every later window over a person reuse that; with ``dealt`` they are so already.
    """
    weight = F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(1e-3))
    bin_ = F.floor(F.col("t") / step + bin_epsilon) if tick is None else tick
    rows = obs.withColumn("tick", bin_.cast("long")).withColumn("w", weight)
    rows = rows if dealt else rows.repartition("session", "person_id")
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    return rows.groupBy("session", "person_id", "tick").agg(mean("t"), mean("x"), mean("y"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_obs"))


def drop_jumps(pos: DataFrame, v_max: float = 4.0, rounds: int = 3) -> DataFrame:
    """Drop interior points that are reached and left faster than ``v_max``, up to ``rounds`` times."""
    columns = pos.columns
    for _ in range(rounds):
        gap = lambda dt: F.greatest(dt, F.lit(1e-3))
        pace = lambda f: F.hypot(F.col("x") - f("x"), F.col("y") - f("y")) / gap(F.abs(F.col("t") - f("t")))
        before, after = pace(lambda c: F.lag(c).over(by_time())), pace(lambda c: F.lead(c).over(by_time()))
        jump = F.coalesce((before > v_max) & (after > v_max), F.lit(False))
        pos = pos.withColumn("_jump", jump).where("NOT _jump").select(*columns)
    return pos


def speed(pos: DataFrame, half: int = 2) -> DataFrame:
    """Speed by the difference of the positions ``half`` rows before and after, clipped at the ends; null for a single row."""
    back, ahead = by_time().rowsBetween(-half, 0), by_time().rowsBetween(0, half)
    first = lambda c: F.first(c).over(back)
    last = lambda c: F.last(c).over(ahead)
    dt = last("t") - first("t")
    value = F.hypot(last("x") - first("x"), last("y") - first("y")) / F.greatest(dt, F.lit(1e-3))
    alone = F.lag("t").over(by_time()).isNull() & F.lead("t").over(by_time()).isNull()
    return pos.withColumn("speed", F.when(~alone, value))


def unique_confirmed_people(obs: DataFrame) -> DataFrame:
    """People of each sample: predicted and duplicate rows do not count; rows without an id count one by one.

    Where ``confirmed`` is missing, a person is confirmed unless the id starts with T.
    """
    named = F.col("person_id").isNotNull()
    sure = F.coalesce("confirmed", ~F.col("person_id").startswith("T"), F.lit(True))
    rows = obs.where(~F.coalesce("predicted", F.lit(False)) & ~F.coalesce("duplicate", F.lit(False)) & sure)
    return rows.groupBy("session", "t").agg((F.count_distinct(F.when(named, F.col("person_id"))) + F.sum(F.when(named, 0).otherwise(1))).alias("count"))


def ranked(rows: DataFrame, order: list[str], blocks: int = 64) -> DataFrame:
    """Add i, the place of a row in its session from 0, and n, the session's rows.

    A session is cut into ``blocks`` stretches of its first order column, so that none is put in order in one piece:
    places are counted within stretches and the stretches' sizes added up (at most ``blocks`` numbers a session).
    """
    lead = F.col(order[0]).cast("double")
    span = rows.groupBy("session").agg(F.min(lead).alias("_lo"), F.max(lead).alias("_hi"), F.count("*").alias("n"))
    at = F.coalesce(F.floor(F.try_divide((lead - F.col("_lo")) * blocks, F.col("_hi") - F.col("_lo"))), F.lit(0))
    cut = rows.join(span, "session").withColumn("_block", F.least(at, F.lit(blocks - 1)).cast("int"))
    sizes = cut.groupBy("session", "_block").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("session").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.join(sizes.select("session", "_block", before.alias("_before")), ["session", "_block"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy("session", "_block").orderBy(*order)) - 1
    return cut.withColumn("i", place).drop("_lo", "_hi", "_block", "_before")


def report_series(counts: DataFrame, cap: int = 3600) -> DataFrame:
    """Every 2^k-th row of a session's series, with the least k that leaves at most ``cap`` rows."""
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / cap)))).cast("long")
    return ranked(counts, ["t"]).where(F.col("i") % step == 0).select("session", "t", "count")


def session_metrics(samples: DataFrame, obs: DataFrame) -> DataFrame:
    """From samples (session, t, people, alerts) and ``obs`` (session, person_id): person-seconds with steps of 2 s at
    most, observed seconds, rising alerts, identities, and the mean of the person-seconds over them."""
    own = Window.partitionBy("session").orderBy("t")
    dt = F.coalesce(F.least(F.greatest(F.col("t") - F.lag("t").over(own), F.lit(0.0)), F.lit(2.0)), F.lit(0.0))
    rise = F.greatest(F.lit(0), F.col("alerts") - F.lag("alerts", 1, 0).over(own))
    rows = samples.select("session", (dt * F.col("people")).alias("ps"), dt.alias("dt"), rise.alias("rise"))
    found = rows.groupBy("session").agg(F.sum("ps").alias("person_seconds"), F.sum("dt").alias("observed_s"), F.sum("rise").alias("alerts"))
    ids = obs.select("session", "person_id").distinct().groupBy("session").agg(F.count("*").alias("identities"))
    found = found.join(ids, "session", "left").withColumn("identities", F.coalesce("identities", F.lit(0)))
    return found.withColumn("mean_observed", F.col("person_seconds") / F.greatest(F.lit(1), F.col("identities")))


def metric_series(samples: DataFrame, cap: int = 3600) -> DataFrame:
    """The first sample of each second of a session, the last ``cap`` of them."""
    first = samples.groupBy("session", F.floor("t").alias("second")).agg(F.min_by(F.struct("t", "people", "alerts"), "t").alias("s"))
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("second")))
    return first.withColumn("k", rank).where(F.col("k") <= cap).select("session", "s.*")
