"""Recordings: JSON lines of samples, manifests, and the tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.trajectories import ranked

SAMPLE = "t DOUBLE, cameras ARRAY<STRUCT<id: STRING, t: DOUBLE, people: ARRAY<STRUCT<id: STRING, local: INT, box: ARRAY<DOUBLE>, pixel: ARRAY<DOUBLE>, point: ARRAY<DOUBLE>, association: STRING, confirmed: BOOLEAN, duplicate: BOOLEAN, predicted: BOOLEAN>>>>"
MANIFEST = "session STRING, status STRING, module STRING, created TIMESTAMP, `end` DOUBLE, projectId STRING, config STRUCT<testRun: BOOLEAN, sourceMode: STRING, recordingStartedAt: STRING, planId: STRING>"


def read_samples(spark: SparkSession, path: str, files: str = "*/samples.jsonl", session: str = "([^/]+)/samples.jsonl$") -> DataFrame:
    """(session, ordinal, sample) of ``<path>/<session>/samples.jsonl``; sample is null for a broken line.

    Lines keep their order within a file by the place of their block and their row in it. ``files`` and ``session``
    tell other layouts: which files, and the pattern of a session's name in their path.
    """
    lines = spark.read.text(f"{path}/{files}").select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    parsed = F.from_json("value", SAMPLE)
    rows = lines.select(F.regexp_extract("f", session, 1).alias("session"), F.struct("f", "block", "row").alias("ordinal"), parsed.alias("sample"))
    return rows.withColumn("sample", F.when(F.col("sample.t").isNotNull() & F.col("sample.cameras").isNotNull(), F.col("sample")))


def before_first_bad(samples: DataFrame) -> DataFrame:
    """Lines of each session up to its first broken one."""
    # Broken lines are few; no session is put in order in one task.
    bad = samples.where("sample IS NULL").groupBy(F.col("session").alias("_session")).agg(F.min("ordinal").alias("_bad"))
    rows = samples.join(bad, samples["session"] == F.col("_session"), "left")
    return rows.where("_bad IS NULL OR ordinal < _bad").drop("_bad", "_session")


def read_recordings(spark: SparkSession, path: str, mode: str = "stop_at_bad", **layout: str) -> DataFrame:
    """Observations: one row a person and sample that has a plan point and is not marked unconfirmed, with box, pixel and the line's place.

    ``ordinal`` puts the lines of a session in order; u and v are the pixel, x1 to y2 the box, null where a recording has none.

    ``stop_at_bad`` ends a file at its first broken line, ``skip_bad`` leaves broken lines out.
    """
    samples = read_samples(spark, path, **layout)
    samples = before_first_bad(samples) if mode == "stop_at_bad" else samples.where("sample IS NOT NULL")
    people = samples.select("session", "ordinal", "sample.t", F.explode("sample.cameras").alias("c")).select("session", "ordinal", "t", F.col("c.id").alias("camera"), F.explode("c.people").alias("p"))
    rows = people.where("p.point IS NOT NULL AND coalesce(p.confirmed, true)")
    at = lambda c, i: F.get(f"p.{c}", F.lit(i))
    return rows.select("session", "camera", "t", F.col("p.id").alias("person_id"), "p.local", at("point", 0).alias("x"), at("point", 1).alias("y"), at("pixel", 0).alias("u"), at("pixel", 1).alias("v"), *(at("box", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), "ordinal", "p.association", "p.confirmed", "p.duplicate", "p.predicted")


#: What tells where a camera's pictures come from or opens it; such keys leave a configuration at its top and in each camera.
SECRETS = ("source", "sourcePath", "url", "rtsp", "user", "username", "password", "token", "secret")


def _public(config: Column) -> Column:
    """A configuration (map of VARIANT) without secrets, as one VARIANT."""
    open_ = lambda m: F.map_filter(m, lambda k, _: ~k.isin(*SECRETS))
    cameras = F.transform(F.from_json(F.to_json(config["cameras"]), "array<map<string, variant>>"), open_)
    rest = F.map_filter(open_(config), lambda k, _: k != "cameras")
    whole = F.when(cameras.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit("cameras"), F.parse_json(F.to_json(cameras)))))
    return F.parse_json(F.to_json(whole))


#: Ends a manifest in a file of many (the record separator of JSON text sequences); JSON text can't hold it.
RECORD_END = "\x1e"


def read_manifests(spark: SparkSession, path: str, files: str = "*/manifest.json", record_end: str | None = None) -> DataFrame:
    """One row a session, with its ``config`` and ``identity`` as VARIANT columns, to be asked by path with ``variant_get``.

    A file is one manifest, or many, each ended by ``record_end``: with very many sessions, opening a file each takes most of the time.

    Sources and secrets (SECRETS) are cut out of the configuration and of its cameras. A file that is no JSON object gives no row.
    """
    text = spark.read.text(f"{path}/{files}", wholetext=record_end is None, lineSep=record_end)
    loose = F.from_json("value", "config map<string, variant>, identity variant")
    rows = text.select(F.from_json("value", MANIFEST).alias("m"), loose.alias("o")).where("m.session IS NOT NULL").select("m.*", _public(F.col("o.config")).alias("_config"), F.col("o.identity").alias("_identity"))
    return rows.select("session", F.col("projectId").alias("project_id"), "module", "status", "created", F.col("end").alias("end_s"), F.col("config.testRun").alias("test_run"), F.col("config.sourceMode").alias("source_mode"), F.col("config.recordingStartedAt").alias("recording_started_at"), F.col("_config").alias("config"), F.col("_identity").alias("identity"))


def session_history(sessions: DataFrame, project_id: str | None, n: int = 50) -> DataFrame:
    """The newest sessions of a project, or of none."""
    return sessions.where(F.col("project_id").eqNullSafe(F.lit(project_id))).orderBy(F.desc("created"), "session").limit(n)


def recover_interrupted(sessions: DataFrame, samples: DataFrame) -> DataFrame:
    """Sessions left running become errors that end at their last time before the first broken line."""
    last = before_first_bad(samples).groupBy("session").agg(F.max_by("sample.t", "ordinal").alias("last"))
    running = F.col("status") == "running"
    rows = sessions.join(last, "session", "left")
    return rows.select("session", F.when(running, "error").otherwise(F.col("status")).alias("status"), F.when(running, F.coalesce("last", F.lit(0.0))).otherwise(F.col("end_s")).alias("end_s"))


def last_sample(samples: DataFrame) -> DataFrame:
    """Last readable sample of each session."""
    return samples.where("sample IS NOT NULL").groupBy("session").agg(F.max_by("sample", "ordinal").alias("sample")).select("session", "sample.t", F.size("sample.cameras").alias("cameras"))


def thin_samples(samples: DataFrame, full: int = 300, slack: int = 100) -> DataFrame:
    """Index, step and whether a sample keeps its full analysis: all of a short session, else every step-th and the last."""
    rows = ranked(samples, ["t"])
    step = F.when(F.col("n") > full + slack, F.ceil(F.col("n") / full)).otherwise(1).cast("long")
    return rows.withColumn("step", step).withColumn("keep_full", (F.col("i") % F.col("step") == 0) | (F.col("i") == F.col("n") - 1))


def map_catalog_to_businesses(features: DataFrame, references: DataFrame, prefix: str = "map") -> DataFrame:
    """Named shops and restaurants of a map (feature_id, name, class, x, y) that have no reference yet.

    Names that recur get `` (local i)``, i by feature_id as text.
    """
    named = features.where(F.col("class").isin("retail", "food_and_drink") & (F.trim("name") != ""))
    own = Window.partitionBy("name")
    i = F.row_number().over(own.orderBy(F.col("feature_id").cast("string")))
    rows = named.withColumn("label", F.when(F.count("*").over(own) > 1, F.format_string("%s (local %d)", "name", i)).otherwise(F.col("name")))
    return rows.join(references, "feature_id", "left_anti").select(F.format_string(f"{prefix}-%d-%s", F.floor("x").cast("int"), F.col("feature_id").cast("string")).alias("business_id"), F.col("label").alias("name"), "feature_id", "x", "y")


def rewrite_final_ids(obs: DataFrame, numbers: DataFrame) -> DataFrame:
    """Observations with the final number of their tracklet: P%05d and confirmed, or not confirmed where there is none.

    Rows without ``local``, set by hand, or named M* or U* stay as they are. ``numbers`` has session, camera, local, t, public_id.
    """
    rows = obs.join(numbers, ["session", "camera", "local", "t"], "left")
    fixed = F.col("local").isNull() | F.coalesce(F.col("association") == "manual", F.lit(False)) | F.coalesce(F.col("person_id").rlike("^[MU]"), F.lit(False))
    named = F.col("public_id").isNotNull()
    return rows.select("session", "camera", "local", "t", F.when(fixed | ~named, F.col("person_id")).otherwise(F.format_string("P%05d", "public_id")).alias("person_id"), F.when(fixed, F.col("confirmed")).otherwise(named).alias("confirmed"))
