"""Quality audit and cleaning of point annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["split", "image"]


def annotation_totals(points: DataFrame) -> DataFrame:
    """Points of each split and of all (split null)."""
    return points.rollup("split").agg(F.count("*").alias("points"))


def oob_distance(x: Column, y: Column, width: Column, height: Column) -> Column:
    """How far a point lies outside the image, the larger of both axes; 0 inside and on the far edge."""
    over = lambda v, most: F.greatest(-v, v - most, F.lit(0.0))
    return F.greatest(over(x, width), over(y, height))


def oob_severity(distance: Column) -> Column:
    """Distance above 0 by degree; a point on the far edge is none. Cleaning is stricter: see ``inside``."""
    return F.when(distance <= 0, None).when(distance <= 5, "minor").when(distance <= 50, "moderate").otherwise("severe")


def inside(x: Column, y: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def _located(points: DataFrame, images: DataFrame) -> DataFrame:
    return points.join(images, KEY).withColumn("distance", oob_distance(*map(F.col, ("x", "y", "width", "height"))))


def severity_counts(points: DataFrame, images: DataFrame) -> DataFrame:
    rows = _located(points, images).withColumn("severity", oob_severity(F.col("distance"))).where("severity IS NOT NULL")
    return rows.groupBy("split", "severity").agg(F.count("*").alias("points"), F.count_distinct("image").alias("images"))


def audit_issues(images: DataFrame, points: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One status an image, the first that holds: quarantined, corrupted, missing_annotation, bad_format, out_of_bounds, ok."""
    bad = _located(points, images).where("distance > 0").groupBy(*KEY).agg(F.count("*").alias("n"))
    rows = images.join(quarantine.select(*KEY).distinct().withColumn("q", F.lit(True)), KEY, "left").join(bad, KEY, "left")
    status = F.when(F.col("q"), "quarantined").when(~F.col("readable"), "corrupted").when(~F.col("has_annotation"), "missing_annotation").when(~F.col("format_ok"), "bad_format").when(F.col("n") > 0, "out_of_bounds").otherwise("ok")
    return rows.select(*KEY, status.alias("issue"), F.when(status == "out_of_bounds", F.col("n")).otherwise(0).alias("count"))


def audit_by_issue(images: DataFrame, points: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Images and points of each issue and split."""
    return audit_issues(images, points, quarantine).groupBy("split", "issue").agg(F.count("*").alias("images"), F.sum("count").alias("points"))


def audit_dataset(images: DataFrame, points: DataFrame, quarantine: DataFrame) -> DataFrame:
    """The summary row: images, annotations read, their points, images by what keeps them out, and points outside by degree."""
    status = audit_issues(images, points, quarantine).select(*KEY, "issue")
    of = lambda *k: F.col("issue").isin(*k)
    total = lambda on, name: F.coalesce(F.sum(on.cast("long")), F.lit(0)).alias(name)
    read = of("ok", "out_of_bounds")
    kinds = (("quarantined", "quarantined_images"), ("corrupted", "corrupted_images"), ("missing_annotation", "missing_annotations"), ("bad_format", "invalid_annotation_format"), ("out_of_bounds", "images_with_oob_points"))
    first = status.agg(F.count("*").alias("images"), total(read, "annotation_files"), *(total(of(k), n) for k, n in kinds))
    d = F.col("distance")
    second = _located(points, images).join(status.where(read).select(*KEY), KEY, "left_semi").agg(F.count("*").alias("total_points"), total(d > 0, "oob_points"), total((d > 0) & (d <= 5), "oob_le_5px"), total((d > 5) & (d <= 50), "oob_5_to_50px"), total(d > 50, "oob_gt_50px"))
    return first.crossJoin(second)  # one row each


def rank_oob(images: DataFrame, points: DataFrame, quarantine: DataFrame | None = None, beyond: float = 0.0, top: int = 20) -> DataFrame:
    """Images with most points further outside than ``beyond``; quarantined ones left out where a list is given."""
    rows = _located(points, images)
    if quarantine is not None:
        rows = rows.join(quarantine.select(*KEY), KEY, "left_anti")
    found = rows.where(F.col("distance") > beyond).groupBy(*KEY).agg(F.count("*").alias("points"), F.max("distance").alias("worst"))
    return found.orderBy(F.desc("points"), *KEY).limit(top)


def clean_annotations(images: DataFrame, points: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Points inside their image, of images that are not quarantined."""
    rows = points.join(images.select(*KEY, "width", "height"), KEY).join(quarantine.select(*KEY), KEY, "left_anti")
    return rows.where(inside(*map(F.col, ("x", "y", "width", "height")))).select(*KEY, "x", "y")


def cleaning_manifest(images: DataFrame, points: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Status and counts of each image: quarantined (null counts), cleaned or valid."""
    rows = points.join(images.select(*KEY, "width", "height"), KEY).groupBy(*KEY).agg(F.count("*").alias("before"), F.sum(inside(*map(F.col, ("x", "y", "width", "height"))).cast("long")).alias("after"))
    all_ = images.select(*KEY).join(rows, KEY, "left").join(quarantine.select(*KEY).distinct().withColumn("q", F.lit(True)), KEY, "left")
    count = lambda c: F.when(F.col("q").isNull(), F.coalesce(F.col(c), F.lit(0)))
    status = F.when(F.col("q"), "quarantined").when(count("after") < count("before"), "cleaned").otherwise("valid")
    return all_.select(*KEY, status.alias("status"), count("before").alias("before"), count("after").alias("after"))


def audit_processed(images: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Images, points, and points still outside, of a cleaned set."""
    rows = cleaned.join(images.select(*KEY, "width", "height"), KEY)
    outside = (~inside(*map(F.col, ("x", "y", "width", "height")))).cast("long")
    return rows.groupBy("split").agg(F.count_distinct("image").alias("images"), F.count("*").alias("points"), F.sum(outside).alias("outside"))


def qa_after_quarantine(images: DataFrame, points: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Severity counts without quarantined images, beside how many images those are."""
    kept = points.join(quarantine.select(*KEY), KEY, "left_anti")
    excluded = quarantine.groupBy("split").agg(F.count_distinct("image").alias("excluded"))
    return severity_counts(kept, images).join(excluded, "split", "left")
