"""Counts, timelines, duplicate groups and other summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """A02, A10, A11, A17, A24"""
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def timeline(photos: DataFrame) -> DataFrame:
    """Month counts with their year's total, from one aggregate; the window runs over months, not photos."""
    months = photos.filter(F.col("taken_at").isNotNull()).groupBy(F.year("taken_at").alias("year"), F.month("taken_at").alias("month")).agg(F.count("*").alias("n"))
    return months.withColumn("year_total", F.sum("n").over(Window.partitionBy("year")))


def duplicate_groups(rows: DataFrame, key: str, size: str, least: int = 2) -> DataFrame:
    """Key, copies, largest, wasted bytes of the groups of at least `least` rows."""
    groups = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"), F.max(size).alias("largest"))
    return groups.filter(F.col("copies") >= least).withColumn("wasted", (F.col("copies") - 1) * F.col("largest"))


def duplicate_stats(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Rows, hashed rows, groups, wasted bytes; two small aggregates side by side."""
    whole = rows.agg(F.count("*").alias("n_rows"), F.count(key).alias("n_hashed"))
    groups = duplicate_groups(rows, key, size).agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))
    return whole.crossJoin(F.broadcast(groups))


def with_total(rows: DataFrame, page: DataFrame) -> DataFrame:
    """The page's rows with the number of all rows, by an aggregate instead of a window without partitions."""
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def first_of(rows: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n).drop("__rank")


def runner_up(votes: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """The best row of each group with the second-best score, 0 where there is none."""
    window = Window.partitionBy(*keys).orderBy(F.desc(score), name)
    ranked = votes.withColumns({"runner_up": F.coalesce(F.lead(score).over(window), F.lit(0.0)), "__rank": F.row_number().over(window)})
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def votes(neighbours: DataFrame, face: str, person: str, score: str) -> DataFrame:
    """A13"""
    return neighbours.groupBy(face, person).agg(F.count("*").alias("votes"), F.max(score).alias("score"))


def merged_metadata(members: DataFrame, key: str) -> DataFrame:
    """Of each group all tags, the largest rating, the first colour that is set by position."""
    colored = F.when(F.col("color_label").isNotNull() & (F.col("color_label") != 0), F.struct("position", "color_label"))
    return members.groupBy(key).agg(F.max("rating").alias("rating"), F.min(colored)["color_label"].alias("color_label"))


def locations(photos: DataFrame, decimals: int = 4) -> DataFrame:
    """A26"""
    known = photos.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return known.groupBy(F.round("latitude", decimals).alias("lat"), F.round("longitude", decimals).alias("lon")).agg(F.count("*").alias("n"))


def property_choice(properties: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Of each (image, tag) the property of the lowest rank; unknown properties come last."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col("property")), F.lit(len(ranks) + 1))
    return properties.groupBy("image_id", "tag_id").agg(F.min_by(F.struct("property", "value"), F.struct(rank, "property", "value")).alias("chosen")).select("image_id", "tag_id", "chosen.*")


def histogram(values: DataFrame, value: str, buckets: int = 256) -> DataFrame:
    """Counts of the buckets of values in [0, 1], and the share of all values in each."""
    bucket = F.least(F.greatest(F.floor(F.col(value) * buckets), F.lit(0)), F.lit(buckets - 1)).alias("bucket")
    counts = values.filter(F.col(value).isNotNull()).groupBy(bucket).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("bucket", "n", (F.col("n") / F.col("all")).alias("share"))
