"""Table changes as pure functions from the old rows to the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win; of several new rows with one key an arbitrary but fixed one (largest by all columns)."""
    ranked = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), *[F.desc(c) for c in old.columns]))
    return ranked.withColumn("__rank", rank).filter("__rank = 1").drop("__new", "__rank")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key is not there yet."""
    return old.unionByName(new.select(*old.columns).join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def get_or_create(dimension: DataFrame, names: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """The dimension with the missing names added; new ids follow the largest one, in the order of the names.

    The new ids need a global order, but only over names that are new and distinct; their prefix sums are made from
    per-partition counts, so no task numbers them all.
    """
    fresh = names.select(*keys).distinct().join(dimension.select(*keys), [dimension[k].eqNullSafe(names[k]) for k in keys], "left_anti")
    top = dimension.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    ordered = cut(fresh.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()))  # counted and numbered alike
    within = ordered.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
    counts = within.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.withColumn("__before", F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")  # a row a partition
    numbered = within.join(F.broadcast(before), "__part").crossJoin(F.broadcast(top)).withColumn(id_col, (F.col("top") + F.coalesce("__before", F.lit(0)) + F.col("__row")).cast(dict(dimension.dtypes)[id_col]))
    return dimension.select(id_col, *keys).unionByName(numbered.select(id_col, *keys))


def update_where(rows: DataFrame, test: Column, **values: Column) -> DataFrame:
    """Columns set where the test is true; null tests change nothing."""
    return rows.withColumns({name: F.when(test, value).otherwise(F.col(name)) for name, value in values.items()})


def delete_by_key(rows: DataFrame, gone: DataFrame, key: str, gone_key: str) -> DataFrame:
    """M05"""
    return rows.join(gone.select(F.col(gone_key).alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def mark_parents(parents: DataFrame, changed: DataFrame, parent_key: str, flag: str, value: Column | None = None) -> DataFrame:
    """The flag set on rows that have a changed child."""
    hit = changed.select(F.col(parent_key).alias("__hit")).distinct()
    marked = parents.join(hit, F.col("id") == F.col("__hit"), "left")
    return marked.withColumn(flag, F.when(F.col("__hit").isNotNull(), F.lit(True) if value is None else value).otherwise(F.col(flag))).drop("__hit")


def retained(rows: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """Rows no older than so many days before now."""
    return rows.filter(F.col(time) >= now - F.make_dt_interval(F.lit(days)))


def reparented(tags: DataFrame, tag_id: int, parent_id: int | None) -> DataFrame:
    """The tag under another parent, and its whole subtree's paths rewritten."""
    from .hierarchy import below, rerooted

    moved = tags.filter(F.col("id") == tag_id).select(F.col("path").alias("__old"), F.regexp_extract("path", r"[^.]+$", 0).alias("__last"))
    if parent_id is None:
        moved = moved.withColumn("__new", F.col("__last"))
    else:
        moved = moved.crossJoin(tags.filter(F.col("id") == parent_id).select(F.col("path").alias("__top"))).withColumn("__new", F.concat_ws(".", "__top", "__last"))
    inside = below(F.col("path"), F.col("__old"))
    joined = tags.join(F.broadcast(moved.select("__old", "__new")), inside, "left")  # one row
    path = F.when(F.col("__old").isNotNull(), rerooted(F.col("path"), F.col("__old"), F.col("__new"))).otherwise(F.col("path"))
    parent = F.when(F.col("id") == tag_id, F.lit(parent_id).cast("int")).otherwise(F.col("parent_id"))
    return joined.withColumns({"path": path, "parent_id": parent}).drop("__old", "__new")


def conflicts(faces: DataFrame, proposed: DataFrame, exempt: DataFrame) -> DataFrame:
    """Proposed (id, photo_id, person_tag_id) that meet another confirmed face of that person in the photo.

    exempt: ids of persons that may stand in one photo more than once (X36)."""
    there = faces.filter(F.col("status") == "confirmed").select(F.col("id").alias("other"), F.col("photo_id").alias("p"), F.col("person_tag_id").alias("t"))
    hit = (F.col("photo_id") == F.col("p")) & (F.col("person_tag_id") == F.col("t")) & (F.col("id") != F.col("other"))
    return proposed.join(there, hit, "left_semi").join(exempt.select(F.col("id").alias("free")), F.col("person_tag_id") == F.col("free"), "left_anti")


def refreshed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Incoming values overwrite only where they are not null."""
    named = new.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = old.join(named, key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*old.columns)


def merged_person(faces: DataFrame, from_id: int, to_id: int) -> DataFrame:
    """D23"""
    return update_where(faces, F.col("person_tag_id") == from_id, person_tag_id=F.lit(to_id))
