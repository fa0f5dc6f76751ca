"""Trees held as dotted or slashed paths, or as parent ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut


def below(path: Column, top: Column, separator: str = ".") -> Column:
    """Descendant or self."""
    return (path == top) | F.startswith(path, F.concat(top, F.lit(separator)))


def subtree(tags: DataFrame, tag_id: int) -> DataFrame:
    """Tags of the subtree of one tag; none for an unknown id. The one root row is a broadcast."""
    top = tags.filter(F.col("id") == tag_id).select(F.col("path").alias("__top")).limit(1)
    return tags.join(F.broadcast(top), below(F.col("path"), F.col("__top"))).drop("__top")


def rerooted(path: Column, old: Column, new: Column) -> Column:
    """The path with its old top replaced."""
    return F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))


def prefixes(path: Column, separator: str = "/") -> Column:
    """All ancestors-or-self of a path, shortest first."""
    parts = F.filter(F.split(path, separator), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def rollup_paths(rows: DataFrame, path_col: str) -> DataFrame:
    """Path, parent, depth, own, total. Counts are made before paths are spread, so only distinct paths explode."""
    own = rows.groupBy(F.col(path_col).alias("leaf")).agg(F.count("*").alias("n"))
    spread = own.select("leaf", "n", F.explode(prefixes(F.col("leaf"))).alias("path"))
    clean = F.array_join(F.filter(F.split("leaf", "/"), lambda p: p != ""), "/")
    totals = spread.groupBy("path").agg(F.sum("n").alias("total"), F.sum(F.when(clean == F.col("path"), F.col("n")).otherwise(0)).alias("own"))
    parts = F.split("path", "/")
    return totals.select("path", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).alias("parent"), F.size(parts).cast("long").alias("depth"), "own", "total")


def children(tags: DataFrame) -> DataFrame:
    """Every tag with its number of children and its parent's name."""
    parents = tags.select(F.col("id").alias("up_id"), F.col("name").alias("parent_name"))
    counts = tags.groupBy(F.col("parent_id").alias("of_id")).agg(F.count("*").alias("n_children"))
    joined = tags.join(parents, F.col("parent_id") == F.col("up_id"), "left").join(counts, F.col("id") == F.col("of_id"), "left")
    return joined.select("id", "name", "parent_name", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


def chains(rows: DataFrame, separator: str = ".") -> DataFrame:
    """id, path, top, depth of every row (id, parent_id, label, top) that hangs from a root: labels and top along its ancestors.

    Each row holds the stretch of labels down from an ancestor, and in each round puts that ancestor's own stretch before
    it, so rounds grow with the logarithm of the depth, however deep. A row whose ancestors end in an id that is not
    there is left out; a cycle is an error.
    """
    held = cut(rows.select("id", F.col("parent_id").alias("up"), F.col("label").alias("path"), "top", F.lit(1).cast("long").alias("depth")))
    most = held.count()
    while not held.filter("up IS NOT NULL").isEmpty():
        before = held.select(F.col("id").alias("at"), F.col("up").alias("next"), F.col("path").alias("above"), F.col("top").alias("high"), F.col("depth").alias("more"))
        both = held.join(before, F.col("up") == F.col("at"), "left").filter("up IS NULL OR at IS NOT NULL")
        root = F.col("up").isNull()
        held = cut(both.select("id", "next", F.when(root, F.col("path")).otherwise(F.concat("above", F.lit(separator), "path")).alias("path"), F.when(root, F.col("top")).otherwise(F.col("high")).alias("top"), F.when(root, F.col("depth")).otherwise(F.col("depth") + F.col("more")).alias("depth")).withColumnRenamed("next", "up"))
        if not held.filter(F.col("depth") > most).isEmpty():
            raise ValueError("the parents form a cycle")
    return held.drop("up")


def depths(tags: DataFrame) -> DataFrame:
    """Id, root, depth of every tag below a root."""
    return chains(tags.select("id", "parent_id", F.lit("").alias("label"), F.col("name").alias("top")), "").select("id", F.col("top").alias("root"), "depth")


def persons(tags: DataFrame, roots: tuple[str, ...] = ("people", "_people", "persons")) -> DataFrame:
    """Tags below a root of one of these names."""
    return depths(tags).filter(F.lower("root").isin(*roots) & (F.col("depth") > 1)).select("id", "depth")


# Interval labels ----------------------------------------------------------------------------------------------------------


def _next_sibling(tags: DataFrame) -> DataFrame:
    """id, sibling: the next child of the same parent by id, null behind the last.

    Rows lie in one order of (parent, id) by ranges, so a parent of any number of children is spread over tasks; the
    first row of each range is what the last row of the range before looks at.
    """
    keys = ["up", "id"]
    rows = tags.select(F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("up"))
    ordered = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    window = Window.partitionBy("part").orderBy(*keys)
    within = ordered.select("*", F.lead("id").over(window).alias("next_id"), F.lead("up").over(window).alias("next_up"))
    heads = ordered.groupBy("part").agg(F.min(F.struct(F.col("up").isNotNull().alias("n"), "up", "id")).alias("h"))  # a row a partition, nulls first as sorted
    behind = heads.select("part", F.lead("h").over(Window.orderBy("part")).alias("h")).select("part", F.col("h.id").alias("head_id"), F.col("h.up").alias("head_up"))
    joined = within.join(F.broadcast(behind), "part", "left")
    last = F.col("next_id").isNull()
    up, other = F.when(last, F.col("head_up")).otherwise(F.col("next_up")), F.when(last, F.col("head_id")).otherwise(F.col("next_id"))
    return joined.select("id", "up", F.when(other.isNotNull() & up.eqNullSafe(F.col("up")), other).alias("sibling"))


def interval_labels(tags: DataFrame) -> DataFrame:
    """id, pre, post of every tag that hangs from a root: numbers of its entry and exit on a walk around the tree.

    A tag lies in another's subtree if its pre lies between the other's pre and post. The walk goes into children in
    the order of their ids and from root to root. Its steps (two a tag) are ranked by pointer jumping: each step knows
    one further on and how far that is, and in every round takes over what that one knows, so rounds grow with
    the logarithm of the number of tags, however deep or broad the tree. Tags below an id that is not there, or on a
    cycle, have no number.
    """
    sides = _next_sibling(tags)
    first = tags.groupBy(F.col("parent_id").cast("long").alias("of")).agg(F.min("id").cast("long").alias("child"))
    both = sides.join(first, F.col("id") == F.col("of"), "left")
    # A step is 2 id for the entry and 2 id + 1 for the exit.
    enter = both.select((2 * F.col("id")).alias("step"), F.coalesce(2 * F.col("child"), 2 * F.col("id") + 1).alias("next"))
    leave = both.select((2 * F.col("id") + 1).alias("step"), F.coalesce(2 * F.col("sibling"), 2 * F.col("up") + 1).alias("next"))
    held = cut(enter.union(leave).withColumn("far", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")))
    n = held.count()
    rounds = max(1, n).bit_length()
    for _ in range(rounds):
        ahead = held.select(F.col("step").alias("at"), F.col("next").alias("then"), F.col("far").alias("more"))
        going = held.filter("next IS NOT NULL").join(ahead, F.col("next") == F.col("at"))  # a step that leads to none that is there goes
        held = cut(held.filter("next IS NULL").union(going.select("step", "then", F.col("far") + F.col("more"))))
        if held.filter("next IS NOT NULL").isEmpty():
            break
    ranked = held.filter("next IS NULL").select("step", (n - 1 - F.col("far")).alias("place"))
    of = F.floor(F.col("step") / 2)
    return ranked.groupBy(of.cast("long").alias("id")).agg(F.min("place").alias("pre"), F.max("place").alias("post"), F.count("*").alias("k")).filter("k = 2").drop("k")


def write_labelled(tags: DataFrame, path: str) -> None:
    """The tags with pre and post, in files that are ranges of pre."""
    labels = interval_labels(tags).withColumnRenamed("id", "of")
    tags.join(labels, tags["id"].cast("long") == F.col("of")).drop("of").repartitionByRange("pre").sortWithinPartitions("pre").write.parquet(path)


def labelled_subtree(spark: SparkSession, path: str, tag_id: int) -> DataFrame:
    """Tags of the subtree of one tag from a labelled table, by a range that reaches the scan; none for an unknown id."""
    labelled = spark.read.parquet(path)
    top = labelled.filter(F.col("id") == tag_id).select("pre", "post").first()
    return labelled.filter(F.col("pre").between(top["pre"], top["post"])) if top else labelled.limit(0)


def labelled_ancestors(spark: SparkSession, path: str, tag_id: int) -> DataFrame:
    """The tags above one tag, and itself."""
    labelled = spark.read.parquet(path)
    own = labelled.filter(F.col("id") == tag_id).select("pre").first()
    return labelled.filter((F.col("pre") <= own["pre"]) & (F.col("post") >= own["pre"])) if own else labelled.limit(0)
