"""Import of a legacy catalog in dependency order (D15): tags, photos, links, faces; a dry run is the plan without a write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.scalars import rect, sanitized_import
from quarrymill.operators.aggregates import property_choice
from quarrymill.operators.hierarchy import chains

#: Face properties by rank, and the status that each gives.
FACE_RANKS = {"tagRegion": 1, "autodetectedPerson": 2, "autodetectedFace": 3, "ignoredFace": 4}
FACE_STATUS = {"tagRegion": "confirmed", "autodetectedPerson": "suggested", "autodetectedFace": "unconfirmed", "ignoredFace": "ignored"}


@dataclass
class Imported:
    tags: DataFrame
    photos: DataFrame
    photo_tags: DataFrame
    faces: DataFrame
    skipped: DataFrame


def import_tags(tags: DataFrame) -> DataFrame:
    """id, name, path, parent_id, is_person of legacy tags (id, pid, name), paths made from the roots down.

    Siblings whose names become the same label get a number behind all but the first (by id). Tags below a root named
    people, _people or persons are persons."""
    clean = tags.select("id", F.nullif(F.col("pid"), F.lit(0)).alias("parent_id"), "name", sanitized_import(F.col("name"), "tag").alias("label"))
    n = F.row_number().over(Window.partitionBy(F.coalesce("parent_id", F.lit(0)), "label").orderBy("id"))
    labelled = clean.withColumn("label", F.when(n == 1, F.col("label")).otherwise(F.concat("label", F.lit("_"), (n - 1).cast("string"))))
    tree = chains(labelled.select("id", "parent_id", "label", F.lower("name").alias("top")))
    person = F.col("top").isin("people", "_people", "persons") & (F.col("depth") > 1)
    return tree.join(labelled.select("id", "name", "parent_id"), "id").select("id", "name", "path", "parent_id", person.alias("is_person"))


def import_photos(images: DataFrame, albums: DataFrame, comments: DataFrame) -> DataFrame:
    """id, filename, album_path, sha256, title, caption; of several comments of one kind the smallest stays."""
    said = comments.filter(F.col("type").isin(1, 3)).groupBy("imageid").agg(F.min(F.when(F.col("type") == 3, F.col("comment"))).alias("title"), F.min(F.when(F.col("type") == 1, F.col("comment"))).alias("caption"))
    path = albums.select(F.col("id").alias("album"), F.ltrim(F.col("relativePath"), F.lit("/")).alias("album_path"))
    live = images.filter(F.col("status") == 1)
    return live.join(path, "album").join(said, F.col("id") == F.col("imageid"), "left").select("id", F.col("name").alias("filename"), "album_path", F.col("uniqueHash").alias("sha256"), "title", "caption")


def run_import(images: DataFrame, albums: DataFrame, comments: DataFrame, tags: DataFrame, image_tags: DataFrame, properties: DataFrame) -> Imported:
    """All tables of the import; links to photos or tags that are not there are skipped and counted."""
    new_tags, photos = import_tags(tags), import_photos(images, albums, comments)
    known_photo, known_tag = photos.select(F.col("id").alias("photo_id")), new_tags.select(F.col("id").alias("tag_id"))
    asked = image_tags.select(F.col("imageid").alias("photo_id"), F.col("tagid").alias("tag_id")).distinct()
    links = asked.join(known_photo, "photo_id", "left_semi").join(known_tag, "tag_id", "left_semi").select("photo_id", "tag_id")
    skipped = asked.agg(F.count("*").alias("asked")).crossJoin(links.agg(F.count("*").alias("kept"))).select((F.col("asked") - F.col("kept")).alias("skipped"))
    chosen = property_choice(properties.filter(F.col("property").isin(*FACE_RANKS)).select(F.col("imageid").alias("image_id"), F.col("tagid").alias("tag_id"), "property", "value"), FACE_RANKS)
    x, y, w, h = rect(F.col("value"))
    status = F.element_at(F.create_map(*[F.lit(v) for pair in FACE_STATUS.items() for v in pair]), F.col("property"))
    faces = chosen.select(F.col("image_id").alias("photo_id"), F.col("tag_id").alias("person_tag_id"), status.alias("status"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")).join(known_photo, "photo_id", "left_semi")
    return Imported(new_tags, photos, links, faces, skipped)
