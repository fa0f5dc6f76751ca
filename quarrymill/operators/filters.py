"""Declarative filters over the catalog (F01-F32, J04-J07, U01). Every filter is a column predicate or a semi join."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import subtree

#: The statuses in which a face counts as a person's, and the severities of the log levels.
PERSON_STATUSES = ("confirmed", "suggested")
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


@dataclass(frozen=True)
class PhotoFilters:
    """All optional; those that are set are combined by AND. The record form is also a saved search."""

    album_path: str | None = None
    tag_id: int | None = None
    person_tag_id: int | None = None
    rating_min: int | None = None
    color_label: int | None = None
    media_type: str | None = None
    camera_id: int | None = None
    lens_id: int | None = None
    has_gps: bool | None = None
    has_faces: bool | None = None
    no_date: bool | None = None
    country_code: str | None = None
    search: str | None = None
    date_from: date | None = None
    date_to: date | None = None


def active(photos: DataFrame) -> DataFrame:
    """F01"""
    return photos.filter(F.col("status") == 1)


def under_path(prefix: str) -> Column:
    """LIKE prefix; a leading slash goes, segments do not bound it, and % and _ stay wildcards."""
    return F.col("album_path").like(prefix.lstrip("/") + "%")


def tagged(photos: DataFrame, photo_tags: DataFrame, faces: DataFrame, tags: DataFrame, tag_id: int) -> DataFrame:
    """Photos with a tag of the subtree, or a face of one of its persons. An unknown tag gives none."""
    return tagged_among(photos, photo_tags, faces, subtree(tags, tag_id))


def tagged_among(photos: DataFrame, photo_tags: DataFrame, faces: DataFrame, tags: DataFrame) -> DataFrame:
    """Photos with one of these tags (id), or a face of one of these persons."""
    wanted = tags.select(F.col("id").alias("wanted"))
    by_tag = photo_tags.join(wanted, F.col("tag_id") == F.col("wanted"), "left_semi").select("photo_id")
    by_face = faces.filter(F.col("status").isin(*PERSON_STATUSES)).join(wanted, F.col("person_tag_id") == F.col("wanted"), "left_semi").select("photo_id")
    ids = by_tag.union(by_face).distinct()
    return photos.join(ids, photos["id"] == ids["photo_id"], "left_semi")


def of_person(photos: DataFrame, faces: DataFrame, tags: DataFrame, tag_id: int) -> DataFrame:
    """F04"""
    wanted = subtree(tags, tag_id).select(F.col("id").alias("wanted"))
    seen = faces.filter(F.col("status").isin(*PERSON_STATUSES)).join(wanted, F.col("person_tag_id") == F.col("wanted"), "left_semi")
    return photos.join(seen.select("photo_id"), photos["id"] == F.col("photo_id"), "left_semi")


def gps(wanted: bool) -> Column:
    """both coordinates, or not both."""
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return both if wanted else ~both


def with_faces(photos: DataFrame, faces: DataFrame, wanted: bool) -> DataFrame:
    """F09, J06. Of faces only photo_id counts, which may be repeated."""
    return photos.join(faces.select("photo_id"), photos["id"] == F.col("photo_id"), "left_semi" if wanted else "left_anti")


def taken_between(first: date | None, last: date | None) -> Column:
    """half open, on the raw column, so it reaches the scan."""
    test = F.lit(True)
    if first is not None:
        test = test & (F.col("taken_at") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        test = test & (F.col("taken_at") < F.lit(last + timedelta(days=1)).cast("timestamp_ntz"))
    return test


def searched(photos: DataFrame, photo_tags: DataFrame, tags: DataFrame, cameras: DataFrame, lenses: DataFrame, words: str) -> DataFrame:
    """text match in title, caption and filename, or a substring of the filename, a tag's, camera's or lens's name.

    Each source marks the ids it finds; one semi join keeps their union.
    """
    from .textsearch import matches, may_match

    like = f"%{words}%"
    text = F.concat_ws(" ", "title", "caption", "filename")
    own = photos.filter(may_match(text, words) & matches(text, words)).select("id").union(photos.filter(F.col("filename").ilike(like)).select("id"))
    named = lambda table: table.filter(F.col("make").ilike(like) | F.col("model").ilike(like)).select(F.col("id").alias("part_id"))
    by_camera = photos.join(F.broadcast(named(cameras)), F.col("camera_id") == F.col("part_id"), "left_semi").select("id")
    by_lens = photos.join(F.broadcast(named(lenses)), F.col("lens_id") == F.col("part_id"), "left_semi").select("id")
    hit_tags = tags.filter(F.col("name").ilike(like)).select(F.col("id").alias("hit"))
    by_tag = photo_tags.join(hit_tags, F.col("tag_id") == F.col("hit"), "left_semi").select(F.col("photo_id").alias("id"))
    found = own.union(by_camera).union(by_lens).union(by_tag).distinct()
    return photos.join(found, "id", "left_semi")


def build_photo_query(catalog, f: PhotoFilters) -> DataFrame:
    """The filtered photos of a catalog: no order, no limit."""
    photos = active(catalog.photos)
    if f.album_path:
        photos = photos.filter(under_path(f.album_path))
    if f.rating_min is not None:
        photos = photos.filter(F.col("rating") >= f.rating_min)  # F06
    for name in ("color_label", "media_type", "camera_id", "lens_id", "country_code"):  # F07
        if (value := getattr(f, name)) is not None:
            photos = photos.filter(F.col(name) == value)
    if f.has_gps is not None:
        photos = photos.filter(gps(f.has_gps))
    if f.no_date:  # False is no filter
        photos = photos.filter(F.col("taken_at").isNull())
    if f.date_from or f.date_to:
        photos = photos.filter(taken_between(f.date_from, f.date_to))
    if f.tag_id is not None:
        photos = tagged(photos, catalog.photo_tags, catalog.faces, catalog.tags, f.tag_id)
    if f.person_tag_id is not None:
        photos = of_person(photos, catalog.faces, catalog.tags, f.person_tag_id)
    if f.has_faces is not None:
        photos = with_faces(photos, catalog.face_photo_ids, f.has_faces)
    if f.search:
        photos = searched(photos, catalog.photo_tags, catalog.tags, catalog.cameras, catalog.lenses, f.search)
    return photos


def logs(rows: DataFrame, level: str | None = None, source: str | None = None, contains: str | None = None, since=None, before=None) -> DataFrame:
    """every bound is optional; an unknown level name is ignored."""
    if level and level.upper() in LEVELS:
        rows = rows.filter(F.col("level") >= LEVELS[level.upper()])
    if source:
        rows = rows.filter(F.col("source") == source)
    if contains:
        rows = rows.filter(F.col("message").ilike(f"%{contains}%"))
    if since is not None:
        rows = rows.filter(F.col("last_seen_at" if "last_seen_at" in rows.columns else "ts") >= F.lit(since))
    if before is not None:
        rows = rows.filter(F.col("ts") < F.lit(before))
    return rows


def good_face(det: float = 0, size: int = 0, blur: float = 0) -> Column:
    """a null score passes, a null size fails; a gate of 0 is off."""
    test = F.lit(True)
    if det:
        test = test & (F.col("det_score").isNull() | (F.col("det_score") >= det))
    if size:
        test = test & F.coalesce(F.col("w") >= size, F.lit(False)) & F.coalesce(F.col("h") >= size, F.lit(False))
    if blur:
        test = test & (F.col("blur_score").isNull() | (F.col("blur_score") >= blur))
    return test


def bad_face(det: float = 0, size: int = 0, blur: float = 0) -> Column:
    """any known value under its bound. Nulls never fail."""
    tests = ([F.col("det_score") < det] if det else []) + ([F.col("w") < size, F.col("h") < size] if size else []) + ([F.col("blur_score") < blur] if blur else [])
    return F.coalesce(reduce(or_, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(False)), F.lit(False))


def tiny_face(size: int) -> Column:
    """F20"""
    return (F.col("status") == "unconfirmed") & ((F.col("w") < size) | (F.col("h") < size))


def reference_face(least: float) -> Column:
    """F21"""
    return F.col("best_match_score").isNull() | (F.col("best_match_score") >= least)


def without(rows: DataFrame, excluded: DataFrame, key: str = "id") -> DataFrame:
    """F22, J07"""
    return rows.join(excluded.select(F.col(excluded.columns[0]).alias("__out")), F.col(key) == F.col("__out"), "left_anti")


def in_order(rows: DataFrame, ids: list[int], most: int = 200) -> DataFrame:
    """the rows of the first `most` ids, in the order asked for, repeats kept, unknown ids dropped. Adds `position`."""
    asked = rows.sparkSession.createDataFrame([(p, i) for p, i in enumerate(ids[:most])], "position int, asked long")
    return rows.join(F.broadcast(asked), F.col("id") == F.col("asked")).drop("asked")
