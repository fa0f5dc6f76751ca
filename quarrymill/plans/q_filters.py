"""Queries of scans, filters, joins, sorts and pages (S01-S03, F*, P*, O*, J04-J07, U01)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from quarrymill.operators import filters as fl
from quarrymill.operators import paging
from quarrymill.operators.filters import PhotoFilters, build_photo_query
from quarrymill.operators.lineage import fresh_path

from .base import query

PAGE = ["id", "filename", "taken_at", "rating"]


@query("slice_rated_in_range", "SELECT id, filename, taken_at, rating FROM photos WHERE status = 1 AND rating >= 3 AND taken_at >= TIMESTAMP '1996-01-01' AND taken_at < TIMESTAMP '1998-01-01' ORDER BY taken_at DESC, id DESC LIMIT 100")
def slice_rated_in_range(c):
    return paging.page(build_photo_query(c, PhotoFilters(rating_min=3, date_from=date(1996, 1, 1), date_to=date(1997, 12, 31))), "taken_at_desc", 1, 100).select(*PAGE)


@query("S01_scan", "SELECT * FROM orders")
def scan(c):
    return c.table("orders")


@query("S02_pruned_scan", "SELECT id, filename, album_path FROM photos WHERE status = 1")
def pruned_scan(c):
    return fl.active(c.photos).select("id", "filename", "album_path")


@query(
    "S03_point_lookup",
    "SELECT p.id, p.filename, (SELECT string_agg(name, ',' ORDER BY name) FROM photo_tags JOIN tags ON tag_id = tags.id WHERE photo_id = p.id) AS tag_names, (SELECT count(*) FROM faces f WHERE f.photo_id = p.id) AS n_faces FROM photos p WHERE p.id = 77",
)
def point_lookup(c):
    one = c.photos.filter("id = 77").select("id", "filename")
    names = c.photo_tags.filter("photo_id = 77").join(c.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy("photo_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("tag_names"))
    faces = c.faces.filter("photo_id = 77").groupBy(F.col("photo_id").alias("p")).agg(F.count("*").alias("n_faces"))
    return one.join(names, one["id"] == names["photo_id"], "left").join(faces, one["id"] == faces["p"], "left").select("id", "filename", "tag_names", F.coalesce("n_faces", F.lit(0)).cast("long").alias("n_faces"))


@query("F01_active", "SELECT id, status FROM photos WHERE status = 1")
def active(c):
    return fl.active(c.photos).select("id", "status")


@query("F02_path_prefix", "SELECT id, album_path FROM photos WHERE status = 1 AND album_path LIKE 'Ordered by Dates/1996%'")
def path_prefix(c):
    return build_photo_query(c, PhotoFilters(album_path="/Ordered by Dates/1996")).select("id", "album_path")


_TAGGED = """
WITH ids AS (SELECT id FROM tags WHERE path = (SELECT path FROM tags WHERE id = {0}) OR starts_with(path, (SELECT path FROM tags WHERE id = {0}) || '.')),
hit AS (SELECT photo_id FROM photo_tags WHERE tag_id IN (SELECT id FROM ids) UNION SELECT photo_id FROM faces WHERE person_tag_id IN (SELECT id FROM ids) AND status IN ('confirmed', 'suggested'))
SELECT id, filename FROM photos WHERE status = 1 AND id IN (SELECT photo_id FROM hit)"""


@query("F03_J04_U01_tag_subtree", _TAGGED.format(12))
def tag_subtree(c):
    return build_photo_query(c, PhotoFilters(tag_id=12)).select("id", "filename")


@query("F03_X09_interval_subtree", _TAGGED.format(12))
def interval_subtree(c):
    """The same by interval labels: the subtree is a range that is pushed into the scan of the tags."""
    from quarrymill.operators.hierarchy import labelled_subtree, write_labelled

    path = fresh_path(c.spark, "labelled")
    write_labelled(c.tags, path)
    return fl.tagged_among(fl.active(c.photos), c.photo_tags, c.faces, labelled_subtree(c.spark, path, 12)).select("id", "filename")


@query("F04_person_subtree", "SELECT id FROM photos WHERE status = 1 AND id IN (SELECT photo_id FROM faces WHERE person_tag_id = 1007 AND status IN ('confirmed', 'suggested'))")
def person_subtree(c):
    return build_photo_query(c, PhotoFilters(person_tag_id=1007)).select("id")


@query("F05_unknown_tag", "SELECT id FROM photos WHERE FALSE")
def unknown_tag(c):
    return build_photo_query(c, PhotoFilters(tag_id=-5)).select("id")


@query("F06_rating", "SELECT id, rating FROM photos WHERE status = 1 AND rating >= 4")
def rating(c):
    return build_photo_query(c, PhotoFilters(rating_min=4)).select("id", "rating")


@query("F07_equalities", "SELECT id FROM photos WHERE status = 1 AND color_label = 2 AND media_type = 'raw' AND country_code = 'C1'")
def equalities(c):
    return build_photo_query(c, PhotoFilters(color_label=2, media_type="raw", country_code="C1")).select("id")


@query("F08_gps", "SELECT 'both' AS kind, id FROM photos WHERE status = 1 AND latitude IS NOT NULL AND longitude IS NOT NULL UNION ALL SELECT 'not both', id FROM photos WHERE status = 1 AND (latitude IS NULL OR longitude IS NULL)")
def gps(c):
    yes, no = (build_photo_query(c, PhotoFilters(has_gps=w)).select(F.lit(kind).alias("kind"), "id") for w, kind in ((True, "both"), (False, "not both")))
    return yes.union(no)


@query("F09_J06_has_faces", "SELECT id, TRUE AS has FROM photos WHERE status = 1 AND EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = photos.id) UNION ALL SELECT id, FALSE FROM photos WHERE status = 1 AND NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = photos.id)")
def has_faces(c):
    yes, no = (build_photo_query(c, PhotoFilters(has_faces=w)).select("id", F.lit(w).alias("has")) for w in (True, False))
    return yes.union(no)


@query("F10_no_date", "SELECT id FROM photos WHERE status = 1 AND taken_at IS NULL")
def no_date(c):
    return build_photo_query(c, PhotoFilters(no_date=True)).select("id")


@query("F11_date_range", "SELECT id, taken_at FROM photos WHERE status = 1 AND taken_at >= TIMESTAMP '1997-03-01' AND taken_at < TIMESTAMP '1997-04-01'")
def date_range(c):
    return build_photo_query(c, PhotoFilters(date_from=date(1997, 3, 1), date_to=date(1997, 3, 31))).select("id", "taken_at")


@query(
    "F12_X11_J05_text_search",
    """
WITH t AS (SELECT *, list_transform(regexp_extract_all(concat_ws(' ', title, caption, filename), '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS ws FROM photos WHERE status = 1)
SELECT id FROM t WHERE list_contains(ws, 'red') OR filename ILIKE '%red%' OR id IN (SELECT photo_id FROM photo_tags JOIN tags ON tag_id = tags.id WHERE name ILIKE '%red%')
OR camera_id IN (SELECT id FROM cameras WHERE make ILIKE '%red%' OR model ILIKE '%red%') OR lens_id IN (SELECT id FROM lenses WHERE make ILIKE '%red%' OR model ILIKE '%red%')""",
)
def text_search(c):
    return build_photo_query(c, PhotoFilters(search="red")).select("id")


@query("X11_document_search", "WITH t AS (SELECT doc_id, ' ' || array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)), '  ') || ' ' AS ws FROM documents) SELECT doc_id FROM t WHERE (regexp_matches(ws, ' (license|licenses|licensed|licensing) ') AND NOT contains(ws, ' mit ')) OR regexp_matches(ws, ' (release|releases|released|releasing)  \\S+  \\S+  (mit) ')")
def document_search(c):
    """Words by their stems; in the phrase the two stop words may be any."""
    from quarrymill.operators.textsearch import matches

    return c.table("documents").filter(matches(F.col("text"), 'licensing -mit OR "releases under the mit"')).select("doc_id")


_DOC_WORDS = "WITH t AS (SELECT doc_id, ' ' || array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)), '  ') || ' ' AS ws FROM documents) SELECT doc_id FROM t WHERE "


@query("X11_F12_indexed_search", _DOC_WORDS + "(regexp_matches(ws, ' (license|licenses|licensed|licensing) ') AND NOT contains(ws, ' mit ')) OR regexp_matches(ws, ' (release|releases|released|releasing)  \\S+  \\S+  (mit) ') OR (regexp_matches(ws, ' (barn|barns) ') AND regexp_matches(ws, ' (river|rivers) '))")
def indexed_search(c):
    """The same texts from postings."""
    from quarrymill.operators import text_index

    path = fresh_path(c.spark, "postings")
    text_index.write_postings(c.table("documents").select(F.col("doc_id").alias("id"), "text"), path)
    return text_index.search_postings(c.spark, path, 'licensing -mit OR "releases under the mit" OR barns river').select(F.col("id").alias("doc_id"))


@query("X11_F12_indexed_search_by_absence", _DOC_WORDS + "NOT regexp_matches(ws, ' (license|licenses|licensed|licensing) ') AND NOT regexp_matches(ws, ' (release|releases|released|releasing)  \\S+  \\S+  (mit) ')")
def indexed_absence(c):
    from quarrymill.operators import text_index

    path = fresh_path(c.spark, "postings")
    text_index.write_postings(c.table("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), path)
    return text_index.search_postings(c.spark, path, '-licensing -"releases under the mit"').select(F.col("id").alias("doc_id"))


@query("F13_F12_trigram_search", "SELECT 1 AS part, id FROM photos WHERE filename ILIKE '%_DSC1%' UNION ALL SELECT 2, id FROM photos WHERE filename ILIKE '%day (1%' UNION ALL SELECT 3, id FROM photos WHERE filename ILIKE '%xl%' UNION ALL SELECT 4, id FROM photos WHERE filename ILIKE '%no such%'")
def trigram_search(c):
    from quarrymill.operators import text_index

    path = fresh_path(c.spark, "trigrams")
    text_index.write_trigrams(c.photos.select("id", F.col("filename").alias("text")), path)
    parts = [text_index.search_trigrams(c.spark, path, p).select(F.lit(k).alias("part"), "id") for k, p in enumerate(("_DSC1", "day (1", "xl", "no such"), 1)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("F13_name_contains", "SELECT id, name FROM tags WHERE name ILIKE '%nation_1%'")
def name_contains(c):
    return c.tags.filter(F.col("name").ilike("%nation_1%")).select("id", "name")


@query("F14_A18_logs", "SELECT id, level_name FROM app_logs WHERE level >= 30 AND source = 'stderr' AND message ILIKE '%purchase 1%' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def logs(c):
    return fl.logs(c.app_logs, "warning", "stderr", "purchase 1", datetime(2024, 1, 5), datetime(2024, 1, 20)).select("id", "level_name")


@query("F15_undated", "SELECT id, filename FROM photos WHERE status = 1 AND taken_at IS NULL ORDER BY id LIMIT 50 OFFSET 20")
def undated(c):
    return build_photo_query(c, PhotoFilters(no_date=True)).orderBy("id").offset(20).limit(50).select("id", "filename")


@query("F16_unscanned", "SELECT id FROM photos WHERE status = 1 AND media_type = 'image' AND faces_scanned_at IS NULL")
def unscanned(c):
    return fl.active(c.photos).filter((F.col("media_type") == "image") & F.col("faces_scanned_at").isNull()).select("id")


@query("F17_dirty", "SELECT count(*) FILTER (WHERE file_sync_dirty) AS dirty, count(*) FILTER (WHERE meta_synced_at IS NULL) AS never_synced, max(meta_synced_at) AS last_sync FROM photos WHERE status = 1")
def dirty(c):
    return fl.active(c.photos).agg(F.count_if("file_sync_dirty").alias("dirty"), F.count_if(F.col("meta_synced_at").isNull()).alias("never_synced"), F.max("meta_synced_at").alias("last_sync"))


@query("F18_good_faces", "SELECT id FROM faces WHERE (det_score IS NULL OR det_score >= 0.3) AND w >= 60 AND h >= 60 AND (blur_score IS NULL OR blur_score >= 20)")
def good_faces(c):
    return c.faces.filter(fl.good_face(0.3, 60, 20)).select("id")


@query("F19_bad_faces", "SELECT id FROM faces WHERE det_score < 0.3 OR w < 60 OR h < 60 OR blur_score < 20")
def bad_faces(c):
    return c.faces.filter(fl.bad_face(0.3, 60, 20)).select("id")


@query("F20_tiny_faces", "SELECT id FROM faces WHERE status = 'unconfirmed' AND (w < 40 OR h < 40)")
def tiny_faces(c):
    return c.faces.filter(fl.tiny_face(40)).select("id")


@query("F21_reference_pool", "SELECT id FROM faces WHERE status = 'confirmed' AND (best_match_score IS NULL OR best_match_score >= 0.6)")
def reference_pool(c):
    return c.faces.filter((F.col("status") == "confirmed") & fl.reference_face(0.6)).select("id")


@query("F22_J07_excluded", "SELECT id FROM photos WHERE id NOT IN (SELECT photo_id FROM faces WHERE status = 'ignored')")
def excluded(c):
    return fl.without(c.photos, c.faces.filter("status = 'ignored'").select("photo_id").distinct()).select("id")


@query("F23_in_order", "SELECT p AS position, id, filename FROM (VALUES (0, 5), (1, 3), (2, 99999999), (3, 5)) v(p, i) JOIN photos ON id = i")
def in_order(c):
    return fl.in_order(c.photos, [5, 3, 99999999, 5]).select("position", "id", "filename")


@query("F25_face_list", "SELECT id, photo_id, status FROM faces WHERE person_tag_id = 1003 AND status = 'confirmed' ORDER BY id LIMIT 40")
def face_list(c):
    return c.faces.filter((F.col("person_tag_id") == 1003) & (F.col("status") == "confirmed")).orderBy("id").limit(40).select("id", "photo_id", "status")


@query("F26_eligible", "SELECT f.id FROM faces f WHERE best_match_score >= 0.7 AND status = 'suggested' AND NOT EXISTS (SELECT 1 FROM faces o WHERE o.status = 'confirmed' AND o.photo_id = f.photo_id AND o.person_tag_id = f.person_tag_id AND o.id <> f.id)")
def eligible(c):
    from quarrymill.operators.mutations import conflicts

    asked = c.faces.filter((F.col("best_match_score") >= 0.7) & (F.col("status") == "suggested"))
    none = c.tags.filter("FALSE").select("id")
    return fl.without(asked, conflicts(c.faces, asked, none).select("id")).select("id")


@query("F27_map_points", "SELECT id, latitude, longitude FROM photos WHERE status = 1 AND latitude IS NOT NULL AND longitude IS NOT NULL AND album_path LIKE 'Trip%' AND id IN (SELECT photo_id FROM photo_tags WHERE tag_id = 103) ORDER BY id LIMIT 500")
def map_points(c):
    near = build_photo_query(c, PhotoFilters(has_gps=True, album_path="Trip"))
    tagged = c.photo_tags.filter("tag_id = 103").select("photo_id")
    return near.join(tagged, F.col("id") == F.col("photo_id"), "left_semi").orderBy("id").limit(500).select("id", "latitude", "longitude")


@query("F28_no_duration", "SELECT id FROM photos WHERE media_type = 'video' AND duration_secs IS NULL AND status = 1")
def no_duration(c):
    return fl.active(c.photos).filter((F.col("media_type") == "video") & F.col("duration_secs").isNull()).select("id")


@query("F29_unhashed", "SELECT id FROM photos WHERE status = 1 AND sha256 IS NULL ORDER BY id LIMIT 200")
def unhashed(c):
    return fl.active(c.photos).filter(F.col("sha256").isNull()).orderBy("id").limit(200).select("id")


@query("F31_no_crop", "SELECT id FROM faces WHERE x IS NOT NULL AND w > 0 AND h > 0 AND blur_score IS NULL")
def no_crop(c):
    return c.faces.filter(F.col("x").isNotNull() & (F.col("w") > 0) & (F.col("h") > 0) & F.col("blur_score").isNull()).select("id")


@query("F32_dirty_in_album", "SELECT id FROM photos WHERE status = 1 AND file_sync_dirty AND album_path LIKE 'Events%'")
def dirty_in_album(c):
    return build_photo_query(c, PhotoFilters(album_path="Events")).filter("file_sync_dirty").select("id")


@query("P01_labels", "SELECT id, trim(coalesce(make, '') || ' ' || coalesce(model, '')) AS label FROM cameras")
def labels(c):
    return c.cameras.select("id", F.trim(F.concat(F.coalesce("make", F.lit("")), F.lit(" "), F.coalesce("model", F.lit("")))).alias("label"))


@query("P03_face_names", "SELECT f.id, coalesce(t.name, 'person ' || CAST(f.person_tag_id AS VARCHAR)) AS person FROM faces f LEFT JOIN tags t ON t.id = f.person_tag_id AND t.is_person")
def face_names(c):
    people = c.tags.filter("is_person").select(F.col("id").alias("t"), "name")
    return c.faces.join(people, F.col("person_tag_id") == F.col("t"), "left").select("id", F.coalesce("name", F.concat(F.lit("person "), F.col("person_tag_id").cast("string"))).alias("person"))


@query("O01_sorts", "(SELECT 1 AS sort, id, taken_at FROM photos ORDER BY taken_at ASC NULLS LAST, id ASC LIMIT 60) UNION ALL (SELECT 2, id, taken_at FROM photos ORDER BY rating DESC NULLS LAST, id DESC LIMIT 60) UNION ALL (SELECT 3, id, taken_at FROM photos ORDER BY filename ASC, id ASC LIMIT 60) UNION ALL (SELECT 4, id, taken_at FROM photos ORDER BY imported_at DESC, id DESC LIMIT 60) UNION ALL (SELECT 5, id, taken_at FROM photos ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 60)")
def sorts(c):
    out = None
    for k, sort in enumerate(("taken_at_asc", "rating_desc", "filename_asc", "imported_at_desc", "no such sort"), 1):
        one = c.photos.orderBy(*paging.order(sort)).limit(60).select(F.lit(k).alias("sort"), "id", "taken_at")
        out = one if out is None else out.union(one)
    return out


@query("O02_page", "SELECT id, filename, taken_at, rating FROM photos WHERE status = 1 ORDER BY rating DESC, id DESC LIMIT 25 OFFSET 50")
def page(c):
    return paging.page(fl.active(c.photos), "rating_desc", 3, 25).select(*PAGE)


@query("O03_X35_cursor", "SELECT id, filename, taken_at, rating FROM photos WHERE status = 1 AND (taken_at < TIMESTAMP '1998-06-15' OR (taken_at = TIMESTAMP '1998-06-15' AND id < 9000) OR taken_at IS NULL) ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 120")
def cursor(c):
    row = {"id": 9000, "taken_at": datetime(1998, 6, 15)}
    return paging.after_cursor(fl.active(c.photos), paging.cursor_behind(row, "taken_at_desc"), "taken_at_desc", 120).select(*PAGE)


@query("O04_A19_places", "SELECT country_code, state, count(*) AS n FROM photos WHERE country_code IS NOT NULL AND state <> '' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def places(c):
    known = c.photos.filter(F.col("country_code").isNotNull() & (F.col("state") != ""))
    return known.groupBy("country_code", "state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country_code", "state").limit(20)


@query("O05_person_faces", "SELECT f.id, p.taken_at FROM faces f JOIN photos p ON p.id = f.photo_id WHERE f.person_tag_id = 1011 ORDER BY p.taken_at ASC NULLS LAST, f.id LIMIT 80")
def person_faces(c):
    dated = c.faces.filter("person_tag_id = 1011").select("id", "photo_id").join(c.photos.select(F.col("id").alias("photo_id"), "taken_at"), "photo_id")
    return dated.orderBy(F.col("taken_at").asc_nulls_last(), "id").limit(80).select("id", "taken_at")


@query("O06_audit_queue", "SELECT id, best_match_score FROM faces WHERE status = 'confirmed' ORDER BY best_match_score ASC NULLS FIRST, id LIMIT 90")
def audit_queue(c):
    return c.faces.filter("status = 'confirmed'").orderBy(F.col("best_match_score").asc_nulls_first(), "id").limit(90).select("id", "best_match_score")


@query("O09_tier_order", "WITH t AS (SELECT id, CASE WHEN starts_with(album_path, 'AB_TO_SORT/') THEN 0 WHEN starts_with(album_path, 'Ordered by Dates/') THEN 1 ELSE 2 END AS tier, imported_at FROM photos) SELECT id, tier FROM t ORDER BY tier DESC, imported_at, id LIMIT 70")
def tier_order(c):
    from quarrymill.functions.scalars import folder_tier

    return c.photos.select("id", folder_tier(F.col("album_path")).alias("tier"), "imported_at").orderBy(F.desc("tier"), "imported_at", "id").limit(70).select("id", "tier")


@query("O10_recent", "SELECT id, imported_at FROM photos ORDER BY imported_at DESC, id DESC LIMIT 30")
def recent(c):
    return c.photos.orderBy(F.desc("imported_at"), F.desc("id")).limit(30).select("id", "imported_at")


@query("O11_pool_of_50", "SELECT id FROM faces WHERE status = 'confirmed' AND person_tag_id = 1004 ORDER BY id LIMIT 50")
def pool_of_50(c):
    return c.faces.filter("status = 'confirmed' AND person_tag_id = 1004").orderBy("id").limit(50).select("id")
