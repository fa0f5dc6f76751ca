"""Queries of table changes and of the file plans (M*, D04-D08, D14, D21-D23, J12, J13, U02-U04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators import mutations as mu

from . import pipelines
from .base import query

_TIER = "CASE WHEN starts_with(album_path, 'AB_TO_SORT/') THEN 0 WHEN starts_with(album_path, 'Ordered by Dates/') THEN 1 ELSE 2 END"


@query("D04_duplicate_listing", f"WITH h AS (SELECT sha256, id, {_TIER} AS tier, imported_at, count(*) OVER (PARTITION BY sha256) AS copies FROM photos WHERE sha256 IS NOT NULL AND status = 1) SELECT sha256, copies, id, tier, CAST(row_number() OVER (PARTITION BY sha256 ORDER BY tier DESC, imported_at, id) AS INT) AS rank FROM h WHERE copies >= 2")
def duplicate_listing(c):
    return pipelines.duplicate_listing(c.photos)


#: r: active hashed copies; k: groups of more than one tier; p: what happens to a copy; g: groups that lose one.
_PLAN = f"""
WITH r AS (SELECT *, {_TIER} AS tier, EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = photos.id AND f.status = 'confirmed') AS face FROM photos WHERE sha256 IS NOT NULL AND status = 1),
b AS (SELECT *, max(tier) OVER (PARTITION BY sha256) AS best FROM r),
k AS (SELECT *, bool_or(face AND tier = best) OVER (PARTITION BY sha256) AS kept_face FROM b),
p AS (SELECT *, CASE WHEN tier = best THEN 'keep' WHEN stack_id IS NOT NULL THEN 'in_stack' WHEN face AND NOT kept_face THEN 'only_copy_with_faces' ELSE 'delete' END AS what FROM k),
g AS (SELECT DISTINCT sha256 FROM p WHERE what = 'delete')
"""


@query("D05_dedup_plan", _PLAN + "SELECT id, sha256, file_size, tier, CASE WHEN what IN ('keep', 'delete') THEN what ELSE 'skip' END AS action, CASE WHEN what NOT IN ('keep', 'delete') THEN what END AS reason FROM p WHERE what <> 'keep' OR sha256 IN (SELECT sha256 FROM g)")
def dedup_plan(c):
    return pipelines.dedup_plan(c.photos, c.faces)


@query(
    "D06_dedup_apply",
    _PLAN
    + """, m AS (SELECT sha256, max(rating) AS rating,
 arg_min(color_label, (what = 'delete', imported_at, id)) FILTER (WHERE color_label <> 0) AS color_label, arg_min(title, (what = 'delete', imported_at, id)) FILTER (WHERE title <> '') AS title,
 arg_min(caption, (what = 'delete', imported_at, id)) FILTER (WHERE caption <> '') AS caption FROM p WHERE what IN ('keep', 'delete') AND sha256 IN (SELECT sha256 FROM g) GROUP BY 1)
SELECT o.id, CASE WHEN p.what = 'delete' THEN 0 ELSE o.status END AS status, coalesce(m.rating, o.rating) AS rating, coalesce(m.color_label, o.color_label) AS color_label, coalesce(m.title, o.title) AS title, coalesce(m.caption, o.caption) AS caption
FROM photos o LEFT JOIN p USING (id) LEFT JOIN m ON m.sha256 = p.sha256 AND p.what = 'keep'""",
)
def dedup_apply(c):
    return pipelines.dedup_apply(c.photos, c.photo_tags, pipelines.dedup_plan(c.photos, c.faces))[0].select("id", "status", "rating", "color_label", "title", "caption")


@query(
    "D06_merged_tags",
    _PLAN + "SELECT photo_id, tag_id FROM photo_tags UNION SELECT k.id, t.tag_id FROM p k JOIN p o ON o.sha256 = k.sha256 AND o.what IN ('keep', 'delete') JOIN photo_tags t ON t.photo_id = o.id WHERE k.what = 'keep' AND k.sha256 IN (SELECT sha256 FROM g)",
)
def dedup_tags(c):
    return pipelines.dedup_apply(c.photos, c.photo_tags, pipelines.dedup_plan(c.photos, c.faces))[1]


_EXT = "lower(regexp_extract({0}, '\\.([^.]+)$', 1))"
_RAW = "('nef', 'cr2', 'cr3', 'arw', 'orf', 'raf', 'rw2', 'dng', 'pef', 'srw', 'x3f', '3fr')"
_PICTURE = "('jpg', 'jpeg', 'png', 'gif', 'bmp', 'tif', 'tiff', 'webp', 'heic', 'heif')"
_STEM = "lower(regexp_replace(filename, '\\.[^.]*$', ''))"
_MEMBERS = f"""
WITH named AS (SELECT *, {_STEM} AS stem, {_EXT.format("filename")} IN {_RAW} AS is_raw FROM photos WHERE status = 1),
raws AS (SELECT id, left(album_path, length(album_path) - 4) AS album, stem AS stem_key, rating, file_size FROM named WHERE is_raw AND album_path LIKE '%/RAW'),
der AS (SELECT p.id, r.album, r.stem_key, p.rating, p.file_size, row_number() OVER (PARTITION BY p.id ORDER BY length(r.stem_key) DESC) AS n FROM named p JOIN (SELECT DISTINCT album, stem_key FROM raws) r ON p.album_path = r.album AND NOT p.is_raw
  AND (p.stem = r.stem_key OR (starts_with(p.stem, r.stem_key) AND substr(p.stem, length(r.stem_key) + 1, 1) IN ('.', '-', '_', ' ')))),
m AS (SELECT album, stem_key, id, rating, file_size, 'derivative' AS role FROM der WHERE n = 1 UNION ALL SELECT album, stem_key, id, rating, file_size, 'raw' FROM raws)
"""


@query("J12_O08_stack_members", _MEMBERS + "SELECT album, stem_key, id, role FROM m")
def stack_members(c):
    return pipelines.stack_members(c.photos).select("album", "stem_key", "id", "role")


@query("D07_F30_stacks", _MEMBERS + "SELECT album, stem_key, arg_max(id, (role = 'derivative', CASE WHEN role = 'derivative' THEN rating ELSE 0 END, CASE WHEN role = 'derivative' THEN file_size ELSE 0 END, -id)) AS cover_id, count(*) AS members, bool_or(role = 'raw') AS has_raw FROM m GROUP BY 1, 2")
def stacks(c):
    return pipelines.stacks(c.photos)


@query("A24_stacks_per_album", _MEMBERS + "SELECT album, count(*) AS n FROM (SELECT DISTINCT album, stem_key FROM m) GROUP BY 1")
def stacks_per_album(c):
    return pipelines.stacks(c.photos).groupBy("album").agg(F.count("*").alias("n"))


@query("D08_U02_stack_tag_sync", _MEMBERS + ", k AS (SELECT album, stem_key, id, tag_id FROM m JOIN photo_tags ON photo_id = id) SELECT DISTINCT m.id, u.tag_id FROM m JOIN (SELECT DISTINCT album, stem_key, tag_id FROM k) u USING (album, stem_key) WHERE NOT EXISTS (SELECT 1 FROM photo_tags t WHERE t.photo_id = m.id AND t.tag_id = u.tag_id)")
def stack_tag_sync(c):
    return pipelines.stack_tag_sync(pipelines.stack_members(c.photos), c.photo_tags)


@query(
    "D08_stack_value_sync",
    _MEMBERS + ", u AS (SELECT album, stem_key, max(coalesce(o.rating, 0)) AS r, arg_min(o.color_label, o.id) FILTER (WHERE o.color_label <> 0) AS c FROM m JOIN photos o ON o.id = m.id GROUP BY 1, 2) SELECT m.id, u.r AS rating, coalesce(u.c, o.color_label) AS color_label FROM m JOIN u USING (album, stem_key) JOIN photos o ON o.id = m.id",
)
def stack_value_sync(c):
    return pipelines.stack_value_sync(pipelines.stack_members(c.photos), c.photos)


@query("U04_stale_stacks", _MEMBERS + "SELECT DISTINCT rtrim(left(album_path, length(album_path) - 4), '/') AS album, stem AS stem_key FROM (SELECT album_path, lower(regexp_replace(filename, '\\.[^.]*$', '')) AS stem FROM photos WHERE album_path LIKE '%/RAW') EXCEPT SELECT album, stem_key FROM raws")
def stale_stacks(c):
    """Of the stacks of all files in RAW folders, trashed ones and pictures too, those without a RAW file that is active."""
    from quarrymill.functions.scalars import raw_parent, stem

    known = c.photos.select(raw_parent(F.col("album_path")).alias("album"), stem(F.col("filename")).alias("stem_key")).filter(F.col("album").isNotNull()).distinct()
    return pipelines.stale_stacks(known, c.photos)


#: Half of the RAW files lie beside their RAW folder.
_STRAY = "CASE WHEN id % 16 = 2 THEN replace(album_path, '/RAW', '') ELSE album_path END"


def _strayed(c):
    return c.photos.withColumn("album_path", F.when(F.col("id") % 16 == 2, F.regexp_replace("album_path", "/RAW$", "")).otherwise(F.col("album_path")))


@query(
    "J13_D21_U03_raw_without_picture",
    f"WITH s AS (SELECT id, {_STEM} AS stem, {_EXT.format('filename')} AS ext, replace(album_path, '/RAW', '') AS folder FROM photos), r AS (SELECT id, stem, folder FROM s WHERE ext IN {_RAW}), p AS (SELECT DISTINCT stem AS other, folder FROM s WHERE ext IN {_PICTURE}) SELECT id, folder, stem FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.folder = r.folder AND contains(p.other, r.stem))",
)
def raw_without_picture(c):
    return pipelines.raw_without_picture(c.photos.withColumn("album_path", F.regexp_replace("album_path", "/RAW$", "")))


@query("D22_raw_moves", f"WITH s AS (SELECT id, filename, {_STRAY} AS album_path FROM photos) SELECT id, album_path, album_path || '/RAW' AS new_path FROM s WHERE {_EXT.format('filename')} IN {_RAW} AND NOT album_path LIKE '%/RAW'")
def raw_moves(c):
    return pipelines.raw_folder_moves(_strayed(c))


_PLACE = "CASE WHEN starts_with(filename, 'PXL_') AND length(filename) >= 12 THEN 'out/' || filename[5:8] || '/' || filename[9:10] WHEN taken_at IS NOT NULL THEN strftime(taken_at, 'out/%Y/%m') ELSE 'out' END"


@query("D25_sorted_names", f"SELECT id, folder, CASE WHEN n = 1 THEN filename ELSE CAST(n - 2 AS VARCHAR) || '_' || filename END AS name FROM (SELECT id, filename, {_PLACE} AS folder, row_number() OVER (PARTITION BY filename, {_PLACE} ORDER BY id) AS n FROM photos)")
def sorted_names(c):
    from quarrymill.functions.scalars import destination

    return pipelines.sorted_names(c.photos, destination(F.col("filename"), F.col("taken_at"), "out"))


@query("D14_M15_restored_tags", "WITH w AS (SELECT DISTINCT 'Places.' || replace(r_name, ' ', '_') || '.' || n_name || '.C' || CAST(c_nationkey % 4 AS VARCHAR) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), x AS (SELECT string_split('New.' || p, '.') AS s FROM w UNION SELECT string_split(p, '.') FROM w), e AS (SELECT DISTINCT array_to_string(s[1:k], '.') AS path, CASE WHEN k > 1 THEN array_to_string(s[1:k - 1], '.') END AS parent, s[k] AS name FROM (SELECT s, unnest(range(1, len(s) + 1)) AS k FROM x)) SELECT path, parent, name FROM e WHERE path NOT IN (SELECT path FROM tags)")
def restored_tags(c):
    owners = c.table("customer").join(c.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(c.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = owners.select(F.concat_ws(".", F.lit("Places"), F.replace("r_name", F.lit(" "), F.lit("_")), "n_name", F.concat(F.lit("C"), (F.col("c_nationkey") % 4).cast("string"))).alias("tag_path"))
    return pipelines.restored_tags(own.union(own.select(F.concat(F.lit("New."), "tag_path"))), c.tags)


_NEAREST = "WITH pl AS (SELECT c_custkey AS place_id, CAST(c_custkey * 7 % 160 - 80 AS DOUBLE) + 0.1 AS p_lat, CAST(c_custkey * 13 % 340 - 170 AS DOUBLE) + 0.3 AS p_lon FROM customer), pt AS (SELECT DISTINCT latitude, longitude FROM photos WHERE latitude IS NOT NULL AND longitude IS NOT NULL), d AS (SELECT latitude, longitude, place_id, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(p_lat) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(p_lat)) * pow(sin((radians(p_lon) - radians(longitude)) / 2), 2)))), 6) AS km FROM pt, pl), b AS (SELECT latitude, longitude, min(km) AS km FROM d GROUP BY 1, 2) SELECT id, round(b.km, 3) AS km FROM photos JOIN b USING (latitude, longitude)"


@query("J17_D11_nearest_place", _NEAREST)
def nearest_place(c):
    k = F.col("c_custkey")
    places = c.table("customer").select(k.alias("place_id"), ((k * 7 % 160 - 80).cast("double") + 0.1).alias("p_lat"), ((k * 13 % 340 - 170).cast("double") + 0.3).alias("p_lon"))
    return pipelines.nearest_place(c.photos, places).select("id", F.round("km", 3).alias("km"))


@query("J17_D11_nearest_in_cells", _NEAREST)
def nearest_in_cells(c):
    """The same by an octree whose cells follow the places' density."""
    from quarrymill.operators.octree import nearest_in_cells as nearest

    k = F.col("c_custkey")
    places = c.table("customer").select(k.alias("place_id"), ((k * 7 % 160 - 80).cast("double") + 0.1).alias("p_lat"), ((k * 13 % 340 - 170).cast("double") + 0.3).alias("p_lon"))
    return nearest(c.photos, places).select("id", F.round("km", 3).alias("km"))


@query("M01_upsert", "SELECT id, album_path, rating FROM photos WHERE id % 10 <> 3 AND id % 2 = 0 UNION ALL SELECT id, album_path, 9 FROM photos WHERE id % 10 = 3")
def upsert(c):
    cols = c.photos.select("id", "album_path", "rating")
    return mu.upsert(cols.filter("id % 2 = 0 OR id % 10 = 3").filter("id % 20 <> 13"), cols.filter("id % 10 = 3").withColumn("rating", F.lit(9)), ["id"])


@query("M02_insert_ignore", "SELECT photo_id, tag_id FROM photo_tags UNION SELECT id, 104 FROM photos")
def insert_ignore(c):
    return mu.insert_ignore(c.photo_tags, c.photos.select(F.col("id").alias("photo_id"), F.lit(104).alias("tag_id")), ["photo_id", "tag_id"])


@query("M03_get_or_create", "WITH n AS (SELECT DISTINCT p_brand AS make, p_name AS model FROM part EXCEPT SELECT make, model FROM cameras) SELECT id, make, model FROM cameras UNION ALL SELECT CAST((SELECT max(id) FROM cameras) + row_number() OVER (ORDER BY make, model) AS INT), make, model FROM n")
def get_or_create(c):
    return mu.get_or_create(c.cameras, c.table("part").select(F.col("p_brand").alias("make"), F.col("p_name").alias("model")), ["make", "model"])


@query("M04_M14_trashed", "SELECT id, CASE WHEN rating = 0 AND color_label IS NULL THEN 0 ELSE status END AS status FROM photos")
def trashed(c):
    return mu.update_where(c.photos, (F.col("rating") == 0) & F.col("color_label").isNull(), status=F.lit(0)).select("id", "status")


@query("M05_cascade", "SELECT photo_id, tag_id FROM photo_tags WHERE tag_id NOT IN (SELECT id FROM tags WHERE path LIKE 'Places.ASIA%')")
def cascade(c):
    return mu.delete_by_key(c.photo_tags, c.tags.filter(F.col("path").like("Places.ASIA%")), "tag_id", "id")


@query("M06_M17_marked", "SELECT id, file_sync_dirty OR id IN (SELECT photo_id FROM faces WHERE status = 'suggested') AS file_sync_dirty FROM photos")
def marked(c):
    return mu.mark_parents(c.photos, c.faces.filter("status = 'suggested'"), "photo_id", "file_sync_dirty").select("id", "file_sync_dirty")


@query("M08_T05_retained", "SELECT id FROM app_logs WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def retained(c):
    return mu.retained(c.app_logs, "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 7).select("id")


@query("M09_reparented", "SELECT id, CASE WHEN path = 'Places.ASIA' OR path LIKE 'Places.ASIA.%' THEN 'Places.EUROPE.' || substring(path, 8) ELSE path END AS path, CASE WHEN id = 12 THEN 13 ELSE parent_id END AS parent_id FROM tags")
def reparented(c):
    return mu.reparented(c.tags, 12, 13).select("id", "path", "parent_id")


@query("M10_cleared_logs", "SELECT id FROM app_logs WHERE NOT (level >= 40 AND source = 'stderr')")
def cleared(c):
    from quarrymill.operators.filters import logs

    return c.app_logs.join(logs(c.app_logs, "ERROR", "stderr").select("id"), "id", "left_anti").select("id")


@query("M12_X36_conflicts", "SELECT f.id FROM faces f WHERE f.status = 'suggested' AND person_tag_id NOT IN (SELECT id FROM tags WHERE name LIKE '%- TWINS%') AND EXISTS (SELECT 1 FROM faces o WHERE o.status = 'confirmed' AND o.photo_id = f.photo_id AND o.person_tag_id = f.person_tag_id AND o.id <> f.id)")
def conflicts(c):
    twins = c.tags.filter(F.contains("name", F.lit("- TWINS"))).select("id")
    return mu.conflicts(c.faces, c.faces.filter("status = 'suggested' AND person_tag_id IS NOT NULL"), twins).select("id")


@query("M13_refreshed", "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN caption END, title) AS title FROM photos")
def refreshed(c):
    new = c.photos.filter("id % 2 = 0").select("id", F.col("caption").alias("title"))
    return mu.refreshed(c.photos.select("id", "title"), new, "id", ["title"])


@query("M16_D23_person_gone", "SELECT id, CASE WHEN person_tag_id = 1002 THEN NULL WHEN person_tag_id = 1004 THEN 1005 ELSE person_tag_id END AS person_tag_id, CASE WHEN person_tag_id = 1002 THEN 'unconfirmed' ELSE status END AS status FROM faces")
def person_gone(c):
    left = mu.update_where(c.faces, F.col("person_tag_id") == 1002, status=F.lit("unconfirmed"), person_tag_id=F.lit(None).cast("int"))
    return mu.merged_person(left, 1004, 1005).select("id", "person_tag_id", "status")


@query("M11_O07_saved_searches", "SELECT l_suppkey AS id, 'search ' || CAST(l_suppkey AS VARCHAR) AS name, count(*) > 600 AS pinned FROM lineitem GROUP BY 1 ORDER BY pinned DESC, name LIMIT 40")
def saved_searches(c):
    rows = c.table("lineitem").groupBy(F.col("l_suppkey").alias("id")).agg((F.count("*") > 600).alias("pinned"))
    return rows.select("id", F.concat(F.lit("search "), F.col("id").cast("string")).alias("name"), "pinned").orderBy(F.desc("pinned"), "name").limit(40)


def _legacy(c):
    from .legacy_import import run_import

    orders, lines = c.table("orders"), c.table("lineitem")
    images = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 120).alias("album"), F.concat(F.lit("i"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("name"), F.when(F.col("o_orderstatus") == "P", 3).otherwise(1).alias("status"), F.lit("h").alias("uniqueHash"))
    albums = c.table("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/"), "s_name").alias("relativePath"))
    comments = lines.filter("l_linenumber < 4").select(F.col("l_orderkey").alias("imageid"), F.col("l_linenumber").alias("type"), F.col("l_returnflag").alias("comment"))
    tags = c.table("region").select((F.col("r_regionkey") + 1).alias("id"), F.lit(0).alias("pid"), F.when(F.col("r_regionkey") == 2, "People").otherwise(F.col("r_name")).alias("name"))
    tags = tags.union(c.table("nation").select(F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, F.concat(F.lit("N "), (F.col("n_nationkey") % 2).cast("string"))))
    image_tags = lines.select(F.col("l_orderkey").alias("imageid"), (F.col("l_suppkey") % 30 + 100).cast("int").alias("tagid"))
    return run_import(images, albums, comments, tags, image_tags, lines.select(F.col("l_orderkey").alias("imageid"), (F.col("l_suppkey") % 25 + 100).cast("int").alias("tagid"), F.when(F.col("l_linenumber") % 3 == 0, "tagRegion").when(F.col("l_linenumber") % 3 == 1, "ignoredFace").otherwise("other").alias("property"), F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.lit("2 30"), F.col("l_linenumber").cast("string")).alias("value")))


@query(
    "D15_imported_photos",
    "SELECT o_orderkey AS id, s_name AS album_path, (SELECT min(l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) AS title, (SELECT min(l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) AS caption FROM orders JOIN supplier ON s_suppkey = o_custkey % 120 WHERE o_orderstatus <> 'P'",
)
def imported_photos(c):
    return _legacy(c).photos.select("id", "album_path", "title", "caption")


@query(
    "D15_X08_imported_tags",
    "WITH n AS (SELECT n_nationkey + 100 AS id, n_regionkey + 1 AS parent_id, 'N_' || CAST(n_nationkey % 2 AS VARCHAR) AS label, row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 2 ORDER BY n_nationkey) AS k FROM nation), r AS (SELECT r_regionkey + 1 AS id, CASE WHEN r_regionkey = 2 THEN 'People' ELSE replace(r_name, ' ', '_') END AS path FROM region) SELECT id, path, FALSE AS is_person FROM r UNION ALL SELECT n.id, r.path || '.' || label || CASE WHEN k = 1 THEN '' ELSE '_' || CAST(k - 1 AS VARCHAR) END, r.path = 'People' FROM n JOIN r ON r.id = n.parent_id",
)
def imported_tags(c):
    return _legacy(c).tags.select("id", "path", "is_person")


@query(
    "D15_J14_skipped_links",
    "WITH a AS (SELECT DISTINCT l_orderkey AS p, l_suppkey % 30 + 100 AS t FROM lineitem) SELECT count(*) FILTER (WHERE t > 124 OR p NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 120 IN (SELECT s_suppkey FROM supplier))) AS skipped FROM a",
)
def skipped_links(c):
    return _legacy(c).skipped


@query(
    "D15_A25_imported_faces",
    "WITH p AS (SELECT l_orderkey AS photo_id, l_suppkey % 25 + 100 AS person_tag_id, min(CASE l_linenumber % 3 WHEN 0 THEN 1 ELSE 4 END) AS rank FROM lineitem WHERE l_linenumber % 3 < 2 GROUP BY 1, 2) SELECT photo_id, CAST(person_tag_id AS INT) AS person_tag_id, CASE rank WHEN 1 THEN 'confirmed' ELSE 'ignored' END AS status FROM p WHERE photo_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 120 IN (SELECT s_suppkey FROM supplier))",
)
def imported_faces(c):
    return _legacy(c).faces.select("photo_id", "person_tag_id", "status")
