"""Queries of scalar functions (X*, D03, D13, D16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import scalars as sc
from quarrymill.operators import hierarchy

from .base import query


#: Extensions of all kinds, one of them for each id, to be classified.
_EXTENSIONS = "nef cr2 cr3 arw orf raf rw2 dng pef srw x3f 3fr jpg jpeg png gif bmp tif tiff webp heic heif mp4 mov avi mkv m4v mts mpg mpeg wmv webm flv 3gp nrw raw txt".split()
_LIST = "[" + ", ".join(f"'{e}'" for e in _EXTENSIONS) + "]"
_KIND = "CASE WHEN list_position(ext_list, ext) BETWEEN 1 AND 12 THEN 'raw' WHEN list_position(ext_list, ext) BETWEEN 13 AND 22 THEN 'image' WHEN list_position(ext_list, ext) BETWEEN 23 AND 34 THEN 'video' END".replace("ext_list", _LIST)
_MIME = "CASE ext WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'heic' THEN 'image/heic' WHEN 'm4v' THEN 'video/mp4' WHEN 'flv' THEN 'video/x-flv' WHEN 'mts' THEN 'video/mp2t' WHEN 'x3f' THEN 'image/x-sigma-x3f' WHEN '3fr' THEN 'image/x-hasselblad-3fr' WHEN 'nef' THEN 'image/x-nikon-nef' WHEN 'wmv' THEN 'video/x-ms-wmv' WHEN 'nrw' THEN 'application/octet-stream' WHEN 'txt' THEN 'application/octet-stream' WHEN '' THEN 'application/octet-stream' END"


@query(
    "X01_X02_X03_names",
    f"WITH n AS (SELECT id, CASE WHEN id % 2 = 0 THEN filename ELSE 'f.' || upper({_LIST}[1 + id % {len(_EXTENSIONS)}]) END AS f FROM photos), e AS (SELECT id, lower(regexp_replace(f, '\\.[^.]*$', '')) AS stem, lower(regexp_extract(f, '\\.([^.]+)$', 1)) AS ext FROM n) SELECT id, stem, ext, {_KIND} AS kind, {_MIME} AS mime FROM e",
)
def names(c):
    f = F.when(F.col("id") % 2 == 0, F.col("filename")).otherwise(F.concat(F.lit("f."), F.upper(F.get(F.array(*[F.lit(e) for e in _EXTENSIONS]), (F.col("id") % len(_EXTENSIONS)).cast("int")))))
    asked = sc.extension(f).isin("jpg", "png", "heic", "m4v", "flv", "mts", "x3f", "3fr", "nef", "wmv", "nrw", "txt", "")
    return c.photos.select("id", sc.stem(f).alias("stem"), sc.extension(f).alias("ext"), sc.media_kind(f).alias("kind"), F.when(asked, sc.mime(f)).alias("mime"))


@query("X05_raw_parent", "SELECT DISTINCT album_path, CASE WHEN album_path IN ('RAW', '/RAW') THEN '/' WHEN album_path LIKE '%/RAW' THEN left(album_path, length(album_path) - 4) END AS parent FROM photos")
def raw_parent(c):
    return c.photos.select("album_path").distinct().withColumn("parent", sc.raw_parent(F.col("album_path")))


@query("X06_X07_X08_sanitized", "SELECT s_name AS name, regexp_replace(s_name, '[^A-Za-z0-9_]', '_', 'g') AS api, regexp_replace(s_name, '[^A-Za-z0-9]', '_', 'g') AS file, left(trim(regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9]', '_', 'g'), '_+', '_', 'g'), '_'), 63) AS import FROM supplier")
def sanitized(c):
    n = F.col("s_name")
    return c.table("supplier").select(n.alias("name"), sc.sanitized_api(n).alias("api"), sc.sanitized_file(n).alias("file"), sc.sanitized_import(n).alias("import"))


@query("X09_subtree", "SELECT id, path FROM tags WHERE path = 'Places.ASIA' OR path LIKE 'Places.ASIA.%'")
def subtree(c):
    return hierarchy.subtree(c.tags, 12).select("id", "path")


@query("X10_rerooted", "SELECT id, 'World' || substring(path, length('Places') + 1) AS path FROM tags WHERE path = 'Places' OR path LIKE 'Places.%'")
def rerooted(c):
    return hierarchy.subtree(c.tags, 1).select("id", hierarchy.rerooted(F.col("path"), F.lit("Places"), F.lit("World")).alias("path"))


@query("X13_X14_X40_calendar", "SELECT id, CAST(year(taken_at) AS INT) AS y, CAST(month(taken_at) AS INT) AS m, CAST(taken_at AS DATE) AS d, CAST(date_trunc('month', taken_at) AS DATE) AS first_day, last_day(taken_at) AS last_day FROM photos WHERE taken_at IS NOT NULL")
def calendar(c):
    dated = c.photos.filter(F.col("taken_at").isNotNull()).select("id", F.year("taken_at").alias("y"), F.month("taken_at").alias("m"), F.to_date("taken_at").alias("d"))
    first, last = sc.month_range(F.col("y"), F.col("m"))
    return dated.select("*", first.alias("first_day"), last.alias("last_day"))


@query(
    "D03_X17_inferred_date",
    """
WITH s AS (SELECT id, regexp_replace(filename, '\\.[^.]*$', '') AS n, string_split(album_path, '/') AS parts FROM photos),
a AS (SELECT id, TRY_CAST(nullif(regexp_replace(regexp_extract(n, '(?:^|[^0-9])([0-9]{4}[-_][0-9]{2}[-_][0-9]{2})(?:[^0-9]|$)', 1), '_', '-', 'g'), '') AS DATE) AS f,
 regexp_extract(n, '(?:^|[^0-9])((?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))(?:[^0-9]|$)', 1) AS k,
 list_filter(parts, lambda p: regexp_full_match(p, '(19|20)[0-9]{2}([/-](0[1-9]|1[0-2]))?'))[-1] AS p FROM s),
b AS (SELECT id, f, TRY_CAST(CASE WHEN k <> '' THEN k[1:4] || '-' || k[5:6] || '-' || k[7:8] END AS DATE) AS g, TRY_CAST(CASE WHEN length(p) = 4 THEN p || '-01-01' ELSE p || '-01' END AS DATE) AS h, length(p) AS lp FROM a)
SELECT id, coalesce(f, g, h) AS inferred, CASE WHEN f IS NOT NULL THEN 'filename_ymd' WHEN g IS NOT NULL THEN 'filename_yyyymmdd' WHEN h IS NOT NULL THEN CASE WHEN lp = 4 THEN 'folder_year' ELSE 'folder_year_month' END END AS rule FROM b""",
)
def inferred_date(c):
    date, rule = sc.inferred_date(F.col("filename"), F.col("album_path"))
    return c.photos.select("id", date.alias("inferred"), rule.alias("rule"))


@query("X18_D25_destination", "SELECT id, CASE WHEN starts_with(filename, 'PXL_') AND length(filename) >= 12 THEN 'sorted/' || filename[5:8] || '/' || filename[9:10] WHEN taken_at IS NOT NULL THEN 'sorted/' || strftime(taken_at, '%Y/%m') ELSE 'sorted' END AS folder FROM photos")
def destination(c):
    return c.photos.select("id", sc.destination(F.col("filename"), F.col("taken_at"), "sorted").alias("folder"))


@query("X16_X19_X20_D13_exif", "SELECT id, taken_at, latitude, NULL::DOUBLE AS longitude, file_size, CAST(rating AS INT) AS rating, CASE color_label WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 4 END AS color FROM photos")
def exif(c):
    from .pipelines import exif_record

    label = F.when(F.col("color_label") == 1, "Red").when(F.col("color_label") == 2, "grey").when(F.col("color_label") == 3, "GREEN").otherwise("none such")
    raw = c.photos.select("id", F.to_json(F.struct(F.date_format("taken_at", "yyyy:MM:dd HH:mm:ss").alias("CreateDate"), F.col("latitude").cast("string").alias("GPSLatitude"), F.lit("undef").alias("GPSLongitude"), F.col("file_size").alias("FileSize"), F.col("rating").alias("Rating"), label.alias("Label"))).alias("exif"))
    return exif_record(raw, "exif").select("id", "taken_at", "latitude", "longitude", "file_size", "rating", F.col("color_label").alias("color"))


@query("X21_X38_bands", "SELECT id, least(greatest(rating - 1, 0), 5) AS rating, CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM (SELECT id, rating, rating / 5.0 AS s FROM photos)")
def bands(c):
    return c.photos.select("id", sc.rating(F.col("rating") - 1).alias("rating"), sc.confidence_band(F.col("rating") / 5.0).alias("band"))


@query("X22_X23_X26_boxes", "SELECT id, round((x + w / 2) / 641, 6) AS cx, round((y + h / 2) / 487, 6) AS cy, greatest(0, x - CAST(trunc(w * 0.2) AS INT)) AS crop_left, least(641, x + w + CAST(trunc(w * 0.2) AS INT)) AS crop_right FROM faces WHERE h IS NOT NULL")
def boxes(c):
    x, y, w, h = (F.col(k) for k in "xywh")
    parts, edges = sc.box_fractions(x, y, w, h, F.lit(641), F.lit(487)), sc.crop(x, y, w, h, F.lit(641), F.lit(487))
    return c.faces.filter(h.isNotNull()).select("id", parts[0].alias("cx"), parts[1].alias("cy"), edges[0].alias("crop_left"), edges[2].alias("crop_right"))


@query("X24_rects", "SELECT id, CAST(x + 0.5 AS DOUBLE) AS rx, CAST(y AS DOUBLE) AS ry, CAST(w + 0.25 AS DOUBLE) AS rw, CAST(h AS DOUBLE) AS rh FROM faces WHERE h IS NOT NULL UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM faces WHERE h IS NULL")
def rects(c):
    x, y, w, h = (F.concat(F.col(k).cast("string"), F.lit(more)) for k, more in zip("xywh", (".5", "", ".25", ".0"), strict=True))
    xml = F.concat(F.lit('<rect x="'), x, F.lit('" y="'), y, F.lit('"  width="'), w, F.lit('" height="'), h, F.lit('"/>'))
    json = F.concat(F.lit('{"width": '), w, F.lit(', "y": '), y, F.lit(', "x": '), x, F.lit(', "height": '), h, F.lit("}"))
    text = F.when(F.col("id") % 3 == 0, xml).when(F.col("id") % 3 == 1, json).otherwise(F.concat_ws("  ", x, y, w, h, F.lit("more")))
    kept = c.faces.withColumn("text", F.when(F.col("h").isNotNull(), text).otherwise("1 2 3"))
    made = kept.select("id", sc.rect_struct(F.col("text")).alias("r"))
    return made.select("id", *[F.col(f"r.{n}").alias(f"r{n[0]}") for n in ("x", "y", "width", "height")])


@query("X27_folder_tier", "SELECT id, CASE WHEN folder = 'AB_TO_SORT' OR starts_with(folder, 'AB_TO_SORT/') THEN 0 WHEN folder = 'Ordered by Dates' OR starts_with(folder, 'Ordered by Dates/') THEN 1 ELSE 2 END AS tier FROM copies")
def folder_tier(c):
    return c.copies.select("id", sc.folder_tier(F.col("folder")).alias("tier"))


@query(
    "X28_X29_fingerprints",
    "SELECT id, sha1(CAST(level AS VARCHAR) || '|' || logger_name || '|' || left(trim(regexp_replace(regexp_replace(message, '\\b\\d+(?:\\.\\d+)?\\b', 'N', 'g'), '/[^\\s]+', 'PATH', 'g')), 512)) AS fingerprint FROM app_logs",
)
def fingerprints(c):
    return c.app_logs.select("id", sc.fingerprint(F.col("level"), F.col("logger_name"), F.col("message")).alias("fingerprint"))


@query("X30_X31_unit_dot", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS own, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])), 6) AS third FROM embeddings")
def unit_dot(c):
    three = c.table("embeddings").filter("vec_id = 3").select(F.col("embedding").alias("e3"))
    rows = c.table("embeddings").crossJoin(F.broadcast(three))  # one row
    return rows.select("vec_id", F.round(sc.dot(sc.unit(F.col("embedding")), sc.unit(F.col("embedding"))), 6).alias("own"), F.round(sc.dot(F.col("embedding"), F.col("e3")), 6).alias("third"))


@query("X33_adaptive_threshold", "SELECT label, n, greatest(0.72, 0.77 - least(1.0, greatest(0.0, (n - 20) / 280.0)) * (0.77 - 0.72)) AS threshold FROM (SELECT label, count(*) AS n FROM vectors WHERE status = 'confirmed' GROUP BY label)")
def adaptive(c):
    counts = c.vectors.filter("status = 'confirmed'").groupBy("label").agg(F.count("*").alias("n"))
    return counts.select("label", "n", sc.adaptive_threshold(0.77, 0.72, F.col("n")).alias("threshold"))


@query(
    "X37_human",
    """
WITH v AS (SELECT id, rating, file_size * CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END // CASE WHEN id % 5 = 0 THEN 100000 ELSE 1 END AS b, CASE WHEN rating < 3 THEN CAST(rating AS DOUBLE) / 250 ELSE rating - 2.5 + (id % 2) * 0.5 END AS s, 1 + (id % 60) / 10.0 AS a FROM photos)
SELECT id, CASE WHEN b < 1024 THEN format('{} B', b) WHEN b < 1048576 THEN format('{:.1f} KB', round(b / 1024.0, 1)) WHEN b < 1073741824 THEN format('{:.1f} MB', round(b / 1048576.0, 1)) WHEN b < 1099511627776 THEN format('{:.1f} GB', round(b / 1073741824.0, 1)) ELSE format('{:.1f} TB', round(b / 1099511627776.0, 1)) END AS size,
format('{}:{:02d}', rating * 100 // 60, rating * 100 % 60) AS duration,
CASE WHEN s <= 0 THEN '—' WHEN s >= 1 THEN CASE WHEN s = floor(s) THEN CAST(CAST(s AS BIGINT) AS VARCHAR) ELSE format('{:.1f}', s) END || 's' ELSE '1/' || CAST(CAST(floor(1 / s + 0.5) AS BIGINT) AS VARCHAR) END AS shutter,
'f/' || CASE WHEN a = floor(a) THEN CAST(CAST(a AS BIGINT) AS VARCHAR) ELSE format('{:.1f}', CAST(a AS DOUBLE)) END AS aperture FROM v""",
)
def human(c):
    scale = F.when(F.col("id") % 4 == 0, 1).when(F.col("id") % 4 == 1, 1024).when(F.col("id") % 4 == 2, 1048576).otherwise(1073741824).cast("long")
    size = F.floor(F.col("file_size") * scale / F.when(F.col("id") % 5 == 0, 100000).otherwise(1)).cast("long")
    shutter = F.when(F.col("rating") < 3, F.col("rating").cast("double") / 250).otherwise(F.col("rating") - 2.5 + (F.col("id") % 2) * 0.5)
    return c.photos.select("id", sc.human_bytes(size).alias("size"), sc.human_duration(F.col("rating") * 100).alias("duration"), sc.human_shutter(shutter).alias("shutter"), sc.human_aperture(1 + F.col("id") % 60 / 10.0).alias("aperture"))


@query("X36_X39_twins", "SELECT id, contains(name, '- TWINS') AS twins, '/library/' || path || '/' || name AS disk_path FROM tags")
def twins(c):
    return c.tags.select("id", F.contains("name", F.lit("- TWINS")).alias("twins"), F.concat_ws("/", F.lit("/library"), "path", "name").alias("disk_path"))


@query(
    "X41_S14_guessed_level",
    "SELECT level_name, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE CASE event_id % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'DEBUG' ELSE 'INFO' END END AS level_name FROM events WHERE event_type <> 'signup') GROUP BY 1",
)
def guessed(c):
    """CRITICAL is no level word; FATAL is."""
    from quarrymill.streaming.logs import stderr_records

    k, by = F.col("event_id") % 4, F.col("event_type")
    word = F.when(by == "view", "Warn:").when(by.isin("error", "signup"), by).otherwise(F.when(k == 0, "CRITICAL").when(k == 1, "critical and Fatal").when(k == 2, "[debug] error").otherwise("errors"))
    line = F.concat_ws(" ", F.lit("[x]"), word, F.lit("at"), F.col("user_id"))
    return stderr_records(c.table("events").select(line.alias("value"), "ts"), "signup").groupBy("level_name").agg(F.count("*").alias("n"))


@query(
    "D16_D20_tag_depths",
    "WITH RECURSIVE tree(id, root, depth) AS (SELECT id, name, 1 FROM tags WHERE parent_id IS NULL UNION ALL SELECT t.id, tree.root, tree.depth + 1 FROM tags t JOIN tree ON t.parent_id = tree.id) SELECT id, root, CAST(depth AS BIGINT) AS depth FROM tree",
)
def depths(c):
    return hierarchy.depths(c.tags)


@query("D16_persons", "SELECT id, CAST(2 AS BIGINT) AS depth FROM tags WHERE parent_id = 2")
def persons(c):
    return hierarchy.persons(c.tags)


@query("X34_rounded", "SELECT l_orderkey, l_linenumber, CAST(format('{:.2f}', l_quantity / 8) AS DOUBLE) AS eighths, CAST(format('{:.2f}', l_quantity * l_discount / 8) AS DOUBLE) AS two, CAST(format('{:.4f}', l_extendedprice * l_tax / 7) AS DOUBLE) AS four FROM lineitem")
def rounded(c):
    q, d, e, t = (F.col(f"l_{n}").cast("double") for n in ("quantity", "discount", "extendedprice", "tax"))
    return c.table("lineitem").select("l_orderkey", "l_linenumber", sc.rounded(q / 8, 2).alias("eighths"), sc.rounded(q * d / 8, 2).alias("two"), sc.rounded(e * t / 7, 4).alias("four"))


@query("X15_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, date_trunc('second', ts) AS back, CAST(NULL AS TIMESTAMP) AS bad FROM events")
def iso_times(c):
    iso = sc.iso_text(F.col("ts"))
    utc = lambda t: t.cast("timestamp_ntz")
    return c.table("events").select("event_id", iso.alias("iso"), utc(sc.iso_time(F.concat(iso, F.lit("Z")))).alias("back"), utc(sc.iso_time(F.concat(F.lit("x"), iso))).alias("bad"))


@query("X04_imported_media", "SELECT id, CASE WHEN lower(regexp_extract(f, '[^.]*$')) IN ('mp4', 'mov', 'avi', 'mkv', 'wmv', 'flv', 'm4v', 'mts', 'm2ts', 'webm') THEN 'video' ELSE 'image' END AS media FROM (SELECT id, CASE id % 4 WHEN 0 THEN filename WHEN 1 THEN 'a.M2TS' WHEN 2 THEN 'b.mpg' ELSE 'mov' END AS f FROM photos)")
def imported_media(c):
    name = F.when(F.col("id") % 4 == 0, F.col("filename")).when(F.col("id") % 4 == 1, "a.M2TS").when(F.col("id") % 4 == 2, "b.mpg").otherwise("mov")
    return c.photos.select("id", sc.imported_media(name).alias("media"))


@query("X32_thresholds", "SELECT DISTINCT CAST(l_discount AS DOUBLE) AS d, CAST(format('{:.4f}', 0.9 - 0.2 * least(1.0, 12.0 * CAST(l_discount AS DOUBLE))) AS DOUBLE) AS threshold, CAST(format('{:.4f}', 0.08 - 0.05 * least(1.0, 12.0 * CAST(l_discount AS DOUBLE))) AS DOUBLE) AS margin, CAST(format('{:.4f}', 0.85 - 0.2 * least(1.0, 12.0 * CAST(l_discount AS DOUBLE))) AS DOUBLE) AS floor FROM lineitem")
def thresholds(c):
    rows = c.table("lineitem").select(F.col("l_discount").cast("double").alias("d")).distinct()
    return rows.select("d", *[x.alias(n) for n, x in zip(("threshold", "margin", "floor"), sc.threshold_columns(F.col("d") * 12.0), strict=True)])
