"""Queries of sources, codecs, sinks and the log stream, in its batch form and streamed."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators.lineage import drop_path, fresh_path
from quarrymill.sources import files
from quarrymill.streaming import logs

from .base import query


@query("S08_resumed", "SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-20')")
def resumed(c):
    orders = c.table("orders").select("o_orderkey", "o_orderdate")
    return files.resumed(orders, orders.filter(F.col("o_orderdate") < F.lit("1995-01-20").cast("timestamp_ntz")), "o_orderkey").select("o_orderkey")


@query("S09_values", "SELECT q, vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, (VALUES (1, list_transform(range(64), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), (2, list_transform(range(64), lambda i: CASE WHEN i = 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) t(q, v)")
def values(c):
    from quarrymill.functions.scalars import dot

    asked = files.values(c.spark, [(1, [float(i == 0) for i in range(64)]), (2, [float(i == 5) for i in range(64)])], "q int, v array<double>")
    return c.table("embeddings").crossJoin(F.broadcast(asked)).select("q", "vec_id", F.round(dot(F.col("embedding"), F.col("v")), 6).alias("score"))  # two rows


@query("S10_P02_payloads", "SELECT id, '{\"filename\":\"' || filename || '\",\"rating\":' || CAST(rating AS VARCHAR) || CASE WHEN title IS NULL THEN '' ELSE ',\"title\":\"' || title || '\"' END || '}' AS payload FROM photos WHERE file_sync_dirty")
def payloads(c):
    return files.payloads(c.photos.filter("file_sync_dirty"), "id", ["filename", "rating", "title"])


@query("S12_codec", "SELECT vec_id, TRUE AS same, CAST(len(embedding) * 4 AS INT) AS n_bytes FROM embeddings")
def codec(c):
    rows = c.table("embeddings").withColumn("raw", files.vector_to_bytes(F.col("embedding")))
    return rows.select("vec_id", (files.vector_from_bytes(F.col("raw")) == F.col("embedding")).alias("same"), F.octet_length("raw").alias("n_bytes"))


@query("S12_literal", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.6f}', CAST(x AS DOUBLE))), ',') || ']' AS literal FROM embeddings")
def literal(c):
    return c.table("embeddings").select("vec_id", files.vector_literal(F.transform("embedding", lambda x: x.cast("double"))).alias("literal"))


@query("S13_backfilled", "SELECT vec_id, CASE WHEN vec_id % 3 <> 2 THEN len(embedding) END AS n FROM embeddings")
def backfilled(c):
    rows = c.table("embeddings")
    raw = files.vector_to_bytes(F.col("embedding"))
    rows = rows.withColumn("raw", F.when(F.col("vec_id") % 3 == 2, F.substring(raw, 1, 40)).otherwise(raw)).withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.col("embedding")))
    return files.backfilled(rows, "raw", "embedding", 64).select("vec_id", F.size("embedding").cast("long").alias("n")).withColumn("n", F.when(F.col("n") > 0, F.col("n")))


@query(
    "T02_T03_coalesced",
    """
WITH k AS (SELECT sha1(CAST(level AS VARCHAR) || '|' || logger_name || '|' || left(trim(regexp_replace(regexp_replace(message, '\\b\\d+(?:\\.\\d+)?\\b', 'N', 'g'), '/[^\\s]+', 'PATH', 'g')), 512)) AS fingerprint, ts, level FROM app_logs),
s AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY fingerprint ORDER BY ts) + INTERVAL 600 SECOND THEN 1 ELSE 0 END AS starts FROM k),
n AS (SELECT *, sum(starts) OVER (PARTITION BY fingerprint ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM s)
SELECT fingerprint, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, max(level) AS level FROM n GROUP BY fingerprint, part""",
)
def coalesced(c):
    found = logs.coalesced(c.app_logs, "600 seconds")
    return found.select("fingerprint", "occurrences", F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen_at").cast("timestamp_ntz").alias("last_seen"), "level")


@query("T06_united", "SELECT source, count(*) AS n, count(level) AS with_level FROM (SELECT source, level FROM app_logs WHERE source = 'python' UNION ALL SELECT 'stderr', NULL FROM app_logs WHERE source = 'stderr') GROUP BY 1")
def united(c):
    python = c.app_logs.filter("source = 'python'").select("ts", "source", "level", "message")
    stderr = logs.stderr_records(c.app_logs.filter("source = 'stderr'").select("ts", F.col("message").alias("value")))
    return logs.united(python, stderr).groupBy("source").agg(F.count("*").alias("n"), F.count("level").alias("with_level"))


@query("T09_high_water", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id < 5000)")
def high_water(c):
    done = c.table("events").filter("event_id < 5000").select(F.col("ts").alias("mark"))
    return logs.since_mark(c.table("events"), done, "ts").select("event_id")


def _written(c):
    """Payloads of all photos as text files."""
    path = fresh_path(c.spark, "payloads")
    files.write_payloads(files.payloads(c.photos, "id", ["id", "filename", "rating"]), path)
    return path


@query("S04_S05_walked_files", "SELECT id, filename FROM photos")
def walked_files(c):
    found = files.walk(c.spark, _written(c), ("txt",), content=True)
    lines = found.select(F.explode(F.split(F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")), "\n")).alias("line"))
    return lines.select(F.get_json_object("line", "$.id").cast("int").alias("id"), F.get_json_object("line", "$.filename").alias("filename"))


@query("S06_metadata_lines", "SELECT id, filename, CAST(coalesce(rating, 0) AS INT) AS rating FROM photos")
def metadata_lines(c):
    get = lambda n: F.get_json_object("exif", f"$.{n}")
    return files.read_metadata(c.spark, _written(c)).select(get("id").cast("int").alias("id"), get("filename").alias("filename"), F.coalesce(get("rating").cast("int"), F.lit(0)).alias("rating"))


@query("S11_M07_reloaded", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def reloaded(c):
    path = fresh_path(c.spark, "table")
    orders = c.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    for status in ("O", "F"):
        files.write_table(orders.filter(F.col("o_orderstatus") == status).drop("o_orderstatus"), path)
    return c.spark.read.parquet(path)


@query("T04_T08_batches", "SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def batches(c):
    """Committed batches of a stream handed to a function, each filtered and written; all of them read back."""
    source, out = fresh_path(c.spark, "stream"), fresh_path(c.spark, "batches")
    events = c.table("events").select("event_id", "event_type")
    events.repartition(4).write.parquet(source)
    least = events.agg(F.min("event_type")).first()[0]
    stream = logs.read_log_files(c.spark, source, events.schema, most_files=2)
    logs.for_each_batch(stream, lambda batch, n: batch.filter(F.col("event_type") == least).select("event_id").write.mode("overwrite").parquet(f"{out}/batch={n}"), fresh_path(c.spark, "marks")).awaitTermination()
    return c.spark.read.parquet(out).select("event_id")


@query(
    "T01_streamed_sessions",
    """
WITH k AS (SELECT fingerprint_of.f AS fingerprint, ts FROM (SELECT sha1(CAST(level AS VARCHAR) || '|' || logger_name || '|' || left(trim(regexp_replace(regexp_replace(message, '\\b\\d+(?:\\.\\d+)?\\b', 'N', 'g'), '/[^\\s]+', 'PATH', 'g')), 512)) AS f, ts FROM app_logs) AS fingerprint_of),
s AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY fingerprint ORDER BY ts) + INTERVAL 5 SECOND THEN 1 ELSE 0 END AS starts FROM k),
n AS (SELECT *, sum(starts) OVER (PARTITION BY fingerprint ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM s)
SELECT fingerprint, count(*) AS occurrences, min(ts) AS first_seen FROM n GROUP BY fingerprint, part""",
)
def streamed_sessions(c):
    """The log sink over a stream; a last record a day later closes all sessions before it."""
    source, out = fresh_path(c.spark, "logs"), fresh_path(c.spark, "sessions")
    rows = c.app_logs.select(F.col("ts").cast("timestamp").alias("ts"), "level", "logger_name", "message")
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select("ts", F.lit(0).cast(dict(rows.dtypes)["level"]).alias("level"), F.lit("end").alias("logger_name"), F.lit("end").alias("message"))
    rows.unionByName(last).write.parquet(source)
    logs.write_coalesced(logs.read_log_files(c.spark, source, rows.schema, most_files=1_000_000), out, fresh_path(c.spark, "marks"), once=True).awaitTermination()
    return c.spark.read.parquet(out).filter("message <> 'end'").select("fingerprint", "occurrences", F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen"))


@query("T07_counters", "SELECT count(*) AS records FROM events")
def counters(c):
    source = fresh_path(c.spark, "stream")
    events = c.table("events").select("event_id")
    events.write.parquet(source)
    done = logs.for_each_batch(logs.read_log_files(c.spark, source, events.schema), lambda batch, n: batch.write.format("noop").mode("append").save(), fresh_path(c.spark, "marks"))
    done.awaitTermination()
    return files.values(c.spark, [(int(logs.counters(done)["rows"]),)], "records long")


def _slices(rows, n=3):
    """Rows (ts) in n stretches of time."""
    edge = rows.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    at = F.floor((F.unix_micros("ts") - edge["lo"]) * n / (edge["hi"] - edge["lo"] + 1)) if edge["lo"] is not None else F.lit(0)
    return [rows.filter(at == k) for k in range(n)]


@query(
    "T02_T07_open_rows",
    """
WITH k AS (SELECT f AS fingerprint, ts, level FROM (SELECT sha1(CAST(level AS VARCHAR) || '|' || logger_name || '|' || left(trim(regexp_replace(regexp_replace(message, '\\b\\d+(?:\\.\\d+)?\\b', 'N', 'g'), '/[^\\s]+', 'PATH', 'g')), 512)) AS f, ts, level FROM app_logs)),
s AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY fingerprint ORDER BY ts) + INTERVAL 600 SECOND THEN 1 ELSE 0 END AS starts FROM k),
n AS (SELECT *, sum(starts) OVER (PARTITION BY fingerprint ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM s)
SELECT fingerprint, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, max(level) AS level FROM n GROUP BY fingerprint, part""",
)
def open_rows(c):
    """The sink's table after a stream that was stopped and started again twice."""
    from quarrymill.streaming import sink

    source, marks = fresh_path(c.spark, "logs"), fresh_path(c.spark, "marks")
    table = sink.new_table(c.spark, fresh_path(c.spark, "sink"), 8)
    rows = c.app_logs.select(F.col("ts").cast("timestamp").alias("ts"), "level", "logger_name", "message")
    for part in _slices(rows):
        part.write.mode("append").parquet(source)
        stream = logs.read_log_files(c.spark, source, rows.schema, most_files=1_000_000)
        sink.write_open_rows(stream, table, marks, gap_seconds=600, once=True).awaitTermination()
    table.vacuum()
    drop_path(c.spark, source)
    return table.read().select("fingerprint", "occurrences", F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen_at").cast("timestamp_ntz").alias("last_seen"), "level")


@query(
    "S14_T06_T07_captured_lines",
    """
WITH l AS (SELECT CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN 'warn: tag 40094 of ' || event_type ELSE event_type || ' at ' || CAST(user_id AS VARCHAR) END AS v FROM events),
k AS (SELECT v, trim(v) = '' AS blank, contains(v, 'tag 40094') AS stopped FROM l)
SELECT 'read' AS what, count(*) AS n FROM k UNION ALL SELECT 'blank', count(*) FROM k WHERE blank UNION ALL SELECT 'blocked', count(*) FROM k WHERE stopped UNION ALL SELECT 'queued', count(*) FROM k WHERE NOT blank AND NOT stopped
UNION ALL SELECT CASE WHEN starts_with(v, 'error') THEN 'ERROR' ELSE 'INFO' END, count(*) FROM k WHERE NOT blank AND NOT stopped GROUP BY 1""",
)
def captured_lines(c):
    """Lines that come in two steps, read once each; what was counted on the way, and what was stored."""
    from quarrymill.sources.growing import growing_lines

    folder, out, marks = (fresh_path(c.spark, n) for n in ("lines", "captured", "marks"))
    e = c.table("events")
    line = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 7 == 1, "  ").when(F.col("event_id") % 7 == 2, F.concat(F.lit("warn: tag 40094 of "), "event_type")).otherwise(F.concat_ws(" ", "event_type", F.lit("at"), F.col("user_id").cast("string")))
    found: dict[str, int] = {}
    for k in (0, 1):
        e.filter(F.col("event_id") % 2 == k).select(line.alias("value")).write.mode("append").text(folder)
        done = logs.captured(growing_lines(c.spark, folder, ".txt")).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        done.awaitTermination()
        for name, n in logs.observed(done).items():
            found[name] = found.get(name, 0) + n
    drop_path(c.spark, folder)
    stored = c.spark.read.parquet(out).groupBy(F.col("level_name").alias("what")).agg(F.count("*").alias("n"))
    return files.values(c.spark, sorted(found.items()), "what string, n long").unionByName(stored)


@query(
    "D12_M13_applied_scan",
    """
WITH o AS (SELECT id, album_path, title, rating FROM photos WHERE id % 7 <> 2), d AS (SELECT id, album_path, CASE WHEN id % 2 = 0 THEN caption END AS title, CASE WHEN id % 3 = 0 THEN 5 ELSE rating END AS rating FROM photos WHERE id % 5 <> 1)
SELECT coalesce(o.id, d.id) AS id, coalesce(o.album_path, d.album_path) AS album_path, coalesce(d.title, o.title) AS title, coalesce(d.rating, o.rating) AS rating FROM o FULL JOIN d ON o.id = d.id WHERE d.id IS NOT NULL OR NOT o.album_path LIKE 'Trip%'""",
)
def applied_scan(c):
    """A table of photos brought to what a scan of the disk found: new rows, refreshed ones, and those gone from one folder."""
    from quarrymill.sources.tables import ManifestTable, apply_scan

    known = c.photos.filter("id % 7 <> 2").select("id", "album_path", "title", "rating")
    table = ManifestTable.create(known, fresh_path(c.spark, "photos"), ["id"], 16)
    disk = c.photos.filter("id % 5 <> 1").select("id", "album_path", F.when(F.col("id") % 2 == 0, F.col("caption")).alias("title"), F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("rating")).alias("rating"))
    apply_scan(table, disk, F.startswith("album_path", F.lit("Trip")), ["title", "rating"])
    table.vacuum()
    return table.read()


@query("M01_M05_in_place", "SELECT id, CASE WHEN id % 10 = 3 THEN 9 ELSE rating END AS rating FROM photos WHERE id % 25 <> 4 AND (id % 2 = 0 OR id % 10 = 3)")
def in_place(c):
    from quarrymill.sources.tables import ManifestTable, deleting, upserting

    rows = c.photos.select("id", "rating")
    table = ManifestTable.create(rows.filter("id % 2 = 0"), fresh_path(c.spark, "ratings"), ["id"], 16)
    table.change(rows.filter("id % 10 = 3").withColumn("rating", F.lit(9)), upserting(["id"]))
    table.change(rows.filter("id % 25 = 4"), deleting(["id"]))
    table.vacuum()
    return table.read()


@query(
    "S10_written_payloads",
    """
WITH tg AS (SELECT photo_id, list(name ORDER BY tag_id) AS names, list(replace(path, '.', '|') ORDER BY tag_id) AS paths FROM photo_tags JOIN tags ON tag_id = tags.id GROUP BY 1),
fc AS (SELECT photo_id, list(t.name ORDER BY f.id) AS persons, count(*) AS n, arg_min(round((f.x + f.w / 2) / 641, 6), f.id) AS x1, arg_min(round(f.h / 487, 6), f.id) AS h1 FROM faces f JOIN tags t ON t.id = f.person_tag_id GROUP BY 1),
p AS (SELECT ph.*, coalesce(tg.names, []) AS names, coalesce(tg.paths, []) AS paths, list_filter(list_distinct(coalesce(fc.persons, [])), lambda x: NOT list_contains(coalesce(tg.names, []), x)) AS more, fc.n, fc.x1, fc.h1 FROM photos ph LEFT JOIN tg ON tg.photo_id = ph.id LEFT JOIN fc ON fc.photo_id = ph.id WHERE file_sync_dirty)
SELECT '/lib/' || album_path || '/' || filename AS source, CAST(len(names) + len(more) AS INT) AS n_subjects, nullif(names[1], '') AS subject, CASE WHEN len(paths) > 0 THEN paths[1] END AS hierarchical, CAST(least(rating, 5) * 20 AS INT) AS percent,
CASE color_label WHEN 1 THEN 'Red' WHEN 2 THEN 'Orange' WHEN 3 THEN 'Yellow' END AS label, title, caption, CAST(coalesce(n, 0) AS INT) AS n_regions, x1, h1, (SELECT count(*) FROM photos WHERE file_sync_dirty) AS written, 2 AS failed FROM p""",
)
def written_payloads(c):
    """Payloads of the dirty photos by the sink, with two rows that are none; read back, with the counts."""
    from quarrymill.sources import metadata as md

    folder = fresh_path(c.spark, "payloads")
    dirty = c.photos.filter("file_sync_dirty").withColumns({"width": F.lit(641), "height": F.lit(487)})
    bad = files.values(c.spark, [("{\"Title\":\"no file\"}",), ("no object",)], "payload string")
    md.write_payload_table(md.photo_payloads(dirty, c.tags, c.photo_tags, c.faces, "/lib").select("payload").union(bad), folder)
    counts = md.write_counts(c.spark, folder)
    schema = "SourceFile string, Subject array<string>, HierarchicalSubject array<string>, RatingPercent int, Label string, Title string, Description string, RegionInfo struct<RegionList: array<struct<Area: struct<X: double, H: double>, Name: string>>>"
    got = md.read_payloads(c.spark, folder).select(F.from_json("payload", schema).alias("p")).select("p.*").withColumn("r", F.col("RegionInfo.RegionList"))
    first = F.get("r", F.lit(0))["Area"]
    one = lambda name: F.get(name, F.lit(0))
    return got.select(
        F.col("SourceFile").alias("source"), F.coalesce(F.size("Subject"), F.lit(0)).alias("n_subjects"), F.when(F.size("HierarchicalSubject") > 0, one("Subject")).alias("subject"), one("HierarchicalSubject").alias("hierarchical"), F.col("RatingPercent").alias("percent"), F.col("Label").alias("label"),
        F.col("Title").alias("title"), F.col("Description").alias("caption"), F.when(F.col("r").isNotNull(), F.size("r")).otherwise(0).alias("n_regions"), first["X"].alias("x1"), first["H"].alias("h1"), F.lit(counts["written"]).alias("written"), F.lit(counts["failed"]).alias("failed"),
    )
