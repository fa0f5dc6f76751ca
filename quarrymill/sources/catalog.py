"""Catalog tables (photos, tags, faces, logs, ...) as views over the driver's Parquet tables.

The driver has no photo library, so each catalog table is derived from one of its tables. The derivations are SQL in a
dialect that Spark and DuckDB share, so that a query and its check start from the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_YMD = "lpad(CAST(year(o_orderdate) AS STRING), 4, '0') || '{0}' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '{0}' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
_YEAR = "CAST(year(o_orderdate) AS STRING)"
_MONTH = "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"
_KEY = "CAST(o_orderkey AS STRING)"

VIEWS: dict[str, str] = {
    "photos": f"""
SELECT o_orderkey AS id,
       CASE o_orderkey % 8 WHEN 0 THEN 'IMG_' || {_YMD.format("")} || '_' || {_KEY} || '.jpg' WHEN 1 THEN 'scan ' || {_YMD.format("-")} || '.jpg' WHEN 2 THEN '_dsc' || {_KEY} || CASE o_orderkey % 5 WHEN 0 THEN '.X3F' WHEN 1 THEN '.cr3' WHEN 2 THEN '.jpg' ELSE '.nef' END
            WHEN 3 THEN '_dsc' || CAST(o_orderkey - 1 AS STRING) || '.jpg' WHEN 4 THEN '_dsc' || CAST(o_orderkey - 2 AS STRING) || '-edit.jpg' WHEN 5 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'clip' || {_KEY} || '.flv' ELSE 'PXL_' || {_YMD.format("")} || CASE WHEN o_orderkey % 3 = 1 THEN '.mp4' ELSE '.WMV' END END
            WHEN 6 THEN 'Holiday (' || {_KEY} || ').PNG' ELSE 'noname' END AS filename,
       CASE WHEN o_orderkey % 8 = 2 THEN 'Trip/' || CAST(o_custkey % 3 AS STRING) || '/RAW' WHEN o_orderkey % 8 IN (3, 4) THEN 'Trip/' || CAST(o_custkey % 3 AS STRING) WHEN o_custkey % 4 = 0 THEN 'AB_TO_SORT/' || {_YEAR}
            WHEN o_custkey % 4 = 1 THEN 'Ordered by Dates/' || {_YEAR} || '/' || {_YEAR} || '-' || {_MONTH} WHEN o_custkey % 4 = 2 THEN 'Ordered by Dates/' || {_YEAR} ELSE 'Events/' || substring(o_orderpriority, 3, 20) END AS album_path,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'h' || CAST(o_custkey AS STRING) END AS sha256,
       CAST(floor(o_totalprice) AS BIGINT) AS file_size,
       CASE o_orderstatus WHEN 'F' THEN 'image' WHEN 'O' THEN 'raw' ELSE 'video' END AS media_type,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS taken_at,
       o_orderdate + INTERVAL 40 DAY AS imported_at,
       CAST(o_orderkey % 6 AS INT) AS rating,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Order ' || {_KEY} END AS title,
       CASE WHEN o_orderkey % 9 = 1 THEN lower(o_orderpriority) || ' at the Market' END AS caption,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS color_label,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 170 - 85 AS DOUBLE) + 0.25 END AS latitude,
       CASE WHEN o_orderkey % 10 < 2 THEN NULL ELSE CAST(o_custkey % 350 - 175 AS DOUBLE) + 0.5 END AS longitude,
       CASE WHEN o_custkey % 4 = 3 THEN NULL ELSE 'C' || CAST(o_custkey % 5 AS STRING) END AS country_code,
       CASE WHEN o_custkey % 6 = 0 THEN '' ELSE 'State ' || CAST(o_custkey % 7 AS STRING) END AS state,
       CAST(o_orderkey % 21 AS INT) AS camera_id, CAST(o_orderkey % 13 AS INT) AS lens_id,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL 50 DAY END AS meta_synced_at,
       o_orderkey % 5 = 1 AS file_sync_dirty,
       CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderdate + INTERVAL 60 DAY END AS faces_scanned_at,
       CASE WHEN o_orderkey % 8 = 5 AND o_orderkey % 16 = 5 THEN 12.5 END AS duration_secs,
       CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 1 END AS INT) AS status,
       CASE WHEN o_orderkey % 19 = 0 THEN CAST(o_orderkey % 50 AS BIGINT) END AS stack_id
FROM {{orders}}""",
    "tags": """
SELECT 1 AS id, 'Places' AS name, 'Places' AS path, CAST(NULL AS INT) AS parent_id, FALSE AS is_person
UNION ALL SELECT 2, 'People', 'People', CAST(NULL AS INT), FALSE
UNION ALL SELECT 10 + r_regionkey, r_name, 'Places.' || replace(r_name, ' ', '_'), 1, FALSE FROM {region}
UNION ALL SELECT 100 + n_nationkey, n_name, 'Places.' || replace(r_name, ' ', '_') || '.' || n_name, 10 + n_regionkey, FALSE FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT CAST(1000 + s_suppkey AS INT), s_name || CASE WHEN s_suppkey % 9 = 0 THEN ' - TWINS' ELSE '' END, 'People.' || replace(s_name, '#', '_'), 2, TRUE FROM {supplier}""",
    "photo_tags": "SELECT DISTINCT l_orderkey AS photo_id, CAST(100 + l_suppkey % 25 AS INT) AS tag_id FROM {lineitem}",
    "faces": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS photo_id,
       CASE WHEN (l_orderkey + l_linenumber) % 5 = 4 THEN NULL ELSE CAST(1000 + min(l_suppkey) AS INT) END AS person_tag_id,
       CAST(min(l_partkey) % 400 AS INT) AS x, CAST(min(l_partkey) % 300 AS INT) AS y, CAST(min(l_quantity) AS INT) * 4 AS w,
       CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE CAST(max(l_quantity) AS INT) * 5 END AS h,
       CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'suggested' WHEN 2 THEN 'unconfirmed' WHEN 3 THEN 'ignored' ELSE 'unknown' END AS status,
       CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE min(l_discount) * 10 END AS det_score,
       CASE WHEN l_orderkey % 4 = 1 THEN NULL ELSE max(l_extendedprice) / 1000 END AS blur_score,
       CASE WHEN l_orderkey % 7 = 2 THEN NULL ELSE 0.4 + max(l_tax) * 6 END AS best_match_score,
       min(l_shipdate) AS created_at
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # The photo_id of every face, once or more: what asks only whether a photo has faces needs no groups.
    "face_photo_ids": "SELECT l_orderkey AS photo_id FROM {lineitem}",
    "cameras": "SELECT CAST(p_partkey AS INT) AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS make, p_name AS model FROM {part} WHERE p_partkey < 21",
    "lenses": "SELECT CAST(p_partkey AS INT) AS id, p_type AS make, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS model FROM {part} WHERE p_partkey < 13",
    "vectors": """
SELECT vec_id, embedding, label, CASE WHEN vec_id % 10 < 5 THEN 'confirmed' WHEN vec_id % 10 = 5 THEN 'ignored' WHEN vec_id % 10 = 6 THEN 'suggested' ELSE 'unconfirmed' END AS status,
       vec_id % 97 AS photo_id, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE CAST(vec_id % 10 AS DOUBLE) / 10 + 0.05 END AS det_score, CAST(20 + vec_id % 61 AS INT) AS w, CASE WHEN vec_id % 31 = 0 THEN NULL ELSE CAST(25 + vec_id % 47 AS INT) END AS h,
       CASE WHEN vec_id % 17 = 0 THEN NULL ELSE CAST(vec_id % 29 AS DOUBLE) END AS blur_score, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(vec_id % 7 AS DOUBLE) / 7 END AS best_match_score FROM {embeddings}""",
    "app_logs": """
SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 30 WHEN 'signup' THEN 20 ELSE 10 END AS level,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'signup' THEN 'INFO' ELSE 'DEBUG' END AS level_name,
       CASE WHEN user_id % 2 = 0 THEN 'python' ELSE 'stderr' END AS source, 'app.' || event_type AS logger_name,
       event_type || ' ' || CAST(user_id % 4 AS STRING) || ' at /srv/data/' || CAST(event_id AS STRING) || ' took ' || CAST(event_id % 50 AS STRING) || '.5 ms' AS message, user_id
FROM {events}""",
    "copies": """
SELECT d.doc_id AS id, text AS content, source, lang, n_chars AS size, 'src' || CASE WHEN doc_id % 3 = 0 THEN '/a' ELSE '/b' END AS album_path,
       CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'AB_TO_SORT/' || lang WHEN source IN ('src3', 'src4', 'src5', 'src6') THEN 'Ordered by Dates/' || lang ELSE 'Events/' || source END AS folder
FROM {documents} d""",
}
#: Views that are grouped or joined by a table's column: by which the rows may be dealt out beforehand.
DEALT = {"photo_tags": {"lineitem": "l_orderkey"}, "faces": {"lineitem": "l_orderkey"}, "face_photo_ids": {"lineitem": "l_orderkey"}}
TASK_ROWS = 500_000  # of a dealt table, in one partition
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Catalog:
    """The driver tables and the catalog views of one data folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._rows = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        """Scan of one table; columns and filters are pushed into it."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, name: str, key: str) -> DataFrame:
        """One table by a key, in partitions of about TASK_ROWS rows however many there are (the count comes from the files' footers).

        What is grouped or joined by the key then holds no more in a task as the table grows; without it, adaptive
        execution puts as many rows into a task as 64 MB of shuffle hold, which for a few numbers a row are many millions.
        """
        rows = self.table(name)
        if name not in self._rows:
            self._rows[name] = rows.count()
        return rows.repartition(max(self.spark.sparkContext.defaultParallelism, -(-self._rows[name] // TASK_ROWS)), key)

    def view(self, name: str) -> DataFrame:
        text, keys = VIEWS[name], DEALT.get(name, {})
        return self.spark.sql(text, **{t: self.dealt(t, keys[t]) if t in keys else self.table(t) for t in sorted(set(re.findall(r"\{(\w+)\}", text)))})

    @cached_property
    def photos(self) -> DataFrame:
        return self.view("photos")

    @cached_property
    def tags(self) -> DataFrame:
        return self.view("tags")

    @cached_property
    def photo_tags(self) -> DataFrame:
        return self.view("photo_tags")

    @cached_property
    def faces(self) -> DataFrame:
        return self.view("faces")

    @cached_property
    def face_photo_ids(self) -> DataFrame:
        return self.view("face_photo_ids")

    @cached_property
    def cameras(self) -> DataFrame:
        return self.view("cameras")

    @cached_property
    def lenses(self) -> DataFrame:
        return self.view("lenses")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.view("vectors")

    @cached_property
    def app_logs(self) -> DataFrame:
        return self.view("app_logs")

    @cached_property
    def copies(self) -> DataFrame:
        return self.view("copies")


def with_views(sql: str) -> str:
    """A DuckDB query with the catalog views that it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = ", ".join(f"{v} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[v])})" for v in used)
    if not parts:
        return sql
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {head[1] or ''}{parts}, {sql[head.end() :]}" if head else f"WITH {parts} {sql}"
