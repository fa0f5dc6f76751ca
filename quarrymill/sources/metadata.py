"""The metadata sink: nested payloads of photos, and a data source that publishes a write as a whole or not at all.

Every task writes its payloads as JSON lines to a draft folder; the commit renames that folder once, so a reader sees all of
a write or nothing, and an abort deletes it. Rows that are no payload (no JSON object, or no source file) are
counted as failed and left out; the counts stand beside the data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "metadata_payloads"
#: Names of the colour labels.
LABELS = {1: "Red", 2: "Orange", 3: "Yellow", 4: "Green", 5: "Blue", 6: "Purple", 7: "Gray"}


# Payloads -----------------------------------------------------------------------------------------------------------------


def photo_payloads(photos: DataFrame, tags: DataFrame, photo_tags: DataFrame, faces: DataFrame, root: str) -> DataFrame:
    """id, payload of every photo (with width and height): one JSON object, fields without a value left out.

    Tags and the persons of faces (with a box, and a person or a region name) are subjects, persons that no tag
    names behind the tags; both in the order of ids. Face regions need the picture's size and a name.
    """
    names = tags.select(F.col("id").alias("t_id"), "name", "path")
    own = photo_tags.join(names, F.col("tag_id") == F.col("t_id")).groupBy(F.col("photo_id").alias("tp")).agg(F.array_sort(F.collect_list(F.struct("tag_id", "name", "path"))).alias("tags"))
    region = F.col("region_name") if "region_name" in faces.columns else F.lit(None).cast("string")
    boxed = faces.filter(F.col("x").isNotNull()).withColumn("region", region).join(names, F.col("person_tag_id") == F.col("t_id"), "left").withColumn("person", F.coalesce("name", "region"))
    named = boxed.filter(F.trim("person") != "").groupBy(F.col("photo_id").alias("fp")).agg(F.array_sort(F.collect_list(F.struct("id", "person", "x", "y", "w", "h"))).alias("faces"))
    rows = photos.join(own, F.col("id") == F.col("tp"), "left").join(named, F.col("id") == F.col("fp"), "left")
    none = F.expr("CAST(array() AS array<string>)")
    tag_names, persons = F.coalesce(F.transform("tags", lambda t: t["name"]), none), F.coalesce(F.transform("faces", lambda f: f["person"]), none)
    more = F.filter(F.array_distinct(persons), lambda p: ~F.array_contains(F.col("tag_names"), p))
    rows = rows.withColumns({"tag_names": tag_names, "tag_paths": F.coalesce(F.transform("tags", lambda t: F.replace(t["path"], F.lit("."), F.lit("|"))), none)}).withColumn("more", more)
    subjects = F.concat("tag_names", "more")
    paths = F.concat("tag_paths", F.transform("more", lambda p: F.concat(F.lit("People|"), F.replace(p, F.lit("/"), F.lit("|")))))
    filled = lambda c: F.when(F.size(c) > 0, c)
    rating = F.when(F.col("rating") >= 0, F.least(F.col("rating"), F.lit(5)))
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    w, h = F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))
    part = lambda value, whole: F.round(value / whole, 6)
    area = lambda f: F.struct(part(f["x"] + f["w"] / 2, w).alias("X"), part(f["y"] + f["h"] / 2, h).alias("Y"), part(f["w"], w).alias("W"), part(f["h"], h).alias("H"), F.lit("normalized").alias("Unit"))
    regions = F.transform("faces", lambda f: F.struct(area(f).alias("Area"), F.lit("Face").alias("Type"), f["person"].alias("Name")))
    sized = (w > 0) & (h > 0) & (F.size("faces") > 0)
    info = F.when(sized, F.struct(F.struct(w.alias("W"), h.alias("H"), F.lit("pixel").alias("Unit")).alias("AppliedToDimensions"), regions.alias("RegionList")))
    label = F.when(F.col("color_label") != 0, F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.col("color_label")), F.lit("")))
    source = F.concat_ws("/", F.lit(root.rstrip("/")), F.when(F.trim(F.col("album_path"), F.lit("/")) != "", F.trim(F.col("album_path"), F.lit("/"))), "filename")
    fields = {
        "SourceFile": source, "Subject": filled(subjects), "Keywords": filled(subjects), "HierarchicalSubject": filled(paths), "Rating": rating, "RatingPercent": rating * 20, "Label": label,
        "Title": text("title"), "Description": text("caption"), "Caption-Abstract": text("caption"), "RegionInfo": info,
    }
    return rows.select("id", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("payload"))


# The data source ----------------------------------------------------------------------------------------------------------


@dataclass
class Part(WriterCommitMessage):
    written: int
    failed: int


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class PayloadWriter(DataSourceWriter):
    """A write of one folder: drafts of tasks, one rename."""

    def __init__(self, folder: str) -> None:
        self.folder, self.name = folder.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Part:
        """One file a task, under a name of the attempt, so that what a lost attempt has written is not read.

        The draft folder is made before any task; a task that finds none is one of an aborted write, and must not make it again.
        """
        from pyspark import TaskContext

        context, lines, failed = TaskContext.get(), 0, 0
        files, root = _opened(self.folder)
        draft = f"{root}/.draft-{self.name}"
        if files.get_file_info(draft).type != fs.FileType.Directory:
            raise FileNotFoundError(f"{draft}: the write was aborted")
        name = f"{draft}/part-{context.partitionId():05d}-{context.taskAttemptId()}.json"
        with files.open_output_stream(name) as out:
            for row in iterator:
                try:
                    fine = bool(json.loads(row["payload"])["SourceFile"])
                except (TypeError, ValueError, KeyError):
                    fine = False
                if fine:
                    out.write(row["payload"].encode() + b"\n")
                lines, failed = lines + fine, failed + (not fine)
        return _Named(lines, failed, name.rsplit("/", 1)[1])

    def commit(self, messages: list) -> None:
        files, root = _opened(self.folder)
        draft, kept = f"{root}/.draft-{self.name}", {m.name for m in messages if m is not None}
        files.create_dir(draft, recursive=True)
        for info in files.get_file_info(fs.FileSelector(draft)):
            if info.base_name not in kept:
                files.delete_file(info.path)
        counts = {"written": sum(m.written for m in messages if m is not None), "failed": sum(m.failed for m in messages if m is not None)}
        with files.open_output_stream(f"{draft}/_counts") as out:
            out.write(json.dumps(counts).encode())
        files.move(draft, f"{root}/write-{self.name}")

    def abort(self, messages: list) -> None:
        files, root = _opened(self.folder)
        draft = f"{root}/.draft-{self.name}"
        if files.get_file_info(draft).type == fs.FileType.Directory:
            files.delete_dir(draft)


@dataclass
class _Named(Part):
    name: str


class Payloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "payload string"

    def writer(self, schema, overwrite: bool) -> PayloadWriter:
        made = PayloadWriter(self.options["path"])
        files, root = _opened(made.folder)
        files.create_dir(f"{root}/.draft-{made.name}", recursive=True)
        return made


def write_payload_table(rows: DataFrame, folder: str) -> None:
    """Write rows (payload) as one write of the folder; an error leaves the folder as it was."""
    rows.sparkSession.dataSource.register(Payloads)
    rows.select("payload").write.format(FORMAT).mode("append").save(folder)


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """payload of all writes of the folder."""
    return spark.read.schema("payload string").text(f"{folder.rstrip('/')}/write-*/part-*.json")


def write_counts(spark: SparkSession, folder: str) -> dict[str, int]:
    """Rows written and failed, of all writes of the folder."""
    total = {"written": 0, "failed": 0}
    files, root = _opened(folder.rstrip("/"))
    for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith("write-"):
            with files.open_input_file(f"{info.path}/_counts") as f:
                for k, v in json.loads(f.read()).items():
                    total[k] += v
    return total


def payload_field(name: str) -> Column:
    return F.get_json_object("payload", f"$['{name}']")
