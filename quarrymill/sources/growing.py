"""Lines of files that grow, as a stream (S14, T06): a Python data source whose offsets are byte positions.

Every file of a folder is read from where the last batch ended to its last line feed. Lines are read once: a batch that is
repeated reads the same bytes. A long stretch of a file is cut into parts of bounded size, each with the lines that begin
in it. The folder is any that pyarrow's file systems reach from driver and executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_lines"
SCHEMA = "path string, position long, value string"
PART_BYTES = 64 << 20
LOOK_BYTES = 1 << 16


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


@dataclass
class Stretch(InputPartition):
    """Bytes of a file; the lines that begin there are the partition's."""

    folder: str
    path: str
    start: int
    end: int
    first: bool  # whether a line begins at start for certain


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, part_bytes: int) -> None:
        self.folder, self.suffix, self.part_bytes = folder, suffix, part_bytes
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ends": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        """Of every file the place behind its last line feed."""
        files, root = _opened(self.folder)
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix) and not info.base_name.startswith(".") and info.size > self.known.get(info.path, 0):
                self.known[info.path] = self._last_line(files, info.path, self.known.get(info.path, 0), info.size)
        return {"ends": json.dumps({p: n for p, n in sorted(self.known.items()) if n})}

    @staticmethod
    def _last_line(files: fs.FileSystem, path: str, start: int, end: int) -> int:
        """The place behind the last line feed of a stretch, or its start."""
        with files.open_input_file(path) as f:
            while end > start:
                at = max(start, end - LOOK_BYTES)
                f.seek(at)
                found = f.read(end - at).rfind(b"\n")
                if found >= 0:
                    return at + found + 1
                end = at
        return start

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        before, out = json.loads(start["ends"]), []
        for path, stop in json.loads(end["ends"]).items():
            first = at = before.get(path, 0)
            self.known[path] = max(self.known.get(path, 0), stop)
            while at < stop:
                to = min(stop, at + self.part_bytes)
                out.append(Stretch(self.folder, path, at, to, at == first))
                at = to
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        """Lines that begin in the stretch, the last one to its end."""
        files, _ = _opened(partition.folder)
        with files.open_input_file(partition.path) as f:
            at = partition.start if partition.first else partition.start - 1
            f.seek(at)
            rest = b""
            skipping = not partition.first  # the line that the byte before belongs to is the other part's
            while True:
                block = f.read(LOOK_BYTES)
                if not block:
                    return
                rest += block
                lines = rest.split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if skipping:
                        skipping = False
                    elif at >= partition.end:
                        return
                    else:
                        yield (partition.path, at, line.decode("utf-8", "replace").rstrip("\r"))
                    at += len(line) + 1
                if at >= partition.end and not skipping:
                    return


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:  # noqa: N802
        return GrowingLinesReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("partbytes", PART_BYTES)))


def growing_lines(spark: SparkSession, folder: str, suffix: str = "", part_bytes: int = PART_BYTES) -> DataFrame:
    """path, position, value: the lines of all files below a folder as a stream. Bytes that are no UTF-8 are replaced."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(FORMAT).option("path", folder).option("suffix", suffix).option("partBytes", part_bytes).load()
