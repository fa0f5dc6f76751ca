"""Tables that are changed in place: rows in hash buckets, and a manifest that names the live folder of each bucket.

A change reads and writes only the buckets that its keys fall into. New rows go to a folder of their own, and the
change takes effect when the next manifest is renamed into place, in one step; until then, and if the change
fails halfway, the table reads as before. Manifests are numbered without gaps, so of two changes at once the second one
fails instead of undoing the first. A change may carry a batch number: one that is not behind the last is not made
again, so a stream's batch can be repeated safely.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"


class ManifestTable:
    """A table at a path that the driver and all executors share. Keys decide the bucket; they must not be null."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int) -> ManifestTable:
        """A new table with these rows. Choose the number of buckets so that one holds some hundred MB."""
        table = cls(rows.sparkSession, path)
        if table._numbers():
            raise ValueError(f"there is a table at {path}")
        head = {"version": 0, "schema": rows.schema.jsonValue(), "keys": keys, "buckets": buckets, "batch": None}
        table._publish(head, table._written(rows, keys, buckets))
        return table

    # Manifests

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        files, at = self._files(), self._at(*parts)
        return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version."""
        numbers = self._numbers()
        if not numbers:
            raise ValueError(f"no table at {self.path}")
        at = self._at("manifests", f"{numbers[-1] if version is None else version:012d}.json")
        lines = self.spark.read.text(at.toString(), wholetext=True).first()
        return json.loads(lines[0])

    def _publish(self, head: dict, folders: dict[str, str]) -> None:
        """Rename a manifest into place; an error if there is one of its number."""
        jvm = self.spark._jvm
        text = json.dumps({**head, "folders": folders})
        draft, final = self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", f"{head['version']:012d}.json")
        stream = self._files().create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(context.makeQualified(draft), context.makeQualified(final), none)

    # Rows

    def _written(self, rows: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """Write rows to a new folder; the folder of every bucket that has some."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        return {n.split("=")[1]: f"{name}/{n}" for n in self._names(*name.split("/")) if n.startswith(f"{BUCKET}=")}

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows, or those of some buckets, of the newest or of an older version that was not vacuumed."""
        head = self.manifest(version)
        return self._rows(head, head["folders"] if buckets is None else {b: f for b, f in head["folders"].items() if int(b) in set(buckets)})

    def _rows(self, head: dict, folders: dict[str, str]) -> DataFrame:
        schema = T.StructType.fromJson(head["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders.values()])

    def find(self, **key) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        head = self.manifest()
        types = {f.name: f.dataType for f in T.StructType.fromJson(head["schema"])}
        row = self.spark.createDataFrame([tuple(key[k] for k in head["keys"])], T.StructType([T.StructField(k, types[k]) for k in head["keys"]]))
        bucket = row.select(bucket_of(head["keys"], head["buckets"])).first()[0]
        test = [F.col(k).eqNullSafe(F.lit(v).cast(types[k])) for k, v in key.items()]
        rows = self.read([bucket])
        for t in test:
            rows = rows.filter(t)
        return rows

    def change(self, changes: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> int:
        """Apply rule(old rows, changes) to the buckets of the changes' keys; how many buckets were written.

        The rule sees all rows of those buckets and gives the new ones; it must not move a row to another bucket.
        """
        head = self.manifest()
        if batch is not None and head["batch"] is not None and batch <= head["batch"]:
            return 0
        keys, n = head["keys"], head["buckets"]
        met = sorted(r[0] for r in changes.select(bucket_of(keys, n)).distinct().collect())  # numbers of buckets
        old = {b: f for b, f in head["folders"].items() if int(b) in set(met)}
        new = self._written(rule(self._rows(head, old), changes).select(*[f["name"] for f in head["schema"]["fields"]]), keys, n) if met else {}
        if set(map(int, new)) - set(met):
            raise ValueError("the rule moved rows to other buckets")
        kept = {b: f for b, f in head["folders"].items() if b not in old}
        self._publish({k: v for k, v in head.items() if k != "folders"} | {"version": head["version"] + 1, "batch": head["batch"] if batch is None else batch}, kept | new)
        return len(met)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that the last `keep` versions don't name, and older manifests; how many folders went."""
        numbers = self._numbers()
        live = {f for v in numbers[-keep:] for f in self.manifest(v)["folders"].values()}
        files, gone = self._files(), 0
        for name in self._names("data"):
            kept = {f for f in live if f.startswith(f"data/{name}/")}
            for part in self._names("data", name):
                if part.startswith(f"{BUCKET}=") and f"data/{name}/{part}" not in live:
                    files.delete(self._at("data", name, part), True)
                    gone += 1
            if not kept:
                files.delete(self._at("data", name), True)
        for v in numbers[:-keep]:
            files.delete(self._at("manifests", f"{v:012d}.json"), False)
        return gone


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


# Rules ------------------------------------------------------------------------------------------------------------------


def upserting(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows of the changes in place of those of their key, others added."""

    def rule(old: DataFrame, new: DataFrame) -> DataFrame:
        from quarrymill.operators.mutations import upsert

        return upsert(old, new, keys)

    return rule


def deleting(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows of the changes' keys go."""
    return lambda old, gone: old.join(gone.select(*keys).distinct(), keys, "left_anti")


def scanning(keys: list[str], refreshed: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Changes (state new, existing or removed): new rows are added, removed ones go, and of existing ones the refreshed columns are replaced where the scan has a value."""

    def rule(old: DataFrame, changes: DataFrame) -> DataFrame:
        seen = changes.select(*keys, "state", *[F.col(c).alias(f"__{c}") for c in old.columns if c not in keys])
        both = old.withColumn("__old", F.lit(True)).join(seen, keys, "full").filter("state IS NULL OR state <> 'removed'")
        value = lambda c: F.when(F.col("__old").isNull(), F.col(f"__{c}")).otherwise(F.coalesce(f"__{c}", c) if c in refreshed else F.col(c))
        return both.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys]).select(*old.columns)

    return rule


def apply_scan(table: ManifestTable, disk: DataFrame, scope: Column | None = None, refreshed: list[str] | None = None) -> dict[str, int]:
    """Bring a table to what a scan found: counts of rows added, updated and deleted.

    disk has the table's columns (a column that the scan doesn't know is null). Rows of the table that are not on disk go,
    if they lie in scope. Keys that the scan found unchanged in all refreshed columns are left alone, so their buckets
    are not written.
    """
    keys = table.manifest()["keys"]
    old = table.read()
    refreshed = [c for c in old.columns if c not in keys] if refreshed is None else refreshed
    inside = F.lit(True) if scope is None else scope
    d = disk.select(*keys, *[F.col(c).alias(f"__{c}") for c in old.columns if c not in keys], F.lit(True).alias("__disk")).dropDuplicates(keys)
    k = old.withColumns({"__old": F.lit(True), "__in": inside})
    both = k.join(d, keys, "full")
    differs = F.lit(False)
    for c in refreshed:
        differs = differs | (F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)))
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__disk").isNull(), F.when(F.col("__in"), "removed")).when(differs, "existing")
    changes = both.withColumn("state", state).filter("state IS NOT NULL").select(*keys, *[F.col(f"__{c}").alias(c) for c in old.columns if c not in keys], "state")
    from quarrymill.operators.lineage import shared_dir

    shared_dir(table.spark)
    counts, names = Observation(), {"new": "added", "existing": "updated", "removed": "deleted"}
    held = changes.observe(counts, *[F.count(F.when(F.col("state") == s, 1)).alias(n) for s, n in names.items()]).checkpoint(eager=True)
    table.change(held, scanning(keys, refreshed))
    return counts.get
