"""A table of the latest versions in hash buckets: batches add deltas, readers merge them, compaction folds a bucket.

Below the table's path lie

    data/kind=delta/batch=<n>/bucket=<b>/    the rows of a batch, only in the buckets that it touches
    data/kind=base/batch=<n>/bucket=<b>/     what a bucket's deltas came to up to a batch
    manifest/<n>                             one JSON object: the batch, the number of buckets, each bucket's base and deltas after it

A manifest is written last, so a batch that fails half-way is not seen; one that runs again writes the same folders from
the manifest before it and gives the same table. No batch reads or rewrites the table: only buckets with many deltas are
folded, each by itself."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orarium.sources.sinks import delete

#: Deltas of a bucket from which on they are folded into a base; manifests that are kept for readers of older ones.
MOST_DELTAS, KEPT = 8, 2


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def later(old: Column, new: Column) -> Column:
    """What stays of a stored row and one that came after it: the stored one where its version is higher or its content is
    the same, else the new one."""
    return F.when((new["version"] < old["version"]) | (new["hash"] == old["hash"]), old).otherwise(new)


def folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key out of its versions (batch, version, hash, row), taken in the order of their batches.

    A key has at most one version in a base and in each delta, so the list that is folded is short."""
    versions = F.array_sort(F.collect_list(F.struct("batch", "version", "hash", "row")))
    start = F.get(F.col("v"), F.lit(0))
    return rows.groupBy("bucket", *keys).agg(versions.alias("v")).select("bucket", *keys, F.aggregate(F.slice("v", 2, F.greatest(F.size("v"), F.lit(1))), start, later).alias("v")).select("bucket", *keys, "v.*")


class BucketTable:
    """keys, version, content: names of columns; rows written have all of them, and may have more."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: str, content: list[str], buckets: int = 64, most_deltas: int = MOST_DELTAS):
        self.spark, self.path, self.keys, self.version, self.content, self.buckets, self.most_deltas = spark, path.rstrip("/"), keys, version, content, buckets, most_deltas

    def _store(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifests(self) -> list[int]:
        store, folder = self._store(), self._at("manifest")
        names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, before: int | None = None) -> dict:
        """The newest manifest (before a batch); an empty table without one."""
        found = [n for n in self.manifests() if before is None or n < before]
        if not found:
            return {"batch": -1, "buckets": self.buckets, "base": {}, "deltas": {}}
        return json.loads(self.spark.sparkContext._jvm.scala.io.Source.fromInputStream(self._store().open(self._at(f"manifest/{found[-1]}")), "UTF-8").mkString())

    def _publish(self, manifest: dict) -> None:
        """Under another name first, then renamed: a reader sees a whole manifest or none."""
        store, target = self._store(), self._at(f"manifest/{manifest['batch']}")
        part = self._at(f"manifest/_{manifest['batch']}")
        out = store.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        store.delete(target, False)
        store.rename(part, target)

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/data").schema(self._schema).parquet(*folders)

    def _packed(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows as stored: of each key the highest version of the batch (ties: by its text), with a digest of its content."""
        packed = rows.select(*self.keys, F.lit(batch).cast("long").alias("batch"), F.col(self.version).alias("version"), F.sha2(F.to_json(F.struct(*self.content)), 256).alias("hash"), F.struct(*rows.columns).alias("row"))
        return packed.groupBy(*self.keys).agg(F.max_by(F.struct("batch", "version", "hash", "row"), F.struct("version", "hash")).alias("v")).select(bucket_of(self.keys, self.buckets), *self.keys, "v.*")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Adds a batch; one that ran before under this number is written again in its place."""
        before = self.manifest(batch)
        packed = self._packed(rows, batch)
        self._schema = packed.schema
        folder = f"{self.path}/data/kind=delta/batch={batch}"
        packed.drop("batch").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        store = self._store()
        touched = [s.getPath().getName().removeprefix("bucket=") for s in store.listStatus(self._at(f"data/kind=delta/batch={batch}")) if s.getPath().getName().startswith("bucket=")]
        manifest = {"batch": batch, "buckets": self.buckets, "base": dict(before["base"]), "deltas": {b: list(n) for b, n in before["deltas"].items()}}
        for b in touched:
            manifest["deltas"].setdefault(b, []).append(batch)
        full = [b for b, n in manifest["deltas"].items() if len(n) >= self.most_deltas]
        if full:
            self._merged(manifest, full).drop("batch").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/kind=base/batch={batch}")
            for b in full:
                manifest["base"][b], manifest["deltas"][b] = batch, []
        self._publish(manifest)
        self._clean()

    def _folders(self, manifest: dict, buckets: list[str] | None = None) -> list[str]:
        wanted = set(manifest["base"]) | set(manifest["deltas"]) if buckets is None else set(buckets)
        bases = [f"{self.path}/data/kind=base/batch={n}/bucket={b}" for b, n in manifest["base"].items() if b in wanted]
        return bases + [f"{self.path}/data/kind=delta/batch={n}/bucket={b}" for b, many in manifest["deltas"].items() if b in wanted for n in many]

    def _merged(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        return folded(self._read(self._folders(manifest, buckets)), self.keys)

    def read(self) -> DataFrame | None:
        """The table as of the newest manifest, merged while it is read; None before the first batch."""
        manifest = self.manifest()
        folders = self._folders(manifest)
        if not folders:
            return None
        if not hasattr(self, "_schema"):
            own = self.spark.read.option("basePath", f"{self.path}/data").parquet(folders[0])
            self._schema = own.schema
        return self._merged(manifest).select("row.*")

    def _clean(self) -> None:
        """Old manifests go, and the folders of batches that no kept one names."""
        found = self.manifests()
        for n in found[:-KEPT]:
            delete(self.spark, f"{self.path}/manifest/{n}")
        kept = [self.manifest(n + 1) for n in found[-KEPT:]]
        named = {"base": {n for m in kept for n in m["base"].values()}, "delta": {n for m in kept for many in m["deltas"].values() for n in many}}
        store = self._store()
        for kind, still in named.items():
            if store.exists(self._at(f"data/kind={kind}")):
                for s in store.listStatus(self._at(f"data/kind={kind}")):
                    n = int(s.getPath().getName().removeprefix("batch="))
                    if n not in still and n < found[-1]:
                        delete(self.spark, f"{self.path}/data/kind={kind}/batch={n}")


def bucket_sink(path: str, keys: list[str], version: str, content: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a delta of the table at the path."""

    def write(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            BucketTable(rows.sparkSession, path, keys, version, content, buckets).write(rows, batch)

    return write
