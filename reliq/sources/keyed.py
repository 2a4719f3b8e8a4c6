"""Keyed tables whose upserts rewrite only the buckets they touch.

A table is split into a fixed number of buckets by a hash of its key. Its state is one small *manifest* file, which names the folder of
every bucket, the schema, and the last batch of every writer:

    <root>/<name>/data/<write>/key_bucket=<n>/... parquet files, never changed once written
    <root>/<name>/data/layer=<number>/...         rows put on top of the buckets by one commit
    <root>/<name>/manifests/<number>.json         one file per commit, renamed into place
    <root>/<name>/latest                          a hint: the number of a commit that exists

A reader opens ``latest``, steps on to the newest manifest by its number, and reads the folders that it names; no folder is listed to find
out what counts. A commit fails if another writer took its number (``ConcurrentWrite``), so no update is lost. A batch that a writer has
committed already is skipped, which makes replayed micro-batches harmless, counters included.

``merge`` rewrites the touched buckets. ``put`` and ``remove`` rewrite nothing: they add a layer, and the topmost layer of a key counts. A batch
whose keys lie in all buckets costs its own size that way, however large the table. Layers are folded into the buckets once there are as many
as were folded before (``LAYERS`` at least), so that folding costs a constant share of what was put.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reliq.session import run_dir

BUCKETS = 32
#: Layers that may lie on the buckets before they are folded.
LAYERS = 64


class ConcurrentWrite(RuntimeError):
    """Another writer committed first; read again and repeat."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], buckets: int = BUCKETS, base: int = 0):
        """``buckets`` counts when the table is made; ``base`` is the number below its first manifest."""
        self.spark, self.path, self.key, self._new_buckets, self.base = spark, path.rstrip("/"), tuple(key), buckets, base

    # -- files ------------------------------------------------------------

    def _path(self, relative: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{relative}")

    def _fs(self):
        return self._path("data").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self, relative: str) -> str | None:
        fs, path = self._fs(), self._path(relative)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _save(self, relative: str, text: str) -> None:
        stream = self._fs().create(self._path(relative), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()

    # -- manifests --------------------------------------------------------

    def version(self) -> int:
        """Number of the newest commit, ``base`` if there is none."""
        hint = self._load("latest")
        number = int(hint) if hint else self.base
        fs = self._fs()
        while fs.exists(self._path(f"manifests/{number + 1}.json")):
            number += 1
        return number

    def exists(self) -> bool:
        return self.version() > self.base

    def manifest(self, version: int | None = None) -> dict | None:
        text = self._load(f"manifests/{self.version() if version is None else version}.json")
        return json.loads(text) if text else None

    def _commit(self, number: int, manifest: dict) -> int:
        draft = f"manifests/.{uuid.uuid4().hex}"
        self._save(draft, json.dumps(manifest, sort_keys=True))
        jvm = self.spark._jvm
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(draft).toUri(), self.spark._jsc.hadoopConfiguration())
        target = self._path(f"manifests/{number}.json")
        try:
            files.rename(self._path(draft), target, no_overwrite)
        except Exception as error:
            self._fs().delete(self._path(draft), False)
            if self._fs().exists(target):
                raise ConcurrentWrite(f"commit {number} of {self.path} was taken") from error
            raise
        self._save("latest", str(number))
        return number

    # -- reading ----------------------------------------------------------

    def _bucket(self, count: int):
        return F.pmod(F.xxhash64(*self.key), F.lit(count)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no table in {self.path}")
        return self._rows(manifest, only)

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        return self._topmost(manifest, only) if manifest.get("layers") else self._base(manifest, only)

    def _base(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [folder for bucket, folder in manifest["folders"].items() if only is None or int(bucket) in only]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for folder in folders])

    def _stacked(self, manifest: dict, columns: list[str]) -> DataFrame:
        """``columns`` of all rows of buckets (layer 0) and layers, replaced ones too; a removal holds its key only."""
        schema = StructType.fromJson(manifest["schema"])
        rows = self._base(manifest).select(*columns, F.lit(0).alias("layer"), F.lit(False).alias("gone"))
        layers = manifest.get("layers", [])
        if layers:
            held = self.spark.read.schema(StructType(schema.fields).add("layer", "integer").add("gone", "boolean")).option("basePath", f"{self.path}/data").parquet(
                *[f"{self.path}/{folder}" for folder in layers])
            rows = rows.unionByName(held.select(*columns, "layer", "gone"))
        return rows

    def _topmost(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        """The rows that count. Which keys have several rows is written first, so that the rows meet a table of known size."""
        key = list(self.key)
        columns = [field["name"] for field in manifest["schema"]["fields"]]
        several = self._stacked(manifest, key).groupBy(*key).agg(F.min("layer").alias("_first"), F.max("layer").alias("_last")).filter("_first < _last")
        path = f"{run_dir(self.spark)}/replaced-{uuid.uuid4().hex}"
        several.select(*key, "_last").write.parquet(path)
        rows = self._stacked(manifest, columns).filter("NOT gone").join(self.spark.read.parquet(path), key, "left")
        rows = rows.filter("_last IS NULL OR layer = _last").select(*columns)
        return rows if only is None else rows.filter(self._bucket(manifest["buckets"]).isin(only))

    def find(self, keys: DataFrame, columns: list[str]) -> DataFrame | None:
        """Key and ``columns`` of the rows with one of ``keys`` (distinct), of all rows only these columns are read; None without a table."""
        manifest = self.manifest()
        if manifest is None:
            return None
        key = list(self.key)
        near = self._stacked(manifest, [*key, *columns]).join(keys, key, "left_semi")
        newest = near.groupBy(*key).agg(F.max_by(F.struct("gone", *columns), "layer").alias("_r"))
        return newest.filter("NOT _r.gone").select(*key, *[F.col(f"_r.{c}").alias(c) for c in columns])

    # -- writing ----------------------------------------------------------

    def _write(self, rows: DataFrame, count: int) -> dict[str, str]:
        """Folder by bucket of the buckets that hold rows."""
        write = f"data/{uuid.uuid4().hex}"
        rows.withColumn("key_bucket", self._bucket(count)).repartition("key_bucket").write.partitionBy("key_bucket").parquet(f"{self.path}/{write}")
        found = self._fs().listStatus(self._path(write))
        names = [status.getPath().getName() for status in found]
        return {name.split("=")[1]: f"{write}/{name}" for name in names if name.startswith("key_bucket=")}

    def replace(self, rows: DataFrame) -> int:
        """All rows anew; what writers have committed stays known."""
        number = self.version()
        old = self.manifest(number)
        count = old["buckets"] if old else self._new_buckets
        return self._commit(number + 1, {
            "buckets": count, "schema": json.loads(rows.schema.json()), "folders": self._write(rows, count), "writers": old["writers"] if old else {}})

    def merge(self, batch: DataFrame, merged: Callable[[DataFrame | None, DataFrame], DataFrame], writer: str | None = None,
              batch_id: int | None = None, start: DataFrame | None = None) -> int | None:
        """Commit ``merged(stored rows of the touched buckets, batch)``; returns the commit, or None if nothing had to be done.

        ``batch`` is read twice, so hand over a stored one; its keys decide which buckets are touched, and ``merged`` may change, add or
        drop rows of these buckets only. ``writer`` and ``batch_id``: skip a batch that is not newer than the writer's last. ``start``:
        rows of a table that has no commit yet; they are taken over whole by the first one.
        """
        number = self.compact()
        old = self.manifest(number)
        if old is None and start is not None:
            number = self.replace(start)
            old = self.manifest(number)
        writers = dict(old["writers"]) if old else {}
        if writer is not None and batch_id is not None and batch_id <= writers.get(writer, -1):
            return None
        count = old["buckets"] if old else self._new_buckets
        # At most one number per bucket reaches the driver.
        touched = sorted(row[0] for row in batch.select(self._bucket(count).alias("bucket")).distinct().collect())
        if writer is not None and batch_id is not None:
            writers[writer] = batch_id
        elif not touched:
            return None
        if not touched and old is None:
            rows = merged(None, batch)
            return self._commit(number + 1, {"buckets": count, "schema": json.loads(rows.schema.json()), "folders": {}, "writers": writers})
        if not touched:
            return self._commit(number + 1, {**old, "writers": writers})
        rows = merged(self._rows(old, touched) if old else None, batch)
        kept = {b: folder for b, folder in old["folders"].items() if int(b) not in touched} if old else {}
        return self._commit(number + 1, {
            "buckets": count, "schema": json.loads(rows.schema.json()), "folders": kept | self._write(rows, count), "writers": writers})

    def put(self, rows: DataFrame, columns: list[str], when: str) -> str:
        """Commit ``columns`` of the rows where ``when`` holds as a layer; returns the folder of all that was written, the other rows too.

        ``rows`` has one row per key, none of them null, and is read once. Without a row to commit there is no commit.
        """
        return self._layer(rows, rows.select(*columns).schema, when, "false")

    def remove(self, keys: DataFrame) -> None:
        """Drop the rows of ``keys`` (distinct)."""
        old = self.manifest()
        if old is not None:
            self._layer(keys.select(*self.key).withColumn("gone_now", F.lit(True)), StructType.fromJson(old["schema"]), "gone_now", "true")

    def _layer(self, rows: DataFrame, schema: StructType, when: str, gone: str) -> str:
        number = self.version()
        old = self.manifest(number) or {"buckets": self._new_buckets, "folders": {}, "writers": {}}
        if len(old.get("layers", [])) >= max(LAYERS, old.get("folded", 0)):
            number = self.compact()
            old = self.manifest(number)
        write = f"data/layer={number + 1}/write={uuid.uuid4().hex}/gone={gone}"
        rows.withColumnRenamed(when, "counts").write.option("compression", "zstd").partitionBy("counts").parquet(f"{self.path}/{write}")
        if self._fs().exists(self._path(f"{write}/counts=true")):
            self._commit(number + 1, {**old, "schema": json.loads(schema.json()), "layers": [*old.get("layers", []), f"{write}/counts=true"]})
        return f"{self.path}/{write}"

    def compact(self) -> int:
        """Fold all layers into the buckets; returns the newest commit."""
        number = self.version()
        old = self.manifest(number)
        if not old or not old.get("layers"):
            return number
        return self._commit(number + 1, {**old, "layers": [], "folded": old.get("folded", 0) + len(old["layers"]), "folders": self._write(self._rows(old), old["buckets"])})

    def vacuum(self, keep: int = 2) -> int:
        """Delete data folders that none of the newest ``keep`` commits names, for a table whose writers rest; returns how many."""
        newest = self.version()
        kept = [self.manifest(v) for v in range(max(newest - keep, self.base) + 1, newest + 1)]
        named = {folder.split("/")[1] for m in kept for folder in [*m["folders"].values(), *m.get("layers", [])]}
        fs = self._fs()
        if not fs.exists(self._path("data")):
            return 0
        stale = [s.getPath() for s in fs.listStatus(self._path("data")) if s.getPath().getName() not in named]
        for path in stale:
            fs.delete(path, True)
        return len(stale)
