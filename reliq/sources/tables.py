"""Versioned parquet tables in one folder, any Hadoop file system.

Two kinds. A *snapshot* table is replaced whole: each write goes to a new
``v_<n>`` folder and counts once Spark has put its ``_SUCCESS`` mark there, so a
reader sees the old or the new version and never reads a path being written. A
*batch* table grows by ``b_<id>`` folders; writing a batch id again replaces that
batch only, which makes a retried streaming batch harmless. Tables in ``KEYED``
are upserted by key: ``keyed`` gives their bucketed form, and ``read`` and
``replace`` use it too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliq.sources.keyed import KeyedTable

SCHEMA_VERSION = 1
#: Tables that are upserted by key.
KEYED = {"incidents": ("key",), "failure_patterns": ("project", "signature")}
#: Batch tables whose batches are partitioned, always by the same columns.
PARTITIONED = {"test_cases": ("run_date",), "test_runs": ("run_date",)}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._marked = False
        self._check_version()

    # -- folders ---------------------------------------------------------

    def _committed(self, name: str, prefix: str) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        folders = []
        for status in fs.listStatus(path):
            folder = status.getPath()
            if folder.getName().startswith(prefix) and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
                folders.append(folder.toString())
        return folders

    def _snapshot(self, name: str) -> int:
        versions = [int(p.rsplit("v_", 1)[1]) for p in self._committed(name, "v_")]
        return max(versions, default=0)

    def version(self, name: str) -> int:
        return self.keyed(name).version() if name in KEYED else self._snapshot(name)

    def exists(self, name: str) -> bool:
        return self.version(name) > 0 or bool(self._committed(name, "b="))

    # -- snapshot tables --------------------------------------------------

    def _reader(self, schema: str | None):
        return self.spark.read if schema is None else self.spark.read.schema(schema)

    def read(self, name: str, version: int | None = None, schema: str | None = None) -> DataFrame:
        """A table; a partitioned one whose batches may all be empty needs its schema."""
        if name in KEYED:
            table = self.keyed(name)
            if (manifest := table.manifest(version)) is not None:
                return table._rows(manifest)
        current = self._snapshot(name) if version is None else version
        if current:
            return self.spark.read.parquet(f"{self.root}/{name}/v_{current}")
        batches = self._committed(name, "b=")
        if not batches:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        return self._reader(schema).option("basePath", f"{self.root}/{name}").parquet(*batches).drop("b")

    def read_or_none(self, name: str) -> DataFrame | None:
        return self.read(name) if self.exists(name) else None

    def replace(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        if name != "meta":
            self.mark_version()
        if name in KEYED:
            return self.keyed(name).replace(df)
        new = self.version(name) + 1
        # Left-overs of a failed write of the same number are overwritten.
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{name}/v_{new}")
        return new

    # -- keyed tables -------------------------------------------------------

    def keyed(self, name: str) -> KeyedTable:
        """The bucketed form of a table in ``KEYED``; its commits are numbered on from the snapshots an older store has."""
        return KeyedTable(self.spark, f"{self.root}/{name}", KEYED[name], base=self._snapshot(name))

    def merge(self, name: str, batch: DataFrame, merged: Callable[[DataFrame | None, DataFrame], DataFrame], writer: str | None = None,
              batch_id: int | None = None) -> int | None:
        """``KeyedTable.merge`` of a table in ``KEYED``; the first one takes over an older store's snapshot."""
        self.mark_version()
        table = self.keyed(name)
        start = self.spark.read.parquet(f"{self.root}/{name}/v_{table.base}") if table.base and not table.exists() else None
        return table.merge(batch, merged, writer, batch_id, start)

    # -- batch tables -------------------------------------------------------

    def append(self, name: str, df: DataFrame, batch_id: str | int, partition_by: tuple[str, ...] | None = None) -> None:
        self.mark_version()
        parts = PARTITIONED.get(name, ()) if partition_by is None else partition_by
        df.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.root}/{name}/b={batch_id}")

    def batch(self, name: str, batch_id: str | int, schema: str | None = None) -> DataFrame:
        """One batch of a batch table."""
        return self._reader(schema).parquet(f"{self.root}/{name}/b={batch_id}")

    def batches(self, name: str) -> list[str]:
        """Ids of the written batches, in their order."""
        return sorted(p.rsplit("/b=", 1)[1] for p in self._committed(name, "b="))

    def take_over(self, source: str, target: str) -> None:
        """The batches of ``source`` become those of ``target``, whose own go; for tables whose writers rest."""
        jvm = self.spark._jvm
        old, new = (jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}") for name in (target, source))
        fs = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)

    def has_batch(self, name: str, batch_id: str | int) -> bool:
        return any(p.rsplit("/", 1)[1] == f"b={batch_id}" for p in self._committed(name, "b="))

    def compact(self, name: str, batch_id: str) -> int:
        """Join all present batches into one, for a table whose writers rest; returns how many there were.

        The joined batch is complete before the old ones go. A crash in between leaves rows
        twice: run it again under the same id, which starts from the old batches.
        """
        old = [p for p in self._committed(name, "b=") if not p.endswith(f"/b={batch_id}")]
        if len(old) > 1:
            rows = self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*old).drop("b")
            parts = PARTITIONED.get(name)
            self.append(name, rows.repartition(*parts) if parts else rows, batch_id)
            for folder in old:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(old)

    # -- key/value state ------------------------------------------------------

    def set_meta(self, **values: str | None) -> None:
        rows = [(k, v) for k, v in values.items()]
        new = self.spark.createDataFrame(rows, "key string, value string")
        old = self.read_or_none("meta")
        if old is not None:
            new = old.join(new.select("key"), "key", "left_anti").unionByName(new)
        self.replace("meta", new.coalesce(1))

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        table = self.read_or_none("meta")
        row = None if table is None else table.filter(F.col("key") == key).select("value").head()
        return default if row is None or row[0] is None else row[0]

    # -- schema version -------------------------------------------------------

    def _check_version(self) -> None:
        found = self.get_meta("schema_version")
        if found is not None and int(found) > SCHEMA_VERSION:
            raise ValueError(f"tables in {self.root} have schema version {found}; this library reads up to {SCHEMA_VERSION}")

    def mark_version(self) -> None:
        """Written with the first table; a newer library's store is refused above."""
        if not self._marked:
            self._marked = True
            if self.get_meta("schema_version") is None:
                self.set_meta(schema_version=str(SCHEMA_VERSION))


def import_rows(source: DataFrame, target: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows of ``source`` whose key the target does not have yet, one per key."""
    fresh = source if target is None else source.join(target.select(*key), key, "left_anti")
    return fresh.dropDuplicates(key)


def import_tables(source: Store, target: Store, table_map: dict[str, tuple[str, list[str]]], label: str, dry_run: bool = False,
                  transforms: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Copy tables once: ``(table, rows)`` per target; a provenance entry stops a second run.

    ``table_map``: source table to (target table, key). An empty key appends all rows.
    ``transforms``: by source table, what its rows pass through first (such as ``recipes.backfill_relaxed_keys``), in a dry run too.
    """
    marker = f"migrated_from_{label}"
    spark = target.spark
    if not dry_run and target.get_meta(marker) is not None:
        return spark.createDataFrame([], "table string, rows bigint")
    reports = []
    for name, (into, key) in table_map.items():
        if not source.exists(name):
            continue
        rows = (transforms or {}).get(name, lambda table: table)(source.read(name))
        if dry_run:
            reports.append(rows.agg(F.count("*").alias("rows")).select(F.lit(into).alias("table"), "rows"))
            continue
        old = target.read_or_none(into)
        fresh = import_rows(rows, old, key) if key else rows
        merged = fresh if old is None else old.unionByName(fresh, allowMissingColumns=True)
        before = None if old is None else target.version(into)
        target.replace(into, merged)
        n_old = target.read(into, before).agg(F.count("*").alias("n")) if before else None
        n_new = target.read(into).agg(F.count("*").alias("rows"))
        added = n_new if n_old is None else n_new.join(n_old).select((F.col("rows") - F.col("n")).alias("rows"))
        reports.append(added.select(F.lit(into).alias("table"), "rows"))
    if not dry_run:
        target.set_meta(**{marker: source.root})
    if not reports:
        return spark.createDataFrame([], "table string, rows bigint")
    return reduce(DataFrame.unionByName, reports)
