"""Loads that rewrite only the source files that changed, and repairs that start from a named state.

A source table is a CSV file or a folder of CSV files.  Each file becomes a folder of Parquet of its own, and a
manifest says which folders are live.  A file with the length and time it had is not read; one
with another time is read for its digest, and written again only if its content differs.  The digest does not depend on the
order of lines: a table's rows have none.

Nothing live is ever overwritten: readers keep the folders they began with, and a named snapshot is a manifest with a
name, given once, which later loads do not touch.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folio.schemas import SPINE_TABLES, declared
from folio.sources.manifest import Manifests
from folio.sources.spine import CORRUPT, read_csv, write_table


class SpineStore:
    """The stored spine below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifests = Manifests(spark, f"{self.folder}/manifest")

    # ---- source files ------------------------------------------------------------------

    def source_files(self, source: str, table: str) -> dict[str, tuple[str, str]]:
        """Each CSV file of a table: its path, and its length and time."""
        path = self.manifests.path(f"{source}/{table}.csv")
        fs = path.getFileSystem(self.manifests.configuration)
        if not fs.exists(path):
            return {}
        found = fs.listStatus(path)
        files = [f for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
        return {f.getPath().getName(): (f.getPath().toString(), f"{f.getLen()}:{f.getModificationTime()}") for f in files}

    def digest(self, path: str) -> str:
        """Number of lines and two sums of their hashes."""

        def total(salt: int) -> Column:
            return F.coalesce(F.sum(F.xxhash64(F.lit(salt), "value").cast("decimal(20,0)")), F.lit(0))

        row = self.spark.read.text(path).agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).first()
        return f"{row.n}:{row.a}:{row.b}"

    # ---- load --------------------------------------------------------------------------

    def newest(self) -> int:
        """The number of the newest manifest; 0 before the first load."""
        numbers = self.manifests.numbers()
        return numbers[-1] if numbers else 0

    def _content(self, number: int) -> dict:
        return self.manifests.read(number)["files"] if number else {}

    def load(self, source: str, tenant: str, tables: tuple[str, ...] = SPINE_TABLES) -> list[str]:
        """Bring a tenant's tables up to date with its source folder; the files that were written or dropped."""
        number = self.newest()
        old = self._content(number)
        new = {k: v for k, v in old.items() if k.split("/")[0] != tenant or k.split("/")[1] not in tables}
        changed = []
        for table in tables:
            for name, (path, stamp) in self.source_files(source, table).items():
                key = f"{tenant}/{table}/{name}"
                known = old.get(key)
                if known and known["stamp"] == stamp:
                    new[key] = known
                    continue
                digest = self.digest(path)
                if known and known["digest"] == digest:
                    new[key] = known | {"stamp": stamp}
                    continue
                folder = f"{self.folder}/data/{table}/{uuid.uuid4().hex[:16]}"
                write_table(read_csv(self.spark, path, table).drop(CORRUPT).withColumn("tenant_id", F.lit(tenant)), folder, table)
                new[key] = {"stamp": stamp, "digest": digest, "folder": folder}
                changed.append(key)
        changed += [k for k in old if k not in new]
        if new != old:
            self.manifests.publish(number + 1, {"files": new})
        return sorted(changed)

    # ---- read ----------------------------------------------------------------------------

    def tables(self, number: int | None = None, names: tuple[str, ...] = SPINE_TABLES) -> dict[str, DataFrame]:
        """The tables as of a manifest, the newest by default; files with fewer columns have nulls."""
        files = self._content(self.newest() if number is None else number)
        out = {}
        for table in names:
            folders = sorted(v["folder"] for k, v in files.items() if k.split("/")[1] == table)
            if folders:
                parts = [self.spark.read.parquet(f) for f in folders]
                out[table] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if len({tuple(p.columns) for p in parts}) > 1 else self.spark.read.parquet(*folders)
            else:
                out[table] = self.spark.createDataFrame([], declared(table)).withColumn("tenant_id", F.lit(None).cast("string"))
        return out

    def snapshot(self, name: str) -> int:
        """Give the newest state a name, the first time only; the number that the name has."""
        path = f"{self.folder}/manifest/snapshot-{name}"
        if not self.manifests.fs.exists(self.manifests.path(path)):
            self.manifests.publish_file(path, {"number": self.newest()})
        return self.manifests.read_file(path)["number"]

    def tables_of(self, name: str, names: tuple[str, ...] = SPINE_TABLES) -> dict[str, DataFrame]:
        """The tables as they were when the snapshot was named: what a repair starts from, however often it runs."""
        return self.tables(self.snapshot(name), names)
