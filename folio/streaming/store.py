"""Keyed tables that streams keep up to date, with a manifest that names their live folders.

A table is a compacted copy (the base) and the batches since.  Each batch holds new versions of
the keys it touched: all rows of a key in its newest batch are its current rows.  Rows are
stored by bucket of their key, so that looking up some keys reads their buckets only.

Data are written to fresh folders first; a batch counts once a new manifest names its folder.
Manifests are numbered files, made under another name and renamed into place, and none is ever changed: a writer
that fails before the rename leaves folders that nothing refers to, and a batch that comes again
after the rename is recognised by its number.  After ``compact_every`` batches the current rows become a new
base.  Readers keep the folders of the manifest they started with; ``expire`` removes what the newest
manifests do not name.

A table has one writer at a time; of two that race for a manifest number, the second fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from folio.sources.manifest import Manifests

BUCKET, VERSION = "_bucket", "_version"
BUCKETS = 32
COMPACT_EVERY = 10


@dataclass
class Manifest:
    """What a table consists of: the base, the last batch in it, and the batches since."""

    number: int = 0
    schema: str | None = None
    base: str | None = None
    batches: list[tuple[int, str]] = field(default_factory=list)
    through: int = -1

    def folders(self) -> set[str]:
        return {p for _, p in self.batches} | ({self.base} if self.base else set())


class KeyedTable:
    """A table of rows by key below ``folder``, which all executors share."""

    def __init__(
        self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY, sort_by: tuple[str, ...] = (), files: int = 4
    ):
        self.spark, self.folder, self.keys, self.sort_by, self.files = spark, folder.rstrip("/"), keys, list(sort_by), files
        self.buckets, self.compact_every = buckets, compact_every
        self.manifests = Manifests(spark, f"{self.folder}/manifest")
        self.fs = self.manifests.fs

    # ---- manifests ------------------------------------------------------------------

    def _read(self, number: int) -> Manifest:
        content = self.manifests.read(number)
        return Manifest(number, content["schema"], content["base"], [tuple(b) for b in content["batches"]], content["through"])

    def manifest(self) -> Manifest:
        """The newest one; an empty table has none."""
        numbers = self.manifests.numbers()
        return self._read(numbers[-1]) if numbers else Manifest()

    def _publish(self, new: Manifest) -> None:
        self.manifests.publish(new.number, {"schema": new.schema, "base": new.base, "batches": new.batches, "through": new.through})

    # ---- writing ----------------------------------------------------------------------

    def through(self) -> int:
        """The newest batch that counts."""
        return self.manifest().through

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/data/{name}-{uuid.uuid4().hex[:12]}"
        # a busy bucket or key is spread over ``files`` files by the rows' own hash
        spread = df.repartition(F.col(BUCKET), F.pmod(F.xxhash64(*[c for c in df.columns if c != BUCKET]), F.lit(self.files)))
        # sorted files let readers skip row groups
        spread.sortWithinPartitions(BUCKET, *self.sort_by).write.partitionBy(BUCKET).parquet(path)
        return path

    def commit(self, rows: DataFrame, number: int) -> bool:
        """Make ``rows`` the current rows of their keys; False if the batch was counted before."""
        old = self.manifest()
        if number <= old.through:
            return False
        schema = rows.schema.json()
        if old.schema not in (None, schema):
            raise ValueError(f"batch {number} of {self.folder} has other columns than the table")
        path = self._write(self._bucketed(rows), f"batch-{number}")
        new = Manifest(old.number + 1, schema, old.base, [*old.batches, (number, path)], number)
        self._publish(new)
        if len(new.batches) >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> None:
        """Write the current rows as the new base."""
        old = self.manifest()
        if old.batches:
            base = self._write(self._bucketed(self._current(old)), f"base-{old.through}")
            self._publish(Manifest(old.number + 1, old.schema, base, [], old.through))

    def expire(self, keep: int = 2) -> list[str]:
        """Remove manifests but the newest ``keep``, and every folder that those do not name; returns these folders.

        Not for use while a batch is being written.
        """
        numbers = self.manifests.numbers()
        kept = set().union(*(self._read(n).folders() for n in numbers[-keep:])) if numbers else set()
        data = self.manifests.path(f"{self.folder}/data")
        found = [f"{self.folder}/data/{f.getPath().getName()}" for f in self.fs.listStatus(data)] if self.fs.exists(data) else []
        gone = [p for p in found if p not in kept]
        for n in numbers[:-keep]:
            self.manifests.remove(n)
        for path in gone:
            self.fs.delete(self.manifests.path(path), True)
        return gone

    # ---- reading ------------------------------------------------------------------------

    def _stored(self, manifest: Manifest, path: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest.schema)).add(BUCKET, IntegerType())
        return self.spark.read.schema(schema).parquet(path)

    def _current(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        if manifest.schema is None:
            raise ValueError(f"{self.folder} holds no batch yet")

        def stored(path: str) -> DataFrame:
            df = self._stored(manifest, path)
            return df if buckets is None else df.filter(F.col(BUCKET).isin(buckets))

        parts = []
        if manifest.batches:
            recent = reduce(DataFrame.unionByName, [stored(p).withColumn(VERSION, F.lit(n)) for n, p in manifest.batches])
            newest = recent.groupBy(BUCKET, *self.keys).agg(F.max(VERSION).alias(VERSION))
            on = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in self.keys]
            same_bucket = F.col(f"r.{BUCKET}") == F.col(f"n.{BUCKET}")
            live = recent.alias("r").join(newest.alias("n"), [*on, same_bucket, F.col(f"r.{VERSION}") == F.col(f"n.{VERSION}")], "left_semi")
            parts.append(live.drop(VERSION))
            if manifest.base:
                parts.append(stored(manifest.base).alias("r").join(newest.alias("n"), [*on, same_bucket], "left_anti"))
        elif manifest.base:
            parts.append(stored(manifest.base))
        return reduce(DataFrame.unionByName, parts).drop(BUCKET)

    def current(self) -> DataFrame:
        """The current rows of all keys."""
        return self._current(self.manifest())

    def current_of(self, wanted: DataFrame) -> DataFrame | None:
        """The current rows of some keys, from their buckets only; None while the table is empty."""
        manifest = self.manifest()
        if manifest.schema is None:
            return None
        # at most ``buckets`` small numbers
        buckets = sorted(r[0] for r in self._bucketed(wanted.select(*self.keys)).select(BUCKET).distinct().collect())
        held = self._current(manifest, buckets).alias("h")
        on = [F.col(f"h.{c}").eqNullSafe(F.col(f"w.{c}")) for c in self.keys]
        return held.join(wanted.select(*self.keys).alias("w"), on, "left_semi")
