"""Tables of keyed rows in versions, each put in place by one manifest that only one writer can create.

A version is a manifest: a base part, the deltas on top of it, and the stream batches that are in. Writers
add a part (Parquet) and then create the next manifest; a part without a manifest is never read. Where the
manifest is taken, a writer that named the version it started from gets ``Conflict``; others try the next.

Reading gives a key's latest row: the one with the highest sequence value (``order``, where the table has one),
then the one of the latest version. A delta holds only the rows of its batch, one a key, so a batch of few keys
writes little; ``compact`` folds deltas into a new base once there are ``fold`` of them. A stream's batch that
comes again finds its id in the manifest and writes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parlance.sources.folders import create_json, names, read_json, remove


class Conflict(RuntimeError):
    """Another writer has committed since the version that was read."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, *keys: str, order: str | None = None, fold: int = 20):
        self.spark, self.path, self.keys, self.order, self.fold = spark, path, list(keys), order, fold

    # --- versions ---

    def version(self) -> int:
        """The newest version; -1 for a table without any."""
        found = [int(n[:-5]) for n in names(self.spark, f"{self.path}/versions") if n.endswith(".json")]
        return max(found, default=-1)

    def _manifest(self, version: int) -> dict:
        return read_json(self.spark, f"{self.path}/versions/{version:012d}.json") if version >= 0 else {"base": None, "deltas": [], "batches": {}, "schema": None}

    def _create(self, version: int, manifest: dict) -> bool:
        return create_json(self.spark, f"{self.path}/versions/{version:012d}.json", manifest)

    # --- reading ---

    def _parts(self, manifest: dict) -> DataFrame | None:
        schema = manifest["schema"] and StructType.fromJson(manifest["schema"])
        parts = ([manifest["base"]] if manifest["base"] else []) + manifest["deltas"]
        rows = None
        for name, version in parts:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/parts/{name}").withColumn("_version", F.lit(version))
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def _latest(self, rows: DataFrame, *tie: str) -> DataFrame:
        """One row a key: the highest by ``order``, then by ``tie``."""
        rest = [c for c in rows.columns if c not in self.keys]
        rank = F.struct(*([F.col(self.order)] if self.order else []), *tie)
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")) if rest else rows.select(*self.keys).distinct()
        return best.select(*(F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns))

    def _rows(self, manifest: dict) -> DataFrame | None:
        rows = self._parts(manifest)
        if rows is None:
            return None
        if manifest["deltas"]:
            rows = self._latest(rows, "_version")
        return rows.where(~F.col("_gone")).drop("_gone", "_version")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest, if none is named)."""
        rows = self._rows(self._manifest(self.version() if version is None else version))
        if rows is None:
            raise FileNotFoundError(f"{self.path} has no version yet")
        return rows

    # --- writing ---

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.hint("rebalance").write.option("compression", "zstd").parquet(f"{self.path}/parts/{name}")
        return name

    def _commit(self, part: str, schema: dict, expected: int | None, stream: tuple[str, int] | None) -> int | None:
        """Create the next manifest with the part on top; the version, or None where the stream's batch is in already."""
        while True:
            now = self.version()
            manifest = self._manifest(now)
            if expected is not None and now != expected:
                break
            if stream and manifest["batches"].get(stream[0], -1) >= stream[1]:
                remove(self.spark, f"{self.path}/parts/{part}")
                return None
            if manifest["schema"] not in (None, schema):
                remove(self.spark, f"{self.path}/parts/{part}")
                raise ValueError("the rows' columns differ from the table's")
            batches = manifest["batches"] | ({stream[0]: stream[1]} if stream else {})
            if self._create(now + 1, {"base": manifest["base"], "deltas": [*manifest["deltas"], [part, now + 1]], "batches": batches, "schema": schema}):
                return now + 1
            if expected is not None:
                break
        remove(self.spark, f"{self.path}/parts/{part}")
        raise Conflict(f"version {expected} of {self.path} is no longer the newest")

    def merge(self, rows: DataFrame, gone: DataFrame | None = None, expected: int | None = None, stream: tuple[str, int] | None = None) -> int | None:
        """Add or replace rows by key, and take away the keys of ``gone``; the new version.

        ``expected``: commit only on top of this version. ``stream``: (name, batch id), committed once.
        """
        if stream and self._manifest(self.version())["batches"].get(stream[0], -1) >= stream[1]:
            return None
        new = self._latest(rows.withColumn("_tie", F.xxhash64(*rows.columns)), "_tie").drop("_tie").withColumn("_gone", F.lit(False))
        if gone is not None:
            new = new.unionByName(gone.select(*self.keys).distinct().withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        schema = StructType([f for f in new.schema.fields])
        for f in schema.fields:
            f.nullable = True
        part = self._write(new)
        done = self._commit(part, schema.jsonValue(), expected, stream)
        if done is not None and len(self._manifest(done)["deltas"]) >= self.fold:
            self.compact()
        return done

    def compact(self) -> int:
        """Fold the deltas into a new base; rows that were taken away leave it. Contents stay the same."""
        while True:
            now = self.version()
            manifest = self._manifest(now)
            rows = self._parts(manifest)
            if rows is None or not manifest["deltas"]:
                return now
            part = self._write(self._latest(rows, "_version").where(~F.col("_gone")).drop("_version"))
            if self._create(now + 1, manifest | {"base": [part, now + 1], "deltas": []}):
                return now + 1
            remove(self.spark, f"{self.path}/parts/{part}")

    def forget(self, keep: int = 2) -> None:
        """Delete the manifests before the newest ``keep``, and parts that no kept manifest names (none being written meanwhile)."""
        found = [n for n in names(self.spark, f"{self.path}/versions") if n.endswith(".json")]
        kept = [read_json(self.spark, f"{self.path}/versions/{n}") for n in found[-keep:]]
        used = {p[0] for m in kept for p in [*([m["base"]] if m["base"] else []), *m["deltas"]]}
        for n in found[:-keep]:
            remove(self.spark, f"{self.path}/versions/{n}")
        for n in names(self.spark, f"{self.path}/parts"):
            if n not in used:
                remove(self.spark, f"{self.path}/parts/{n}")

    def sink(self, name: str):
        """``foreachBatch`` writer that commits every batch exactly once."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.merge(batch, stream=(name, batch_id))

        return write
