"""Tables that change by key without being rewritten: segments, tombstones, one manifest, tiered compaction.

A commit writes what changed as a segment of each table - the new rows of the touched keys, and the touched keys themselves,
which put an end to all older rows of theirs - and then swaps the manifest: one small file that names the segments of all
tables, so a reader sees a commit whole or not at all. The manifest also remembers the last batch of every stream, which
makes a replay harmless: a batch that is in it is not applied again, one that is not overwrites what it had begun.

Rows lie in slots by the hash of their key; the number of slots follows the size of the table, a slot that grows large is
split over several files, and reading some keys reads their slots alone. Compaction merges the latest segments once there
are FAN of similar size, so a row is rewritten a logarithmic number of times and a table has a logarithmic number of
segments. The folder has one writer at a time; its file system must rename a file as one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows of a slot, and segments of similar size that are merged into one.
ROWS_PER_SLOT = 1_000_000
FAN = 4

Change = tuple[DataFrame, DataFrame | None]


def _with_slot(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("slot", IntegerType())])


class Segments:
    """Tables of one folder, given with the columns of their keys. Key columns hold no nulls: rows without a key are left out."""

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, list[str]]):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = {name: list(columns) for name, columns in keys.items()}

    # --- manifest --------------------------------------------------------------------------------

    def _file(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder, fs = self._file("manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "applied": {}, "tables": {}}
        path, fs = self._file("manifest", f"v{version or versions[-1]:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        manifest["version"] += 1
        begun, fs = self._file("manifest", f"begun-{uuid.uuid4().hex}")
        out = fs.create(begun, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final, _ = self._file("manifest", f"v{manifest['version']:012d}.json")
        if fs.exists(final) or not fs.rename(begun, final):
            raise RuntimeError(f"another writer made version {manifest['version']} of {self.path}")

    def applied(self, stream: str) -> int:
        """The last batch of a stream that is in the tables; -1 before the first."""
        return self._manifest()["applied"].get(stream, -1)

    def sizes(self, table: str) -> list[tuple[int, int]]:
        """(rows, touched keys) of the segments of a table, oldest first."""
        return [(s["rows"], s["keys"]) for s in self._manifest()["tables"].get(table, {"segments": []})["segments"]]

    # --- writing ---------------------------------------------------------------------------------

    def _slot(self, table: str, slots: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys[table]), F.lit(slots)).cast("int")

    def _write(self, table: str, rows: DataFrame, touched: DataFrame | None, name: str, seq: int, slots: int) -> dict:
        """Writes a segment; ``touched`` is None for the oldest one, which ends no rows of others."""
        counts = {"rows": 0, "keys": 0}
        for kind, df in (("rows", rows), ("keys", touched)):
            if df is None:
                continue
            where = f"{self.path}/{table}/{name}/{kind}"
            dealt = df.withColumn("slot", self._slot(table, slots)).hint("rebalance", "slot")
            dealt.sortWithinPartitions("slot", *self.keys[table]).write.mode("overwrite").partitionBy("slot").parquet(where)
            counts[kind] = self.spark.read.schema(_with_slot(df.schema)).parquet(where).count()
        return {"name": name, "seq": seq, "slots": slots, **counts}

    def _slots(self, entry: dict) -> int:
        total = sum(s["rows"] for s in entry["segments"])
        return max(1, -(-total // ROWS_PER_SLOT)) if entry["segments"] else self.spark.sparkContext.defaultParallelism

    def commit(self, stream: str, batch_id: int, changes: Mapping[str, Change]) -> bool:
        """Replaces all rows of the touched keys of each table by the given rows; False if the batch was applied before.

        A change is (rows, touched keys); touched keys without rows are deleted, None stands for the keys of the rows.
        """
        manifest = self._manifest()
        if batch_id <= manifest["applied"].get(stream, -1):
            return False
        for table, (rows, touched) in changes.items():
            keys = self.keys[table]
            rows = rows.dropna(subset=keys)
            touched = (rows if touched is None else touched).select(*keys).dropna().distinct()
            entry = manifest["tables"].setdefault(table, {"schema": json.loads(rows.schema.json()), "segments": []})
            rows = rows.select(*StructType.fromJson(entry["schema"]).fieldNames())
            seq = manifest["version"] + 1
            written = self._write(table, rows, touched, f"{stream}-{batch_id}-{seq}", seq, self._slots(entry))
            if written["rows"] or written["keys"]:
                entry["segments"].append(written)
        manifest["applied"][stream] = batch_id
        self._swap(manifest)
        return True

    # --- reading ---------------------------------------------------------------------------------

    def read(self, table: str, only: DataFrame | None = None) -> DataFrame:
        """The current rows of a table, or those of the keys in ``only``: then only the slots of these keys are read."""
        manifest = self._manifest()
        if table not in manifest["tables"]:
            raise KeyError(f"nothing was ever committed to {table}")
        return self._current(table, manifest["tables"][table], only)

    def has(self, table: str) -> bool:
        return table in self._manifest()["tables"]

    def _current(self, table: str, entry: dict, only: DataFrame | None = None) -> DataFrame:
        keys, schema = self.keys[table], StructType.fromJson(entry["schema"])
        segments = entry["segments"]
        if not segments:
            return self.spark.createDataFrame([], schema)
        needed = {}
        if only is not None:
            only = only.select(*keys).dropna().distinct()
            for slots in {s["slots"] for s in segments}:
                found = only.select(self._slot(table, slots).alias("slot")).distinct().collect()  # at most the slots
                needed[slots] = [r["slot"] for r in found]

        def load(segment: dict, kind: str) -> DataFrame:
            columns = schema if kind == "rows" else StructType([schema[k] for k in keys])
            df = self.spark.read.schema(_with_slot(columns)).parquet(f"{self.path}/{table}/{segment['name']}/{kind}")
            return (df if only is None else df.filter(F.col("slot").isin(needed[segment["slots"]]))).drop("slot")

        oldest, *later = segments
        rows = load(oldest, "rows")
        if later:
            union = lambda kind: reduce(DataFrame.unionByName, [load(s, kind).withColumn("_seq", F.lit(s["seq"])) for s in later])
            newest = union("keys").groupBy(*keys).agg(F.max("_seq").alias("_seq"))
            rows = rows.join(newest, keys, "left_anti").unionByName(union("rows").join(newest, [*keys, "_seq"], "left_semi").drop("_seq"))
        return rows if only is None else rows.join(only, keys, "left_semi")

    # --- compaction ------------------------------------------------------------------------------

    def compact(self, *tables: str) -> None:
        """Merges the latest segments of the tables (all if none is named) where FAN or more are of similar size."""
        manifest = self._manifest()
        changed = False
        for table in tables or manifest["tables"]:
            entry = manifest["tables"].get(table)
            segments = entry["segments"] if entry else []
            size = lambda s: s["rows"] + s["keys"] + 1
            first, total = len(segments) - 1, size(segments[-1]) if segments else 0
            while first > 0 and size(segments[first - 1]) <= FAN * total:
                first -= 1
                total += size(segments[first])
            if len(segments) - first < FAN:
                continue
            part = {**entry, "segments": segments[first:]}
            keys = self.keys[table]
            touched = None
            if first:
                columns = _with_slot(StructType([StructType.fromJson(entry["schema"])[k] for k in keys]))
                parts = [self.spark.read.schema(columns).parquet(f"{self.path}/{table}/{s['name']}/keys") for s in segments[first:]]
                touched = reduce(DataFrame.unionByName, parts).select(*keys).distinct()
            seq = segments[-1]["seq"]
            name = f"merged-{manifest['version'] + 1}-{seq}"
            merged = self._write(table, self._current(table, part), touched, name, seq, self._slots(entry))
            entry["segments"] = [*segments[:first], merged]
            changed = True
        if changed:
            self._swap(manifest)
            self.vacuum()

    def vacuum(self) -> None:
        """Deletes what neither the current nor the last manifest names; readers of the last one may go on."""
        versions = self._versions()
        kept = [self._manifest(v) for v in versions[-2:]]
        for table in {t for m in kept for t in m["tables"]}:
            named = {s["name"] for m in kept for s in m["tables"].get(table, {"segments": []})["segments"]}
            folder, fs = self._file(table)
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                if status.getPath().getName() not in named:
                    fs.delete(status.getPath(), True)
        for version in versions[:-2]:
            path, fs = self._file("manifest", f"v{version:012d}.json")
            fs.delete(path, False)
