"""A stored table of verdicts by key, first in, first out.

The store is a chain of segments, one for each batch that put something new, in the order of
insertion.  A version is a small manifest that lists them; the next version appears by the
rename of its manifest, so readers see one version or the other, and a batch that comes again
finds its number in the manifest and changes nothing.  Every segment has a Bloom filter of its
keys: a batch reads the segments that may hold one of its keys, and no others.  Filters of equal
size are merged by OR, so a segment's filter is put together from those of its tasks.

A key keeps its place when its verdict is replaced: the segments that hold it are written anew.
Beyond the capacity the oldest segments leave the chain, and the oldest that remains is cut to
what still fits.  Folders that no version names any more stay for whoever clears the shared
folder.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolwarden import rules as R

#: Bits of a filter per row of its segment, and positions a key sets: one false answer in 70,000, as a
#: segment is read if the filter is wrong about any key of a batch.
BITS_PER_ROW, HASHES = 24, 12
#: Filters have at least so many bits, and tasks' filters are merged in so many groups first.
LEAST_BITS, GROUPS = 1 << 10, 32


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits that each 64-bit hash of a key sets."""
    h = hashes.view(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    turns = np.arange(HASHES, dtype=np.uint64)
    return ((first[:, None] + turns * step[:, None]) % np.uint64(bits)).astype(np.int64)


def bloom_of(keys: DataFrame, bits: int) -> bytes:
    """The filter of the keys, merged from those of all tasks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits, bool)
        for batch in batches:
            field[positions(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()] = True
        if field.any():
            yield pa.RecordBatch.from_pydict({"pile": pa.array([int(field.argmax()) % GROUPS], pa.int32()), "bloom": pa.array([np.packbits(field).tobytes()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        whole = np.zeros(math.ceil(bits / 8), np.uint8)
        for raw in table.column("bloom"):
            whole |= np.frombuffer(raw.as_buffer(), np.uint8)
        return pa.table({"pile": pa.array([0], pa.int32()), "bloom": pa.array([whole.tobytes()], pa.binary())})

    schema = "pile int, bloom binary"
    parts = keys.select(F.xxhash64("cache_key").alias("h")).mapInArrow(build, schema)
    row = parts.groupBy("pile").applyInArrow(merge, schema).groupBy("pile").applyInArrow(merge, schema).first()
    return bytes(row["bloom"]) if row else bytes(math.ceil(bits / 8))


class VerdictStore:
    """Verdicts by ``cache_key`` below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = R.VERDICT_CAPACITY) -> None:
        self.spark, self.path, self.capacity = spark, path.rstrip("/"), capacity
        #: Segments that the last lookup or put read, for those who count.
        self.segments_read: list[str] = []

    # --- versions ---

    def _system(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def manifest(self) -> dict:
        """The current version: its number, the segments from old to new, the last batch of each writer."""
        system, to = self._system()
        folder = to(f"{self.path}/_versions")
        names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]
        if not numbers:
            return {"version": 0, "segments": [], "batches": {}}
        row = self.spark.read.text(f"{self.path}/_versions/{max(numbers):012d}.json", wholetext=True).first()
        return json.loads(row["value"])

    def _commit(self, manifest: dict) -> None:
        system, to = self._system()
        manifest = manifest | {"version": manifest["version"] + 1}
        waiting = to(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = system.create(waiting, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        final = to(f"{self.path}/_versions/{manifest['version']:012d}.json")
        if system.exists(final) or not system.rename(waiting, final):
            raise RuntimeError(f"another writer made version {manifest['version']} of {self.path}")

    # --- segments ---

    def _write(self, rows: DataFrame, bits: int | None = None) -> dict | None:
        """A new segment of rows; None if there are none."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/segments/{name}")
        written = self.spark.read.parquet(f"{self.path}/segments/{name}")
        n = written.count()
        if n == 0:
            return None
        bits = max(LEAST_BITS, BITS_PER_ROW * n)
        bloom = bloom_of(written, bits)
        self.spark.createDataFrame([(bytearray(bloom),)], "bloom binary").write.parquet(f"{self.path}/blooms/{name}")
        return {"name": name, "rows": n, "bits": bits}

    def _rows(self, segments: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/segments/{s['name']}" for s in segments])

    def rows(self) -> DataFrame | None:
        """All verdicts of the current version."""
        segments = self.manifest()["segments"]
        return self._rows(segments) if segments else None

    def _may_hold(self, keys: DataFrame, segments: list[dict]) -> list[dict]:
        """The segments whose filters know one of the keys."""
        if not segments:
            return []
        paths = [f"{self.path}/blooms/{s['name']}" for s in segments]
        named = self.spark.read.parquet(*paths).select(F.input_file_name().alias("file"), "bloom").collect()
        by_name = {s["name"]: s["bits"] for s in segments}
        filters = []
        for row in named:
            name = next(n for n in by_name if n in row["file"])
            filters.append((name, by_name[name], np.unpackbits(np.frombuffer(bytes(row["bloom"]), np.uint8)).astype(bool)))
        shared = self.spark.sparkContext.broadcast(filters)

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: set[str] = set()
            for batch in batches:
                hashes = batch.column(0).to_numpy(zero_copy_only=False)
                for name, bits, field in shared.value:
                    if name not in found and len(hashes) and field[positions(hashes, bits)].all(1).any():
                        found.add(name)
            yield pa.RecordBatch.from_pydict({"name": pa.array(sorted(found), pa.string())})

        hit = {r["name"] for r in keys.select(F.xxhash64("cache_key").alias("h")).mapInArrow(test, "name string").distinct().collect()}
        return [s for s in segments if s["name"] in hit]

    # --- use ---

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The stored verdicts of some keys (``cache_key``); None if no segment may hold one."""
        read = self._may_hold(keys, self.manifest()["segments"])
        self.segments_read = [s["name"] for s in read]
        if not read:
            return None
        return self._rows(read).join(keys.select("cache_key").distinct(), "cache_key", "left_semi")

    def put(self, verdicts: DataFrame, batch_id: int | None = None, writer: str = "store") -> None:
        """Insert verdicts (``cache_key, first_seen, …``, one row per key) at the end of the chain, replace those
        whose key is there, and let the oldest beyond the capacity go."""
        before = self.manifest()
        if batch_id is not None and before["batches"].get(writer, -1) >= batch_id:
            return
        touched = self._may_hold(verdicts, before["segments"])
        self.segments_read = [s["name"] for s in touched]
        kept: list[dict] = []
        new = verdicts
        for segment in before["segments"]:
            if segment not in touched:
                kept.append(segment)
                continue
            rows = self._rows([segment])
            again = verdicts.join(rows.select("cache_key", F.col("first_seen").alias("_since")), "cache_key")
            if again.isEmpty():  # the filter was wrong
                kept.append(segment)
                continue
            stays = rows.join(verdicts.select("cache_key"), "cache_key", "left_anti")
            replaced = again.withColumn("first_seen", F.col("_since")).select(*rows.columns)
            kept.append(self._write(stays.unionByName(replaced)))
            new = new.join(rows.select("cache_key"), "cache_key", "left_anti")
        added = self._write(new)
        chain = kept + ([added] if added else [])
        over = sum(s["rows"] for s in chain) - self.capacity
        while over > 0 and chain[0]["rows"] <= over:
            over -= chain.pop(0)["rows"]
        if over > 0:
            oldest = self._rows([chain[0]])
            room = chain[0]["rows"] - over
            newest = oldest.orderBy(F.desc("first_seen"), F.desc("cache_key")).limit(room)
            chain[0] = self._write(newest)
        batches = before["batches"] | ({writer: batch_id} if batch_id is not None else {})
        self._commit({"version": before["version"], "segments": chain, "batches": batches})


def unknown_texts(store: VerdictStore, keyed: DataFrame) -> DataFrame:
    """The rows whose ``cache_key`` has no stored verdict; only segments that may hold one are read."""
    known = store.lookup(keyed)
    return keyed if known is None else keyed.join(known.select("cache_key"), "cache_key", "left_anti")
