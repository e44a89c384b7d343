"""Stored tables that grow by batches: rows found by key, and versioned snapshots.

`KeyedTable` is append-only. A batch is a set of its own, written once: rows dealt to slots by a hash of the key, and an
index with a Bloom filter of each slot's keys. A set counts once it is marked as done, so a batch that
breaks off leaves nothing, and one that is replayed finds itself stored. A look-up tests the keys against the filters,
in tasks, and reads the slots that may hold them; how much that is hangs on the keys asked for and not on the table.
`compact` joins sets into one, and takes the old ones out of sight with one file.

`Snapshot` holds the newest rows of each key. A write makes new files for the hash buckets it touches and then a version
file, which names every bucket's files; the newest version that can be read counts. A crash before that leaves the old one.
Two writers can't make the same version: the second one fails and may try again.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Keys that are sent to the tasks that test filters (8 bytes each); a batch with more reads every slot.
KEYS = 4_000_000
PROBES = 16


class Folder:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.has(name) else []

    def create(self, name: str, text: str) -> None:
        """Fails if the file is there."""
        out = self.fs.create(self._path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def same_key(a: str, b: str, key: list[str]) -> Column:
    """Equal keys of two aliased tables, null to null."""
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def having(rows: DataFrame, keys: DataFrame, key: list[str], how: str = "left_semi") -> DataFrame:
    return rows.alias("_rows").join(keys.alias("_keys"), same_key("_rows", "_keys", key), how)


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    a = hashes.astype(np.int64).view(np.uint64)
    b = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return [((a + np.uint64(k) * b) >> np.uint64(64 - bits)).astype(np.int64) for k in range(PROBES)]


def bloom(hashes: np.ndarray) -> bytes:
    """A filter with 32 to 64 bits a key: it takes one in a million other keys for its own, so that 100,000 keys leave slots out."""
    bits = max(6, math.ceil(math.log2(32 * max(1, len(hashes)))))
    out = np.zeros(1 << bits, bool)
    for place in _places(hashes, bits):
        out[place] = True
    return np.packbits(out).tobytes()


def may_have(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    packed = np.frombuffer(filter_, np.uint8)
    bits = (len(packed) * 8).bit_length() - 1
    return np.logical_and.reduce([(packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 for p in _places(hashes, bits)]).astype(bool)


class KeyedTable:
    """Append-only rows of a schema, found by key. Stored rows carry the name of their batch."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str], rows_per_slot: int = 1_000_000):
        self.spark, self.path, self.key, self.rows_per_slot = spark, path.rstrip("/"), key, rows_per_slot
        self.schema = spark.createDataFrame([], schema).withColumn("batch", F.lit("")).schema
        self.folder = Folder(spark, path)

    def _hash(self) -> Column:
        return F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.key])

    def has_batch(self, batch: str) -> bool:
        """Whether the batch is stored, by itself or in a set that it was compacted into."""
        return self.folder.has(f"sets/{batch}/done") or batch in self._covered()

    def append(self, rows: DataFrame, batch: str) -> None:
        """Adds a batch's rows, unless it is stored already. A row may have a batch of its own (as compacted ones do)."""
        if self.has_batch(batch):
            return
        if "batch" not in rows.columns:
            rows = rows.withColumn("batch", F.lit(batch))
        slots = max(1, math.ceil(rows.count() / self.rows_per_slot))
        dealt = rows.select(*self.schema.names, self._hash().alias("_hash")).withColumn("slot", F.pmod("_hash", F.lit(slots)).cast("int"))
        dealt.drop("_hash").hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/sets/{batch}/rows")

        def filters(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [batch], "slots": [slots], "slot": [part["slot"].iloc[0]], "bloom": [bloom(part["_hash"].to_numpy())]})

        index = dealt.select("slot", "_hash").distinct().groupBy("slot").applyInPandas(filters, "part string, slots int, slot int, bloom binary")
        index.write.mode("overwrite").parquet(f"{self.path}/sets/{batch}/index")
        self.folder.create(f"sets/{batch}/done", "")

    def _covered(self) -> set[str]:
        return {name for other in self.folder.names("covers") for name in self.folder.text(f"covers/{other}").split("\n")}

    def sets(self) -> list[str]:
        covered, merged = self._covered(), set(self.folder.names("covers"))
        complete = [s for s in self.folder.names("sets") if self.folder.has(f"sets/{s}/done")]
        return [s for s in complete if s not in covered and (not s.startswith("merged-") or s in merged)]

    def slots(self, keys: DataFrame | None = None) -> list[str]:
        """The folders that may hold rows of the keys; all that there are without keys."""
        sets = self.sets()
        if not sets:
            return []
        index = self.spark.read.parquet(*[f"{self.path}/sets/{s}/index" for s in sets])
        wanted = None
        if keys is not None:
            few = keys.select(self._hash().alias("h")).distinct().limit(KEYS + 1).toArrow()["h"].to_numpy()
            wanted = None if len(few) > KEYS else self.spark.sparkContext.broadcast(few)

        def test(batches):
            for part in batches:
                hit = []
                for slots, slot, filter_ in zip(*[part.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                    own = wanted.value[wanted.value % slots == slot]
                    hit.append(bool(len(own)) and bool(may_have(filter_, own).any()))
                yield part.select(["part", "slot"]).filter(pa.array(hit, pa.bool_()))

        found = index.select("part", "slot") if wanted is None else index.select("part", "slots", "slot", "bloom").mapInArrow(test, "part string, slot int")
        return [f"{self.path}/sets/{r.part}/rows/slot={r.slot}" for r in sorted(found.collect())]

    def read(self, slots: list[str] | None = None) -> DataFrame:
        paths = self.slots() if slots is None else slots
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lookup(self, keys: DataFrame, but: str | None = None) -> DataFrame:
        """The keys' rows, without those of a batch."""
        rows = self.read(self.slots(keys))
        return having(rows if but is None else rows.where(F.col("batch") != but), keys.select(*self.key).distinct(), self.key)

    def compact(self) -> None:
        """Joins all sets into one. The old ones are still on disk for whoever reads them; `vacuum` deletes them."""
        old = self.sets()
        if len(old) < 2:
            return
        name = f"merged-{uuid.uuid4().hex}"
        self.append(self.read(), name)
        before = {x for s in old if self.folder.has(f"covers/{s}") for x in self.folder.text(f"covers/{s}").split("\n")}
        self.folder.create(f"covers/{name}", "\n".join(sorted({*old, *before})))

    def vacuum(self) -> None:
        live = set(self.sets())
        for name in self.folder.names("sets"):
            if name not in live and (name in self._covered() or name.startswith("merged-")):
                self.folder.delete(f"sets/{name}")


class Snapshot:
    """The newest rows of each key, in hash buckets, by version. A key may have several rows; they are replaced together."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.folder = Folder(spark, path)

    def newest(self) -> tuple[int, dict]:
        """The number and content of the newest version that can be read, and the last number that is taken."""
        names = self.folder.names("versions")
        for name in reversed(names):
            try:
                found = json.loads(self.folder.text(f"versions/{name}"))
            except ValueError:  # its writer broke off
                continue
            return int(names[-1]), found
        return int(names[-1]) if names else 0, {"buckets": self.buckets, "parts": {}}

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.key]), F.lit(buckets)).cast("int")

    def _rows(self, version: dict, buckets: list[int] | None = None) -> DataFrame:
        parts = version["parts"]
        paths = [f"{self.path}/{p}" for b, p in sorted(parts.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.newest()[1])

    def _touched(self, keys: DataFrame, version: dict) -> list[int]:
        return sorted(r.b for r in keys.select(self._bucket(version["buckets"]).alias("b")).distinct().collect())

    def replace(self, keys: DataFrame, rows: DataFrame) -> None:
        """The keys have these rows from now on; those of other keys stay. Keys without rows are deleted."""
        taken, version = self.newest()
        touched = self._touched(keys, version)
        old = having(self._rows(version, touched), keys.select(*self.key).distinct(), self.key, "left_anti")
        self._publish(old.unionByName(rows.select(*self.schema.names)), touched, taken, version)

    def has_batch(self, batch: str) -> bool:
        """Whether the newest version, or one before it, was made of this batch."""
        return batch in self.newest()[1].get("batches", [])

    def upsert(self, rows: DataFrame, merge=None, batch: str | None = None) -> None:
        """Rows by key; merge(stored rows of these keys, new rows) gives what is stored of them, and without it new rows do.

        batch: a name that is kept with the version, for the last 1,000 of them; a stream repeats its last one alone."""
        if merge is None:
            return self.replace(rows, rows)
        taken, version = self.newest()
        touched = self._touched(rows, version)
        stored, keys = self._rows(version, touched), rows.select(*self.key).distinct()
        merged = merge(having(stored, keys, self.key), rows).select(*self.schema.names)
        self._publish(having(stored, keys, self.key, "left_anti").unionByName(merged), touched, taken, version, batch)

    def _publish(self, rows: DataFrame, touched: list[int], taken: int, version: dict, batch: str | None = None) -> None:
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(version["buckets"])).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        parts = {b: p for b, p in version["parts"].items() if int(b) not in touched}
        parts |= {str(b): f"{name}/_bucket={b}" for b in touched if self.folder.has(f"{name}/_bucket={b}")}
        self.folder.create(f"versions/{taken + 1:012d}", json.dumps({"buckets": version["buckets"], "parts": parts, "batches": (version.get("batches", []) + [batch] * bool(batch))[-1000:]}))

    def vacuum(self) -> None:
        """Deletes the files that the newest version doesn't name; not for while another write is going on."""
        live = {p.split("/")[1] for p in self.newest()[1]["parts"].values()}
        for name in self.folder.names("data"):
            if name not in live:
                self.folder.delete(f"data/{name}")
