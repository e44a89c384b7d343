"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop, ship, stage  # noqa: F401  (drop and stage for the operators)

#: White space of the word rule `[^\x20\x09-\x0D]+`; the same six bytes on which bytes.split() splits.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _has_map(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType) or isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def _plain(value: Column, kind: T.DataType) -> Column:
    """The value without maps, which Spark neither hashes nor compares: their entries in order of key."""
    if not _has_map(kind):
        return value
    if isinstance(kind, T.MapType):
        return F.when(value.isNotNull(), F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _plain(e["value"], kind.valueType).alias("value")))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain(x, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*[_plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))


def row_key(df: DataFrame) -> Column:
    """128 bits of all of a row's values, maps as their entries, which tell null from any value, in hex."""
    values = [_plain(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), *values, *[v.isNull() for v in values])), 16, "0") for k in (1, 2)])


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key; rows may have maps."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_row")).select(key, "_row.*").select(*[f"`{c}`" for c in rows.columns])


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def slices(batches, max_bytes: int = 4 << 20, max_rows: int = 4096):
    """Arrow batches cut and joined to batches of bounded size, so that memory doesn't follow the text length."""
    held, size, rows = [], 0, 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = min(256, batch.num_rows - at)
            part = batch.slice(at, step)
            at += step
            held.append(part)
            rows += step
            size += sum(c.nbytes for c in part.columns)
            if size >= max_bytes or rows >= max_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: For each byte: 0 for white space, else the byte with A-Z lower-cased, plus 1.
_LOWER = np.array([0 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else (b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], np.uint64)
#: The same, where ASCII other than letters and digits counts as white space.
_ALNUM = np.where([b < 128 and not chr(b).isalnum() for b in range(256)], 0, _LOWER).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: 64-bit words of a Bloom filter: a fixed size, beyond which more rows pass that a join then drops.
BLOOM_WORDS = 1 << 19


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(texts: pa.Array, alnum: bool = False, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all lower-cased words of a column, and where each text's words begin in them (one entry more).

    A word's hash is the sum of byte * base^place over its bytes, for all words of the batch at once. prefix: gives
    the hashes of the words' first bytes, so many, as a third array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    value = (_ALNUM if alnum else _LOWER)[raw]
    inside = value > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][(offsets[:-1] < len(raw))]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return (np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), *[np.empty(0, np.uint64)] * bool(prefix))
    spans = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    ends = np.flatnonzero(inside & np.append(begins[1:] | ~inside[1:], True))  # a text's last word may touch the next text's first
    longest = int((ends - starts[np.searchsorted(starts, ends, "right") - 1]).max()) + 1
    power = np.full(longest, _BASE)
    power[0] = 1
    power = np.cumprod(power)
    value = value[starts[0] :] * power[np.minimum(place, longest - 1)]
    h = mixed(np.add.reduceat(value, starts - starts[0]))
    begins = np.searchsorted(starts, offsets)
    if prefix:
        value[place >= prefix] = 0
        return h, begins, mixed(np.add.reduceat(value, starts - starts[0]) + np.uint64(1))
    return h, begins


def _bloom_places(ids: np.ndarray) -> list[np.ndarray]:
    h = mixed(ids.view(np.uint64))
    return [(h >> np.uint64(k * 20)) & np.uint64(BLOOM_WORDS * 64 - 1) for k in range(3)]


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids a filter lets through."""
    return np.logical_and.reduce([(bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) for p in _bloom_places(ids)]).astype(bool)


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids: a bit set of fixed size, put together by Spark."""

    def run(batches):
        bits = np.zeros(BLOOM_WORDS, np.uint64)
        for batch in batches:
            for place in _bloom_places(batch.column(0).to_numpy()):
                np.bitwise_or.at(bits, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at].view(np.int64))], names=["at", "bits"])

    found = ids.mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BLOOM_WORDS, np.uint64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


class KeyIndex:
    """Vectorised look-up of 64-bit keys in a fixed set: an open-addressing table."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (len(keys) * 4).bit_length())
        self.key, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.at[slot[left]] < 0
            _, first = np.unique(slot[left], return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= free
            put = left[won]
            self.at[slot[put]], self.key[slot[put]] = put, keys[put]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers in the set, -1 for others."""
        slot = self._slot(keys)
        out = self.at[slot]
        odd = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & ((1 << self.bits) - 1)
            out[odd] = self.at[slot[odd]]
            odd = odd[(out[odd] >= 0) & (self.key[slot[odd]] != keys[odd])]
        return out
