"""Document fingerprints by randomised edit embedding (Chakraborty, Goldenberg and Koucky 2016).

A text is read by a walk: step j writes the current character and moves on by a bit that hangs on j and the
character, the same bits for all texts. After a difference two walks soon fall into step again, so texts of small
edit distance have embeddings of small Hamming distance. A fingerprint samples the embedding at fixed places, spread
evenly over twice the text's length rounded up to a power of two (its level), and again for the next level; likeness
is the share of equal samples at a level that both have. Bands of samples bring texts together that agree in one, and
edit distances verify them: `near_id` names the group that a text belongs to.

The walks of a batch run side by side in numpy. Texts are put in id order by ranges cut at quantiles of the ids; the
first text of each range is also sent to the range before, so a text meets the next one without any task seeing more
than its range, which it streams through.

Defined results: a null text is empty; an empty text's fingerprint has no samples and equals only one like it; texts whose levels are more
than one apart have likeness 0; rows that share an id (null ids come first) are ordered by a hash of their text; a single row is its own
next; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bloom, drop, mixed, passes, slices, stage
from .graph import connected

SAMPLES = 128
WORDS = 18
NAMES = (1 << 47) - 1
LEAST_LEVEL = 6
#: Bytes of text in a range of ids, and the most ranges there are: beyond them ranges grow, but a task streams through its own.
RANGE_BYTES, RANGES = 8 << 20, 1 << 16
_PERIOD = 1 << 13


def _moves() -> np.ndarray:
    """moves[j % period, character class]: 1 to step on. Class 0, the end, never does."""
    at = np.arange(_PERIOD * 256, dtype=np.uint64)
    m = (mixed(at + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(63)).astype(np.int64).reshape(_PERIOD, 256)
    m[:, 0] = 0
    return m


_MOVES: list[np.ndarray] = []


def places(level: int) -> np.ndarray:
    """The sampled places of a level: one in each of SAMPLES equal parts of [0, 2 ** (level + 1))."""
    u = (mixed(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(level << 32)) >> np.uint64(11)).astype(float) / 2.0**53
    return ((np.arange(SAMPLES) + u) * (2.0 ** (level + 1) / SAMPLES)).astype(np.int64)


def level_of(n: int) -> int:
    return max(LEAST_LEVEL, (max(1, n) - 1).bit_length())


def classes(text: str) -> np.ndarray:
    """Character classes 1..255 of a text's code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (mixed(points) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def embed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All embeddings in one array of classes (0: past the end), and where each begins; each is 3 (n + 1) long."""
    if not _MOVES:
        _MOVES.append(_moves())
    moves = _MOVES[0]
    size = np.array([len(t) for t in texts], np.int64)
    flat = classes("\0".join(texts) + "\0")
    ends = np.cumsum(size + 1)
    flat[ends - 1] = 0
    begin = ends - size - 1
    room = 3 * (size + 1)
    base = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    order = np.argsort(-size, kind="stable")
    at, to, left, stop = begin[order], base[order].copy(), room[order], (ends - 1)[order]
    j = 0
    while len(at):
        for _ in range(min(64, int(left.min()) - j)):
            c = flat[at]
            out[to] = c
            at = at + moves[j % _PERIOD][c]
            to += 1
            j += 1
        go = (at < stop) & (left > j)
        if not go.all():
            at, to, left, stop = at[go], to[go], left[go], stop[go]
    return out, base


def sample(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """levels, and samples[text, own level or next, place] of the texts' embeddings."""
    out, base = embed(texts)
    levels = np.array([level_of(len(t)) for t in texts])
    room = 3 * (np.array([len(t) for t in texts], np.int64) + 1)
    found = np.zeros((len(texts), 2, SAMPLES), np.uint8)
    for level in np.unique(levels):
        which = np.flatnonzero(levels == level)
        for up in (0, 1):
            p = places(int(level) + up)[None, :]
            inside = p < room[which][:, None]
            found[which, up] = np.where(inside, out[np.minimum(base[which][:, None] + p, len(out) - 1)], 0)
    return levels, found


def to_text(level: int, samples: np.ndarray) -> str:
    return f"{level:02d}." + base64.b64encode(samples.tobytes()).decode()


def from_text(fingerprint: str) -> tuple[int, np.ndarray]:
    return int(fingerprint[:2]), np.frombuffer(base64.b64decode(fingerprint[3:]), np.uint8).reshape(2, SAMPLES)


def likeness(la: np.ndarray, a: np.ndarray, lb: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, of those past neither text's end in both; 1 where there are none."""
    x = np.where((la >= lb)[:, None], a[:, 0], a[:, 1])
    y = np.where((lb >= la)[:, None], b[:, 0], b[:, 1])
    valid = (x > 0) | (y > 0)
    n = valid.sum(1)
    share = np.where(n > 0, ((x == y) & valid).sum(1) / np.maximum(n, 1), 1.0)
    return np.where(np.abs(la - lb) <= 1, share, 0.0)


def fingerprint_column(df: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of a text column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        levels, found = sample([t or "" for t in texts])
        return pd.Series([to_text(k, x) for k, x in zip(levels, found, strict=True)])

    return df.withColumn(fingerprint, run(F.col(text)))


def packed(text: str, codec: pa.Codec) -> bytes:
    """A text's size in bytes, then the text compressed: a shuffle compresses by blocks, and much less."""
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)


def unpacked(data: bytes, codec: pa.Codec) -> str:
    return codec.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True).decode()


def in_id_order(docs: DataFrame, pack: bool = False) -> DataFrame:
    """part, extra, doc_id, text: ranges of ids, each sorted within a task; extra rows are what follows the range. pack: texts come packed.

    There are as many ranges as the data needs for RANGE_BYTES each, RANGES at most, and the driver puts their first rows in order
    (ids and hashes). An id that fills several ranges, or the rows without one, are cut further by a hash of the text."""
    spark = docs.sparkSession
    at, mix = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))), F.xxhash64("text")
    rows = docs.withColumn("at", at).withColumn("mix", mix)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(RANGES, max(spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))))
    cuts = rows.approxQuantile("at", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    starts, table, next_part = sorted({float("-inf"), *cuts}), [], 0
    for k, v in enumerate(starts):
        weight = cuts.count(v) if abs(v) < 2.0**53 or v == float("-inf") else 1  # beyond, ids are no longer told apart
        weight = weight if weight > 1 else 0
        table.append((k, next_part, v, weight))
        next_part += weight + 1
    if len(starts) > 1:
        rows = Bucketizer(splits=[*starts, float("inf")], inputCol="at", outputCol="range").transform(rows).withColumn("range", F.col("range").cast("int"))
    else:
        rows = rows.withColumn("range", F.lit(0))
    ranges = spark.createDataFrame(table, "range int, first int, start double, weight int")
    share = F.floor((F.shiftrightunsigned("mix", 33) * F.col("weight")) / 2.0**31).cast("int")
    part = F.col("first") + F.when((F.col("weight") > 0) & (F.col("at") == F.col("start")), share).otherwise(F.col("weight"))
    rows = rows.join(F.broadcast(ranges), "range").select(part.alias("part"), "doc_id", F.shiftrightunsigned("mix", 33).alias("mix"), "text")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), "mix", F.xxhash64("text", F.lit(1)).alias("own"))
    heads = sorted((r["part"], r["head"]) for r in rows.groupBy("part").agg(F.min(order).alias("head")).collect())
    follow: dict = {}
    for k, (part_, _) in enumerate(heads):
        head = heads[(k + 1) % len(heads)][1]
        follow.setdefault((head["id"], head["mix"], head["own"]), []).append(part_)
    extra = spark.createDataFrame([(*k, v) for k, v in follow.items()], "head_id long, head_mix long, head_own long, parts array<int>")
    sent = rows.join(F.broadcast(extra), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("mix") == F.col("head_mix")) & (F.xxhash64("text", F.lit(1)) == F.col("head_own")), "left")
    copies = F.concat(F.array(F.struct("part", F.lit(0).alias("extra"))), F.coalesce(F.transform("parts", lambda p: F.struct(p.alias("part"), F.lit(1).alias("extra"))), F.array().cast("array<struct<part:int,extra:int>>")))
    every = sent.select(copies.alias("copies"), "doc_id", "mix", F.xxhash64("text", F.lit(1)).alias("own"), "text")
    if pack:

        @F.pandas_udf("binary")
        def pack_texts(texts: pd.Series) -> pd.Series:
            codec = pa.Codec("zstd")
            return pd.Series([packed(t, codec) for t in texts])

        every = every.withColumn("text", pack_texts("text"))
    every = every.select(F.explode("copies").alias("c"), "doc_id", "mix", "own", "text").select("c.part", "c.extra", "doc_id", "mix", "own", "text")
    return every.repartitionById(max(1, next_part), F.col("part")).sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), "mix", "own", "text").drop("mix", "own")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, h1 long, h2 long"


def text_key(text: str) -> tuple[int, int]:
    """128 bits by which texts are told apart."""
    d = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint, that of its edit (second half replaced by the next text's beginning), likenesses, and the text's key (h1, h2)."""

    def opened(batches, most=4 << 20):
        """Rows with their texts unpacked, about so many bytes of them at once."""
        codec = pa.Codec("zstd")
        for part in slices(batches, 2 << 20, 1 << 13):
            new, size = [], 0
            for part_, extra, i, data in zip(*(part[k].to_pylist() for k in range(4)), strict=True):
                new.append((part_, extra, i, unpacked(data, codec)))
                size += int.from_bytes(data[:8], "little")
                if size >= most:
                    yield new
                    new, size = [], 0
            if new:
                yield new

    def run(batches):
        held: list[tuple] = []
        for new in opened(batches):
            rows = held + new
            held = rows[-1:]
            texts = [r[3] for r in rows]
            emit = [k for k in range(len(rows) - 1) if not rows[k][1]]
            if not emit:
                continue
            edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in emit]
            levels, found = sample(texts + edited)
            a, e = np.array(emit), np.arange(len(emit)) + len(texts)
            pick = lambda x, y: likeness(levels[x], found[x], levels[y], found[y])
            keys = [text_key(texts[k]) for k in emit]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[k][2] for k in emit], pa.int64()), pa.array([len(texts[k]) for k in emit], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([to_text(levels[k], found[k]) for k in a]),
                 pa.array([to_text(levels[k], found[k]) for k in e]), pa.array(pick(a, e)), pa.array(pick(a, a + 1)),
                 pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())],
                names=[c.split()[0] for c in RESULT.split(", ")])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return in_id_order(plain, pack=True).mapInArrow(run, RESULT)


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Two texts without their longest common beginning and then without their longest common end, which no edit distance hangs on."""

    def common(same) -> int:
        low, high = 0, min(len(a), len(b))
        while low < high:
            k = (low + high + 1) // 2
            low, high = (k, high) if same(k) else (low, k - 1)
        return low

    k = common(lambda k: a[:k] == b[:k])
    a, b = a[k:], b[k:]
    k = common(lambda k: a[len(a) - k :] == b[len(b) - k :])
    return a[: len(a) - k], b[: len(b) - k]


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance by bit-parallel columns (Myers 1999); with most, of those beyond it some number beyond it."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    peq: dict[str, int] = {}
    for k, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << k
    full, top, pv, mv, score = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for at in range(0, len(b), 32):
        for c in b[at : at + 32]:
            eq = peq.get(c, 0)
            xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = (ph << 1 | 1) & full, mh << 1 & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
        if most is not None and score - max(0, len(b) - at - 32) > most:  # each column that is left takes off one at most
            return score - max(0, len(b) - at - 32)
    return score


def common_grams(a: str, b: str, q: int = 3) -> int:
    """How many substrings of q characters two texts share, repeats counted."""
    return sum((Counter(map("".join, zip(*(a[k:] for k in range(q))))) & Counter(map("".join, zip(*(b[k:] for k in range(q)))))).values())


def distance_within(a: str, b: str, most: int, q: int = 3) -> int | None:
    """The edit distance where it's at most most. An edit changes q substrings of q characters at most, so too few common ones rule a pair out."""
    grams = max(len(a), len(b)) - q + 1 - q * most
    if abs(len(a) - len(b)) > most or grams > 0 and common_grams(a, b, q) < grams:
        return None
    found = edit_distance(a, b, most)
    return found if found <= most else None


def anchored_bound(a: str, b: str, most: int, anchor: int = 12, reach: int = 256) -> int | None:
    """An upper bound of the edit distance, in time linear in what agrees; None where it would pass most.

    What differs ends where an anchor of the one text is found near by in the other, and costs the longer of the two stretches."""
    i = j = cost = 0
    while i < len(a) and j < len(b):
        step = 64
        while a[i : i + step] == b[j : j + step] and i + step < len(a) and j + step < len(b):
            i, j, step = i + step, j + step, min(step * 2, 1 << 20)
        while step > 1:
            step //= 2
            if a[i : i + step] == b[j : j + step] and i + step <= len(a) and j + step <= len(b):
                i, j = i + step, j + step
        if i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for d in range(0, reach):
            if i + d + anchor > len(a):
                d = reach
                break
            at = b.find(a[i + d : i + d + anchor], j, j + d + anchor + 64)
            if at >= 0:
                break
        else:
            d = reach
        if d == reach:
            break
        cost += max(d, at - j)
        i, j = i + d, at
        if cost > most:
            return None
    cost += max(len(a) - i, len(b) - j)
    return cost if cost <= most else None


def is_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most most. What long common beginnings or ends leave is much cheaper to compare."""
    if abs(len(a) - len(b)) > most:
        return False
    a, b = trimmed(a, b)
    if max(len(a), len(b)) <= most:
        return True
    return anchored_bound(a, b, most) is not None or distance_within(a, b, most) is not None


#: Members of a band, chosen by hash, that its texts of other components are tested against before all pairs that are left.
REPRESENTATIVES = 4
#: Members of a band in one slice of the pairs that are left.
CROWD = 2_000


def band_places(bands: int, width: int) -> np.ndarray:
    """Which samples each band consists of."""
    return np.array([np.argsort(mixed(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(k << 20)))[:width] for k in range(bands)])


def entries(marks: DataFrame, share: float, bands: int, width: int) -> DataFrame:
    """For rows (h1, h2, n_chars, fingerprint) one row for each level at which a near text may be met: tag, samples, how many aren't past the end, band keys.

    A tag holds 47 bits of h1 and the level; that is the text's own, and the next too where a longer near text may have it."""
    picks = band_places(bands, width)
    base = np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        power = np.cumprod(np.full(width, base))
        for part in slices(batches, 4 << 20):
            h1, h2, n, prints = (part[k].to_pylist() for k in range(4))
            rows, samples = [], []
            for k, fingerprint in enumerate(prints):
                level, found = from_text(fingerprint)
                for up in range(1 + (n[k] > (1 - share) * 2**level - 1)):
                    if found[up].any():
                        rows.append((k, level + up))
                        samples.append(found[up])
            if not rows:
                continue
            x = np.array(samples)
            level = np.array([r[1] for r in rows], np.uint64)
            keys = mixed((x[:, picks].astype(np.uint64) * power).sum(2) + (level[:, None] << np.uint64(20)) + np.arange(bands, dtype=np.uint64))
            own = [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(h1[k] & NAMES) << 16 | int(lv) for k, lv in zip(own, level, strict=True)], pa.int64()), pa.array([h1[k] for k in own], pa.int64()), pa.array([h2[k] for k in own], pa.int64()),
                 pa.array([n[k] for k in own], pa.int64()), pa.array((x > 0).sum(1), pa.int64()), pa.array(list(planes(x)), pa.list_(pa.int64())), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                names=["tag", "h1", "h2", "n", "valid", "samples", "keys"])

    return marks.select("h1", "h2", "n_chars", "fingerprint").mapInArrow(run, "tag long, h1 long, h2 long, n long, valid long, samples array<long>, keys array<long>")


def planes(x: np.ndarray) -> np.ndarray:
    """Rows of 128 samples as 18 longs each: eight bit planes of two longs, then which samples aren't past the end."""
    bits = np.unpackbits(x[:, :, None], axis=2, bitorder="little").transpose(0, 2, 1)
    out = np.concatenate([bits, (x > 0)[:, None, :].astype(np.uint8)], axis=1)
    return np.packbits(out, axis=2, bitorder="little").reshape(len(x), -1).view(np.int64)


def _unlike(half: int) -> Column:
    """Which of 64 samples differ in two entries."""
    return reduce(Column.bitwiseOR, [F.col(f"f{2 * p + half}_a").bitwiseXOR(F.col(f"f{2 * p + half}_b")) for p in range(8)])


def _first_shared(bands: int, width: int) -> Column:
    """Whether two entries of one level that share the band number band_a share none before it: a pair is made in one band alone."""
    bits = np.zeros((bands, SAMPLES), np.uint8)
    np.put_along_axis(bits, band_places(bands, width), 1, 1)
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(int(m[0])).cast("long").alias("m0"), F.lit(int(m[1])).cast("long").alias("m1")) for k, m in enumerate(np.packbits(bits, axis=1, bitorder="little").view(np.int64))])
    shares = lambda u, m: (m["k"] < F.col("band_a")) & (u["u0"].bitwiseAND(m["m0"]).bitwiseOR(u["u1"].bitwiseAND(m["m1"])) == 0)
    return ~F.exists(F.array(F.struct(_unlike(0).alias("u0"), _unlike(1).alias("u1"))), lambda u: F.exists(masks, lambda m: shares(u, m)))


def _possible(share: float, alike: float) -> Column:
    """Lengths and samples of two entries of one level allow a link. Each word is named once, so that joins compile it."""
    differ, valid = F.lit(0), F.lit(0)
    for half in (0, 1):
        differ = differ + F.bit_count(_unlike(half))
        valid = valid + F.bit_count(F.col(f"f{16 + half}_a").bitwiseOR(F.col(f"f{16 + half}_b")))
    return (F.abs(F.col("n_a") - F.col("n_b")) <= F.lit(share) * F.greatest("n_a", "n_b")) & (differ <= valid * F.lit(1 - alike + 1e-9))


#: What rows of many pairs carry of a text: length and number of samples not past the end (nv), one of the eight bit planes.
LIGHT = ["nv", "f0", "f1"]


def _conceivable(a: dict[str, Column], b: dict[str, Column], share: float, alike: float) -> Column:
    """What _possible needs, of LIGHT: nothing possible fails it. Samples past the end are the last, so of two texts the longer's aren't in either."""
    n, valid = ([F.shiftright(x["nv"], 8) for x in (a, b)], [x["nv"].bitwiseAND(F.lit(255).cast("long")) for x in (a, b)])
    differ = F.bit_count(a["f0"].bitwiseXOR(b["f0"])) + F.bit_count(a["f1"].bitwiseXOR(b["f1"]))
    return (F.abs(n[0] - n[1]) <= F.lit(share) * F.greatest(*n)) & (differ <= F.greatest(*valid) * F.lit(1 - alike + 1e-9))


def _side(df: DataFrame, k: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == "key" else f"{c}_{k}") for c in df.columns])


def near_groups(marks: DataFrame, texts: DataFrame, share: float = 0.1, alike: float = 0.8, bands: int = 24, width: int = 8) -> DataFrame:
    """(h1, h2, root) of the texts that have a near one, over links: likeness alike or more, and an edit distance of at most share of the longer.

    marks: (h1, h2, n_chars, fingerprint), repeated ones too; texts: one column. A pair of likeness p shares a band with probability
    1 - (1 - p ** width) ** bands: 0.988 at 0.8. One shuffle by band gives each text the REPRESENTATIVES of its bands, the same in many bands,
    and what can't be near is left out in place. Each text is tested against the one it shares most bands with, then, of different
    components, against the others, so that n near copies come together by n times 24 * REPRESENTATIVES tests at most. Of the members that represent
    no band, all pairs of different components in a band are tested last, in slices of a band, each in the first band that the two share
    (where one of them represents that one, the pair has been tested). So no pair that shares a band is left out; a band of many texts
    that aren't near costs the square of their number, in comparisons of samples, and those alike in samples one of texts."""
    found = entries(marks.dropDuplicates(["h1", "h2"]), share, bands, width)
    kept = stage(found, "entries")
    sides = kept.select("tag", "h1", "h2", "n", *[F.get("samples", F.lit(k)).alias(f"f{k}") for k in range(WORDS)])
    possible, ids, band = _possible(share, alike), ["h1_a", "h2_a", "h1_b", "h2_b"], Window.partitionBy("key")
    one = F.struct("tag", *LIGHT)
    nv = (F.shiftleft("n", 8) + F.col("valid")).alias("nv")
    rows = kept.select("tag", nv, *[F.get("samples", F.lit(k)).alias(f"f{k}") for k in (0, 1)], F.explode("keys").alias("key"))
    rows = rows.withColumn("m", F.count("*").over(band)).where("m > 1")
    rows = rows.withColumn("some", F.array_distinct(F.array(*[F.min_by(one, F.xxhash64("tag", F.lit(k))).over(band) for k in range(REPRESENTATIVES)])))
    others = ~F.array_contains(F.col("some.tag"), F.col("tag")) & (F.col("m") > F.size("some") + 1)
    rows = rows.select("key", one.alias("o"), F.explode(F.when(others, F.concat("some", F.array(F.lit(None)))).otherwise(F.col("some"))).alias("r"))
    fits = _conceivable({c: F.col(f"o.{c}") for c in LIGHT}, {c: F.col(f"r.{c}") for c in LIGHT}, share, alike)
    rows = rows.where(F.col("r").isNull() | (F.col("o.tag") != F.col("r.tag")) & fits)
    alone = lambda c: F.when(F.col("r").isNull(), F.col(c))
    met = stage(rows.select(F.col("o.tag").alias("tag"), F.col("r.tag").alias("to"), alone("key").alias("key"), *[alone(f"o.{c}").alias(c) for c in LIGHT]), "met")

    @F.pandas_udf("boolean")
    def within(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([is_within(x, y, int(share * max(len(x), len(y)))) for x, y in zip(a, b, strict=True)], dtype=bool)

    def likely(pairs: DataFrame) -> DataFrame:
        """Of pairs (tag_a, tag_b) those whose samples allow a link."""
        tags = stage(pairs, "tags")
        few = sides.where(among("tag", bloom(tags.select("tag_a").union(tags.select("tag_b")))))
        pairs = stage(tags.join(_side(few, "a"), "tag_a").join(_side(few, "b"), "tag_b").where(possible).select(*ids).distinct(), "pairs")
        drop(tags)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        """Links of staged pairs (h1_a, h2_a, h1_b, h2_b)."""
        wanted = pairs.select(F.explode(F.array(F.struct(F.col("h1_a").alias("h1"), F.col("h2_a").alias("h2")), F.struct(F.col("h1_b").alias("h1"), F.col("h2_b").alias("h2")))).alias("x")).select("x.*").distinct()
        held = keyed_texts(texts, bloom(pairs.select("h1_a").union(pairs.select("h1_b")))).join(wanted.hint("shuffle_hash"), ["h1", "h2"], "left_semi")
        held = stage(held.groupBy("h1", "h2").agg(F.first("text").alias("text")), "held")
        both = pairs.join(_side(held, "a"), ["h1_a", "h2_a"]).join(_side(held, "b"), ["h1_b", "h2_b"])
        node = lambda k: F.struct(F.col(f"h1_{k}").alias("h1"), F.col(f"h2_{k}").alias("h2")).alias(k)
        links = stage(both.where(within("text_a", "text_b")).select(node("a"), node("b")), "links")
        drop(pairs, held)
        return links

    def components(roots: DataFrame) -> DataFrame:
        """Components of the entries that have a link; the others are each their own."""
        of = sides.select("tag", F.struct("h1", "h2").alias("node")).join(roots, "node").select("tag", F.col("root.h1").alias("c1"), F.col("root.h2").alias("c2"))
        return stage(of, "components")

    def placed(rows: DataFrame, of: DataFrame, tag: str = "tag", k: str = "") -> DataFrame:
        of = of.select(F.col("tag").alias(tag), F.col("c1").alias("_1"), F.col("c2").alias("_2"))
        return rows.join(of, tag, "left").withColumn(f"c1{k}", F.coalesce("_1", tag)).withColumn(f"c2{k}", F.coalesce("_2", F.lit(0))).drop("_1", "_2")

    apart = "c1_a <> c1_b or c2_a <> c2_b"
    shared = stage(met.where("to is not null").groupBy("tag", "to").count(), "shared")
    ends = [F.least("tag", "to").alias("tag_a"), F.greatest("tag", "to").alias("tag_b")]
    links = verified(likely(shared.groupBy("tag").agg(F.max(F.struct("count", "to")).alias("m")).select("tag", "m.to").select(*ends).distinct()))
    roots = connected(links)
    of = components(roots)
    rest = shared.select(*ends).distinct()
    new = verified(likely(placed(placed(rest, of, "tag_a", "_a"), of, "tag_b", "_b").where(apart).select("tag_a", "tag_b")))
    if not new.isEmpty():
        links = links.unionByName(new)
        roots = connected(links)
        drop(of)
        of = components(roots)
    # what is left: all pairs of different components of a band's other members, one side dealt to slices and the other sent to each of them
    left = placed(met.where("to is null").drop("to"), of)
    left = left.withColumns({"slices": F.ceil(F.count("*").over(band) / CROWD).cast("int"), **{f"{f.__name__}_{c}": f(c).over(band) for f in (F.min, F.max) for c in ("c1", "c2")}})
    left = stage(left.where("min_c1 < max_c1 or min_c2 < max_c2").select("key", "tag", *LIGHT, "c1", "c2", "slices"), "left")
    drop(met, shared)
    # all samples go along only with those that have a conceivable partner there
    one = _side(left.withColumn("slice", F.pmod(F.xxhash64("tag"), F.col("slices")).cast("int")).withColumnRenamed("key", "band"), "a")
    every = _side(left.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices").withColumnRenamed("key", "band"), "b")
    fits = _conceivable(*[{c: F.col(f"{c}_{k}") for c in LIGHT} for k in "ab"], share, alike)
    some = one.join(every, F.expr(f"band_a = band_b and slice_a = slice_b and ({apart})") & fits, "left_semi")
    some = some.groupBy(*[F.col(f"{c}_a").alias(c) for c in ("tag", "c1", "c2")]).agg(F.collect_list(F.struct(F.col("band_a").alias("key"), F.col("slices_a").alias("slices"))).alias("bands"))
    crowds = stage(some, "crowds")
    drop(left)
    if not crowds.isEmpty():
        few = kept.where(among("tag", bloom(crowds.select("tag"))))
        whole = crowds.join(few.select("tag", "keys", "h1", "h2", "n", *[F.get("samples", F.lit(k)).alias(f"f{k}") for k in range(WORDS)]), "tag").withColumn("_band", F.explode("bands"))
        whole = whole.withColumns({"key": F.col("_band.key"), "slices": F.col("_band.slices"), "band": F.array_position("keys", F.col("_band.key")) - 1}).drop("bands", "_band", "keys")
        one = _side(whole.withColumn("slice", F.pmod(F.xxhash64("tag"), F.col("slices")).cast("int")).drop("slices"), "a").withColumnRenamed("slice_a", "slice")
        every = _side(whole.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices", "band"), "b").withColumnRenamed("slice_b", "slice")
        last = one.join(every, ["key", "slice"]).where(F.expr("tag_a < tag_b") & F.expr(f"({apart})") & possible & _first_shared(bands, width))
        last = verified(stage(last.select(*ids).distinct(), "pairs"))
        if not last.isEmpty():
            roots = connected(links.unionByName(last))
    drop(of, crowds, kept)
    return roots.select("node.h1", "node.h2", "root")


def among(column: str, bits: np.ndarray) -> Column:
    """Whether a filter lets a long through."""
    shared = SparkSession.active().sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, ids.to_numpy(np.int64)))

    return run(column)


def keyed_texts(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(h1, h2, text) of the texts whose h1 the filter lets through; null is empty."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for part in slices(batches, 2 << 20):
            rows = [t or "" for t in part[0].to_pylist()]
            keys = [text_key(t) for t in rows]
            keep = passes(shared.value, np.array([k[0] for k in keys], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, x in zip(keys, keep, strict=True) if x], pa.int64()), pa.array([k[1] for k, x in zip(keys, keep, strict=True) if x], pa.int64()),
                                              pa.array([t for t, x in zip(rows, keep, strict=True) if x], pa.string())], names=["h1", "h2", "text"])

    return texts.mapInArrow(run, "h1 long, h2 long, text string")


def near_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """fingerprint_edits, and near_id: the smallest doc_id of the texts that are near, directly or over others, the own one included."""
    made = stage(fingerprint_edits(docs, doc_id, text), "fingerprints")
    groups = near_groups(made.select("h1", "h2", "n_chars", "fingerprint"), docs.select(F.col(text).cast("string").alias("text")), **options)
    own = made.groupBy("h1", "h2").agg(F.min("doc_id").alias("own"), F.count("*").alias("n")).join(groups, ["h1", "h2"], "left")
    own = stage(own.where("root is not null or n > 1"), "own")
    least = own.where("root is not null").groupBy("root").agg(F.min("own").alias("least"))
    near = stage(own.join(least, "root", "left").select("h1", "h2", F.coalesce("least", "own").alias("near")), "near")
    # rows are wide: only those that have a near or equal one are sent to a join, which a filter tells
    marked = made.withColumn("_may", among("h1", bloom(near.select("h1"))))
    alone = marked.where("not _may").withColumn("near_id", F.col("doc_id"))
    held = marked.where("_may").join(near, ["h1", "h2"], "left").withColumn("near_id", F.when(F.col("near").isNull(), F.col("doc_id")).otherwise(F.col("near"))).drop("near")
    return alone.unionByName(held).drop("_may", "h1", "h2")
