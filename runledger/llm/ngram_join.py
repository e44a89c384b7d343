"""N-gram Jaccard join by parity sketches: every pair of texts whose shingle sets are similar enough, linked.

A text's set holds its distinct word shingles. Similarity num/den bounds the symmetric difference of two sets by
D = (|A| + |B|) * (den - num) / (den + num). Shingles are dealt by hash over D + s chunks and each chunk is the XOR of
its shingles' hashes, so of two linked sets' chunks s at least are equal (pigeonhole). Sets are put into size
bands that grow by half, with one number of chunks for each; a set near a band's upper end is sketched for the next
band too, so every pair within reach meets in one band. A set is looked up by each of its chunks that has a shingle.
A set with e < s empty chunks shares s - e keys at least with each set that it's linked with. One with s or more has
keys of three empty chunks too: two such sets that share no other key have s empty ones in common, so the first
three of those are among the first e - s + 3 of either.

A second sketch has one bit toggled for each shingle; the Hamming distance of two of them never exceeds the symmetric
difference, which rules out nearly all pairs that met by chance.

Equal sets of a partition are sent once, and keys that one set has alone drop out. Of the sets that share a key each is
tested against the first and the last, found by aggregates that combine before the shuffle. Then components are found,
and only keys that hold sets of different components stay. As a linked pair shares s - e keys, each set can do without its
s - e - 1 most frequent ones: the rarest common key of two linked sets stays with both. Most sets that meet by a
passage have no key left. What's left is compared within keys where components differ, all of it, by sketches inside the join. So no
link between components is lost; groups of n copies cost 2 n tests for each key, sets that resemble each other but stay
below the threshold the square of their number. What passes is verified by counting common shingles; the sets that needs are
picked out by a Bloom filter of fixed size, so others aren't shuffled.

Shingles are compared by 64-bit hashes and sets named by 128 bits of their sums. Nothing is broadcast or collected but
that filter and counts.

Defined results: a text with fewer words than a shingle has is one shingle as a whole; a null, empty or white text has
no shingles and links with nothing; rows that share a doc_id but not the text have classes of their own; a row without
doc_id links like others, and a component without any id has a null one; repeated rows give repeated rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bloom, drop, hash_words, mixed, passes, slices, stage
from .graph import connected

FOLD = 16
#: How many sets a task remembers, and which bits of a digest keys are sent with.
SEEN = 1 << 20
NAMES = (1 << 47) - 1
#: Bytes of text that a task hashes at once.
BATCH = 1 << 20


def band_starts(limit: int = 1 << 40) -> np.ndarray:
    starts = [1]
    while starts[-1] < limit:
        starts.append(max(starts[-1] + 1, starts[-1] * 3 // 2))
    return np.array(starts)


def band_reach(starts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most that two linked sets of a band may differ by."""
    return 2 * (starts[1:] - 1) * (den - num) // (den + num)


def band_slack(starts: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """How many chunks a band has beyond its reach: 3 and an eighth of it, or more, up to twice the reach, where so many chunks may well be empty."""
    out = []
    for start, r in zip(starts.tolist(), reach.tolist(), strict=False):
        slack = np.unique(np.linspace(3 + r // 8, max(3, 2 * r), 50).astype(np.int64))
        empty = (r + slack) * np.exp(-start / (r + slack))
        enough = slack[empty + 2 * np.sqrt(empty) <= slack]
        out.append(int(enough[0] if len(enough) else slack[0]))
    return np.array(out)


def shingle_sets(texts, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    h, begins = hash_words(texts)
    factor = mixed(np.arange(1, words + 1, dtype=np.uint64))
    if len(h) >= words:
        rolled = h[: len(h) - words + 1] * factor[0]
        for k in range(1, words):
            rolled = rolled + h[k : len(h) - words + 1 + k] * factor[k]
        rolled = mixed(rolled)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(rolled[a : b - words + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(mixed((h[a:b] * factor[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def parity_sketch(shingles: np.ndarray, words: int = FOLD) -> np.ndarray:
    """64 * words bits, each the parity of the shingles that hash to it."""
    place = (mixed(shingles) & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=words * 64) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def chunk_keys(shingles: np.ndarray, band: int, reach: int, slack: int = 3) -> tuple[np.ndarray, int]:
    """The keys by which a set (sorted hashes) is looked up in a band, and how many of them it shares at least with any set that it is linked with."""
    if not reach:  # only equal sets can be linked
        return np.empty(0, np.uint64), 1
    k = reach + slack
    place = ((shingles >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)  # rises with the hash
    first = np.flatnonzero(np.diff(place, prepend=-1))
    full = place[first]
    salt = np.uint64(band) << np.uint64(40)
    keys = mixed(np.bitwise_xor.reduceat(mixed(shingles), first) + mixed(full.astype(np.uint64) + salt))
    n_empty = k - len(full)
    if n_empty < slack:
        return keys, slack - n_empty
    empty = np.setdiff1d(np.arange(k), full, assume_unique=True)[: n_empty - slack + 3]
    three = np.array(list(combinations(empty.tolist(), 3)), np.uint64)
    return np.concatenate([keys, mixed(mixed(mixed(three[:, 0] + salt) + three[:, 1]) + three[:, 2])]), 1


SET = pa.struct([("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("fold", pa.list_(pa.int64()))])


def _digest(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum().view(np.int64)), int(mixed(s).sum().view(np.int64))


def shingle_set(text: Column, words: int) -> Column:
    """A text's set: its size n, 128-bit digest (s1, s2) and parity sketch (null where it's empty)."""

    @F.arrow_udf("struct<n:long,s1:long,s2:long,fold:array<long>>")
    def run(texts: pa.Array) -> pa.Array:
        parts = (shingle_sets(texts.slice(k, 256), words) for k in range(0, len(texts), 256))
        return pa.array([(len(s), *_digest(s), parity_sketch(s)) if len(s) else (0, 0, 0, None) for sets in parts for s in sets], SET)

    return run(text)


def key_rows(texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(key, tag) for each distinct set of a partition and each of its keys.

    A tag holds 47 bits of s1, whether the key is of the next band, and how many such keys a linked pair shares at least."""
    starts = band_starts()
    reach = band_reach(starts, num, den)
    slack = band_slack(starts, reach)

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for part in slices(batches, BATCH):
            keys, tags = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for s in shingle_sets(part[0], words):
                n = len(s)
                if not n or (digest := _digest(s)) in seen:
                    continue
                if len(seen) == SEEN:  # what comes again after this is only shuffled again
                    seen.clear()
                seen.add(digest)
                band = int(np.searchsorted(starts, n, "right")) - 1
                for up in range(1 + (n * den >= num * int(starts[band + 1]))):
                    found, least = chunk_keys(s, band + up, int(reach[band + up]), int(slack[band + up]))
                    keys.append(found)
                    tags.append(np.full(len(found), (digest[0] & NAMES) << 16 | up << 15 | min(least, 32767)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(tags))], names=["key", "tag"])

    return texts.mapInArrow(run, "key long, tag long")


def shingle_rows(texts: DataFrame, words: int, wanted: np.ndarray) -> DataFrame:
    """The shingles of the sets whose first digest the filter lets through."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        bits = shared.value
        for part in slices(batches, BATCH):
            sets = [s for s in shingle_sets(part[0], words) if len(s)]
            first = np.array([_digest(s)[0] for s in sets], np.int64)
            keep = passes(bits, first)
            sets = [s for s, k in zip(sets, keep, strict=True) if k]
            yield pa.RecordBatch.from_arrays([pa.array(first[keep]), pa.array([_digest(s)[1] for s in sets], pa.int64()),
                                              pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["s1", "s2", "shingles"])

    return texts.mapInArrow(run, "s1 long, s2 long, shingles array<long>")


def hamming(a: str, b: str) -> Column:
    """Distance of two sketches, given as FOLD columns each: plain expressions, so that joins compile it."""
    return sum((F.bit_count(F.col(f"f{k}_{a}").bitwiseXOR(F.col(f"f{k}_{b}"))) for k in range(FOLD)), F.lit(0))


@dataclass
class Rule:
    words: int
    num: int
    den: int

    def reach(self) -> Column:
        return F.floor((F.col("n_a") + F.col("n_b")) * (self.den - self.num) / (self.den + self.num))

    def possible(self) -> Column:
        """Sizes and sketches allow a link."""
        return ((F.least("n_a", "n_b") * self.den >= F.greatest("n_a", "n_b") * self.num) & (hamming("a", "b") <= self.reach()))

    def verified(self, near: DataFrame, texts: DataFrame) -> DataFrame:
        """The links (a, b) among pairs of sets, by counting common shingles."""
        ids = near.select(F.explode(F.array(F.struct(F.col("s1_a").alias("s1"), F.col("s2_a").alias("s2")), F.struct(F.col("s1_b").alias("s1"), F.col("s2_b").alias("s2")))).alias("id")).select("id.*").distinct()
        found = shingle_rows(texts, self.words, bloom(ids.select("s1"))).join(ids.hint("shuffle_hash"), ["s1", "s2"], "left_semi")
        sets = stage(found.groupBy("s1", "s2").agg(F.first("shingles").alias("set")), "sets")
        side = lambda k: sets.select(*[F.col(c).alias(f"{c}_{k}") for c in sets.columns])
        common = F.size(F.array_intersect("set_a", "set_b"))
        links = stage(near.join(side("a"), ["s1_a", "s2_a"]).join(side("b"), ["s1_b", "s2_b"]).withColumn("common", common)
                      .where(F.col("common") * self.den >= (F.col("n_a") + F.col("n_b") - F.col("common")) * self.num)
                      .select(F.struct(F.col("s1_a").alias("s1"), F.col("s2_a").alias("s2")).alias("a"), F.struct(F.col("s1_b").alias("s1"), F.col("s2_b").alias("s2")).alias("b")), "links")
        drop(sets)
        return links


def _name(c: str = "s1") -> Column:
    return F.col(c).bitwiseAND(F.lit(NAMES))


def _side(df: DataFrame, k: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == "key" else f"{c}_{k}") for c in df.columns])


def linked_sets(sets: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(s1, s2, root) of the sets that have a link; root is the struct (s1, s2) of one set in each component.

    sets: (n, s1, s2, fold) of the texts that have a shingle, repeated ones too; texts: one column."""
    rule = Rule(words, num, den)
    sketch = [F.get("fold", F.lit(k)).alias(f"f{k}") for k in range(FOLD)]
    folds = stage(sets.select(_name().alias("name"), "n", "s1", "s2", *sketch).dropDuplicates(["s1", "s2"]), "folds")
    keys = key_rows(texts, words, num, den)
    ends = stage(keys.groupBy("key").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("shiftright(low, 16) < shiftright(high, 16)"), "ends")
    members = stage(keys.join(ends, "key"), "members")

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.where(rule.possible()).select("s1_a", "s2_a", "n_a", "s1_b", "s2_b", "n_b").distinct()

    name = {c: F.shiftright(c, 16) for c in ("low", "tag", "high")}
    pairs = members.select(F.explode(F.array(F.struct(name["low"].alias("name_a"), name["tag"].alias("name_b")), F.struct(name["tag"].alias("name_a"), name["high"].alias("name_b")))).alias("p")).select("p.*").where("name_a < name_b")
    twins = folds.groupBy("name").count().where("count > 1").select(F.col("name").alias("name_a"), F.col("name").alias("name_b"))
    pairs = pairs.unionByName(twins).distinct().join(_side(folds, "a"), "name_a").join(_side(folds, "b"), "name_b").where("name_a < name_b or s1_a < s1_b or s1_a = s1_b and s2_a < s2_b")
    found = stage(near(pairs), "near")
    links = rule.verified(found, texts)
    roots = connected(links)
    drop(found, ends)

    own = F.struct("s1", "s2")
    comp = folds.select("name", own.alias("node")).join(roots, "node", "left").select("name", F.coalesce("root", "node").alias("c")).select("name", F.col("c.s1").alias("c1"), F.col("c.s2").alias("c2"))
    placed = stage(members.select("key", "tag", name["tag"].alias("name")).join(comp, "name").distinct(), "placed")
    apart = placed.groupBy("key").agg(F.count("*").alias("many"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("c1", "c2")]).where("min_c1 < max_c1 or min_c2 < max_c2").select("key", "many")
    rank = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("many"), "key"))
    rare = placed.join(apart, "key").withColumn("rank", rank).where(F.col("rank") >= F.col("tag").bitwiseAND(F.lit(32767)))
    rest = stage(rare.select("key", "name", "c1", "c2").join(folds, "name"), "open")
    drop(members, placed)
    if not rest.isEmpty():
        a, b = _side(rest, "a"), _side(rest, "b")
        met = a.join(b, (a["key"] == b["key"]) & F.expr("(name_a < name_b) and (c1_a <> c1_b or c2_a <> c2_b)") & rule.possible())
        found = stage(near(met), "near")
        new = rule.verified(found, texts)
        drop(found)
        if not new.isEmpty():
            roots = connected(links.unionByName(new))
        drop(new)
    drop(rest, folds, links)
    return roots.select("node.s1", "node.s2", "root")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (of any type with an order), n_shingles, class_id (smallest doc_id with the same set) and component_id (smallest within reach of links)."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), shingle_set(F.col(text).cast("string"), words).alias("s")).select("doc_id", "s.*"), "rows")
    roots = linked_sets(rows.where("n > 0"), texts, words, num, den)
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id")).join(roots, ["s1", "s2"], "left")
    classes = stage(classes.withColumn("root", F.coalesce("root", F.struct("s1", "s2"))), "classes")
    least = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = rows.drop("fold").join(classes, ["s1", "s2"], "left").join(least, "root", "left")
    own = F.col("n") == 0
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
