"""Mixing sources to target weights by the cube method (Deville and Tille 2004).

Every document of a source is taken floor(r) times and once more with probability frac(r), r being the source's
target over its size. Instead of drawing documents on their own, the cube method moves the vector of inclusion
probabilities through the null space of two constraints (number of documents, number of words), so both totals stay
exact until at most two documents of a block are undecided. Blocks of one source are balanced on their own, in
parallel; their undecided documents form new blocks, level by level, together with a bounded set of decided ones of
graded sizes. Once a source is down to one block, on a level of its own, it is landed: pairs of decided documents are traded for what is left
over, and where that stops over half a word off, an exact subset sum gives the nearest total that the block can reach.

Source sizes are sums over all rows. A source is cut into blocks by a hash of id, size, text and a number that tells
equal rows apart, so a hot source or id is only more blocks, and no block has more than a few thousand rows. Every draw is
seeded by source, level and block and rows are ordered by hash, so reruns agree.

Defined results: a null text has size 0; the null source comes last; rows repeated are units of their own; a
document of size 0 takes 0 words; without words every target is 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, drop, fresh, once, row_key, stage

BLOCK = 1024
FEW = 100_000  # sources whose rows may be broadcast
HALVES = 36  # units whose sums are listed by halves
UNITS = "doc_id string, no_source boolean, source string, size long, source_size long, target double, base long, p double, h long, taken long, carried boolean"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """no_source, source, source_size, n, target for rows of (no_source, source, size, count).

    share times all sizes is dealt by weight; a source's target stops at cap times its size and the excess is dealt
    again: target = min(cap * size, lam * weight), lam such that the targets sum to the share. Sorted by the lam at
    which each source stops, the k-th candidate for lam is closed form in running sums."""
    per = sizes.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"), F.sum("count").alias("n"))
    order = W.orderBy("no_source", "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by = W.orderBy(F.col("cap") / F.col("w"), "no_source", "source")
    upto, before = by.rowsBetween(W.unboundedPreceding, W.currentRow), by.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    per = (per.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
           .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
           .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
           .withColumn("lam", F.col("left") / F.col("w_left")))
    # the first source that doesn't stop fixes lam
    lam = F.min(F.when(F.col("lam") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("lam").alias("lam"))))
    per = per.withColumn("fixed", lam.over(every)["lam"])
    target = F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fixed") * F.col("w")))
    return per.select("no_source", "source", "source_size", "n", target.alias("target"))


def flight(p: list[float], size: list[int], rng: random.Random) -> list[float]:
    """Moves inclusion probabilities to 0 or 1 keeping sum(p) and sum(p * size), until at most two are left."""
    eps = 1e-9
    live = []
    for k in range(len(p)):
        if not eps < p[k] < 1 - eps:
            p[k] = float(round(p[k]))
            continue
        live.append(k)
        while len(live) >= 2:
            if len(live) >= 3:
                i, j, m = live
                u = {i: size[m] - size[j], j: size[i] - size[m], m: size[j] - size[i]}
                if not any(u.values()):
                    u = {i: 1, j: -1}
            elif size[live[0]] == size[live[1]]:
                u = {live[0]: 1, live[1]: -1}
            else:
                break
            up = down = float("inf")
            for x, v in u.items():
                if v > 0:
                    up, down = min(up, (1 - p[x]) / v), min(down, p[x] / v)
                elif v < 0:
                    up, down = min(up, -p[x] / v), min(down, (p[x] - 1) / v)
            step = up if rng.random() * (up + down) < down else -down
            for x, v in u.items():
                p[x] = min(1.0, max(0.0, p[x] + step * v))
            live = [x for x in live if eps < p[x] < 1 - eps]
    for k in range(len(p)):
        if not eps < p[k] < 1 - eps:
            p[k] = float(round(p[k]))
    return p


def land(p: list[float], size: list[int], goal: float) -> list[float]:
    """Decides the one or two that are left, then sets right what the decided ones leave over, keeping most of them.

    First two decided units at most are turned over, as long as the total comes nearer. Where that leaves more than half
    a word, nearest() finds the best total that the block can reach at all."""
    left = [k for k, x in enumerate(p) if x not in (0.0, 1.0)]
    off = sum(p[k] * size[k] for k in range(len(p)) if p[k] == 1.0) - goal
    best = min(range(1 << len(left)), key=lambda m: (abs(off + sum(size[k] for b, k in enumerate(left) if m >> b & 1)), m))
    for b, k in enumerate(left):
        p[k] = float(best >> b & 1)
        off += size[k] * p[k]
    while abs(off) > 0.5 and (turned := best_turn(p, size, off)):
        for k in turned:
            off += size[k] * (1 - 2 * p[k])
            p[k] = 1 - p[k]
    if abs(off) > 0.5:
        for k in nearest([n if x == 0.0 else -n for x, n in zip(p, size, strict=True)], off):
            p[k] = 1 - p[k]
    return p


def best_turn(p: list[float], size: list[int], off: float) -> tuple[int, ...]:
    """The one or two decided units whose turning over brings the total nearest; none if nothing brings it nearer."""
    step = sorted((size[k] * (1 - 2 * int(p[k])), k) for k in range(len(p)) if size[k])
    best, found, j = abs(off) - 1e-6, (), len(step) - 1
    for at, (d, k) in enumerate(step):
        if abs(off + d) < best:
            best, found = abs(off + d), (k,)
        while j > 0 and off + d + step[j][0] > 0:
            j -= 1
        for m in (j, j + 1):  # the pair's sums on either side of nothing left
            if m < len(step) and m != at and abs(off + d + step[m][0]) < best - 1e-9:
                best, found = abs(off + d + step[m][0]), (k, step[m][1])
    return found


def nearest(step: list[int], off: float, bits: int = 1 << 28) -> list[int]:
    """Which of the steps to take so that off plus their sum comes nearest to 0.

    An exact subset sum: reachable sums are the bits of an integer, one for each step more. Where those would take over
    so many bits (few, very long documents), sums of two halves meet instead: exact up to HALVES units, and 2^HALVES
    sums of graded ones beyond."""
    order = [k for k in range(len(step)) if step[k]]
    if (len(order) + 1) * sum(abs(step[k]) for k in order) > bits:
        return meet(step, off, order)
    low = -sum(step[k] for k in order if step[k] < 0)  # the bit of the sum 0
    reach = [1 << low]
    for k in order:
        n = step[k]
        reach.append(reach[-1] | (reach[-1] << n if n > 0 else reach[-1] >> -n))
    goal = low - off
    cut = max(0, math.floor(goal) + 1)
    under, over = reach[-1] & ((1 << cut) - 1), reach[-1] >> cut
    found = [under.bit_length() - 1] * bool(under) + [cut + (over & -over).bit_length() - 1] * bool(over)
    at = min(found, key=lambda x: (abs(x - goal), x))
    taken = []
    for j in range(len(order) - 1, -1, -1):
        if not reach[j] >> at & 1:
            taken.append(order[j])
            at -= step[order[j]]
    return taken


def meet(step: list[int], off: float, order: list[int]) -> list[int]:
    """The same over at most HALVES of the steps in order: the sums of two halves, sorted, meet around -off."""
    if len(order) > HALVES:
        order = [order[k] for k in graded([float(step[k] < 0) for k in order], [abs(step[k]) for k in order], HALVES)]
    halves = order[::2], order[1::2]
    sums = []
    for half in halves:
        total = np.zeros(1, np.int64)
        for k in half:
            total = np.concatenate([total, total + step[k]])
        sums.append(total)
    by = np.argsort(sums[1], kind="stable")
    at = np.searchsorted(sums[1][by], -off - sums[0])
    best = None
    for near in (np.maximum(at - 1, 0), np.minimum(at, len(by) - 1)):
        gap = np.abs(off + sums[0] + sums[1][by[near]])
        i = int(gap.argmin())
        if best is None or gap[i] < best[0]:
            best = gap[i], i, int(by[near[i]])
    return [k for half, mask in zip(halves, best[1:], strict=True) for b, k in enumerate(half) if mask >> b & 1]


def graded(p: list[float], size: list[int], most: int) -> list[int]:
    """At most so many decided documents, half of them taken and half not, dealt in turn from all size classes (powers of two), the largest of each first."""
    out: list[int] = []
    for side in (0.0, 1.0):
        seen: dict[int, int] = {}
        ranked = []
        for k in sorted((k for k, x in enumerate(p) if x == side), key=lambda k: (-size[k], k)):
            c = size[k].bit_length()
            seen[c] = seen.get(c, 0) + 1
            ranked.append((seen[c], -c, k))
        out += [k for *_, k in sorted(ranked)[: most // 2]]
    return out


def balancer(seed: int, level: int, block: int):
    """The flight of one block, and the landing too where it's the only one of its source; carried: goes on to the next level."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "size", "p"], kind="stable")
        p, size = part["p"].tolist(), part["size"].tolist()
        goal = sum(x * n for x, n in zip(p, size, strict=True))
        p = flight(p, size, random.Random(f"{seed}|{level}|{'|'.join(map(str, key))}"))
        carried = [False] * len(p)
        if part["_n"].iloc[0] <= block:
            p = land(p, size, goal)
        else:
            for k in graded(p, size, block // 4):
                carried[k] = True
            carried = [c or 0 < x < 1 for c, x in zip(carried, p, strict=True)]
        part["p"], part["carried"] = p, carried
        return part.drop(columns=["_n", "block"])

    return run


def beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows joined with a row for each source: sent whole to the tasks where they are FEW, else a join that AQE splits where a source is hot."""
    few = sources.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(sources) if few else sources, ["no_source", "source"])


def mix_to_targets(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
                   block: int = BLOCK, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), copies and taken (words, repeats counted)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
                       word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("digest"))
    sizes = stage(rows.groupBy("doc_id", "no_source", "source", "size", "digest").count(), "sizes")
    targets = stage(source_targets(sizes, weights, share, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.least(F.floor(ratio + 1e-12), F.floor(F.lit(float(cap)))).cast("long")
    units = beside(sizes, targets).withColumn("k", F.explode(F.sequence(F.lit(1), "count"))).select(
        F.col("doc_id").cast("string").alias("doc_id"), "no_source", "source", "size", "source_size", "target", base.alias("base"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio - base)).alias("p"), F.xxhash64("doc_id", "size", "digest", "k", F.lit(seed)).alias("h"),
        F.lit(0).cast("long").alias("taken"), F.col("n").alias("_n"))
    done = units.where("p <= 1e-9 or size = 0").drop("_n").withColumn("p", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("p")))
    rest = units.where("p > 1e-9 and size > 0")
    level = 0
    while True:  # dealt anew by block: rows that a join has dealt by source would stay together
        blocks = F.when(F.col("_n") <= block, F.lit(0)).otherwise(F.pmod(F.xxhash64("h", F.lit(level)), F.ceil(F.col("_n") / block)))
        moved = rest.withColumn("block", blocks.cast("long")).repartition("no_source", "source", "block").groupBy("no_source", "source", "block").applyInPandas(balancer(seed, level, block), UNITS)
        moved = stage(moved, "moved")
        done = done.unionByName(moved.where("not carried").drop("carried"))
        left = moved.where("carried").drop("carried")
        if left.isEmpty():
            break
        rest = beside(left, left.groupBy("no_source", "source").agg(F.count("*").alias("_n")))
        level += 1
    copies = F.col("base") + F.round("p").cast("long")
    return done.select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), F.when(~F.col("no_source"), F.col("source")).alias("source"),
                       "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows that the mix takes, each as often as it takes it, with their columns."""
    row, copies = fresh(docs, "row", "copies")
    keyed = docs.withColumn(row, row_key(docs))
    units = mix_to_targets(keyed, doc_id=row, **options)
    counts = units.groupBy(F.col("doc_id").alias(row)).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    return once(keyed, row).join(counts, row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
