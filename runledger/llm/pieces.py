"""SentencePiece encoding and decoding: the N best segmentations over the lattice of a public model's pieces.

The forward Viterbi pass gives every position the best score of any segmentation up to it. These scores are exact
heuristics for a backward A-star search: hypotheses grow from the end, ordered by their own score plus the forward
score of where they begin, so they complete in order of total score, best first. Equal ones are followed towards
the start, and of a position no more than N are: the N best of the whole need no others.

Where two neighbours stand next to each other in no piece, every segmentation has a border, so the lattice of a text
falls apart into units (about a word each) and a text's best segmentations combine its units'. Units repeat: each
distinct unit of a batch is searched once, and the forward and backward Viterbi passes run over all of them at once
in numpy. A backward pass also gives what a unit's second choice costs. Among N segmentations of a text only the N-1
occurrences whose second choice costs least can differ from the best one, so the A-star search runs over the
lattices of those alone and stays exact.

A text is encoded with a space put before it. Characters without a piece, and the space mark itself, become byte pieces, so decoding gives
back every text exactly.

Defined results: a null text is empty; an empty text has no pieces and no other segmentation; ties in score go to
the segmentation whose pieces are longer at the end; a long unbroken run takes time linear in its length; repeated rows give repeated rows; an empty table gives no
rows; other columns are ignored. The model's file is read on the driver and broadcast (32,000 pieces, fixed).
"""

from __future__ import annotations

import heapq
import re
from bisect import insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 1 << 13
LONGEST = 48
#: Scores below this mark pieces that the model lists without one (runs of spaces); they get the lowest score.
UNSCORED = -1e8


class PieceModel:
    def __init__(self, pieces: list[tuple[str, float]], unk: float | None = None):
        """pieces: (piece, score) by id; <0x..> are bytes."""
        self.bytes_ = [0] * 256
        self.raw: list[bytes] = []
        self.ids: dict[str, tuple[int, float]] = {}
        for i, (piece, score) in enumerate(pieces):
            if m := re.fullmatch("<0x([0-9A-F]{2})>", piece):
                self.bytes_[int(m[1], 16)] = i
                self.raw.append(bytes([int(m[1], 16)]))
            elif i < 3:
                self.raw.append(b"")
            else:
                self.ids[piece.replace(MARK, " ")] = (i, score)
                self.raw.append(piece.replace(MARK, " ").encode())
        low = min(s for _, s in self.ids.values() if s > UNSCORED)
        self.unk = low - 10 if unk is None else unk
        self.ids = {p: (i, s if s > UNSCORED else low) for p, (i, s) in self.ids.items()}
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p))}
        self.longest = max(map(len, self.ids))

    def edges(self, unit: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """The lattice's edges (start, ids, score) that lead to a position, longest first."""
        out = []
        for a in range(max(0, end - self.longest), end):
            if (hit := self.ids.get(unit[a:end])) is not None:
                out.append((a, (hit[0],), hit[1]))
        if not out or out[-1][0] < end - 1:
            raw = unit[end - 1].encode("utf-8", "surrogatepass")
            out.append((end - 1, tuple(self.bytes_[x] for x in raw), self.unk * len(raw)))
        return out

    def nbest(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations, best first: score and ids."""
        size = len(unit)
        if not size:
            return [(0.0, [])]
        ahead = [0.0] * (size + 1)
        for b in range(1, size + 1):
            ahead[b] = max(ahead[a] + s for a, _, s in self.edges(unit, b))
        heap, order, found, taken = [(-ahead[size], size, 0, 0.0, None)], 0, [], [0] * (size + 1)
        best: list[list[float]] = [[] for _ in range(size + 1)]  # of each position: the n best scores it was reached with
        while heap and len(found) < n:
            _, at, _, g, tail = heapq.heappop(heap)
            if taken[at] == n:
                continue
            taken[at] += 1
            if at == 0:
                ids = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                found.append((g, ids))
                continue
            for a, ids, s in self.edges(unit, at):
                if taken[a] < n and (len(best[a]) < n or s + g > best[a][0]):
                    insort(best[a], s + g)
                    del best[a][:-n]
                    order += 1
                    heapq.heappush(heap, (-(ahead[a] + s + g), a, order, s + g, (ids, tail)))
        return found

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def load_model(path: str = MODEL) -> list[tuple[str, float]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


def combine(costs: list[tuple[float, ...]], n: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """The n least sums of one cost from each list (ascending, first 0), by the same search over a chain: sum, and (list, place in it) where that isn't 0."""
    order = sorted((k for k, c in enumerate(costs) if len(c) > 1), key=lambda k: costs[k][1])[: n - 1]
    heap, pushed, found = [(0.0, len(order), 0, None)], 0, []
    while heap and len(found) < n:
        g, at, _, chosen = heapq.heappop(heap)
        if at == 0:
            picks = []
            while chosen:
                picks.append(chosen[0])
                chosen = chosen[1]
            found.append((g, picks))
            continue
        k = order[at - 1]
        for j, c in enumerate(costs[k]):
            pushed += 1
            heapq.heappush(heap, (g + c, at - 1, pushed, ((k, j), chosen) if j else chosen))
    return found


class Units:
    """Vectorised search over the distinct units of a batch of texts."""

    def __init__(self, model: PieceModel):
        self.model = model
        chars = sorted({c for p in model.ids for c in p})
        self.code = np.zeros(0x110000, np.int32)
        for k, c in enumerate(chars, 1):
            self.code[ord(c)] = k
        k = len(chars) + 1
        self.k = k
        self.joined = np.zeros(k * k, bool)
        for p in model.ids:
            c = self.code[[ord(x) for x in p]].astype(np.int64)
            self.joined[c[:-1] * k + c[1:]] = True
        self.single = np.zeros(k, bool)
        for c in chars:
            self.single[self.code[ord(c)]] = c in model.ids
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.longest = max(map(len, model.ids))
        # every prefix of a piece by its hash: an open-addressing table
        entries: dict[int, tuple[int, float, bool]] = {}
        for p in [*model.starts, *model.ids]:
            h = 0
            for c in p:
                h = (h * int(self.base) + int(self.code[ord(c)])) & (2**64 - 1)
            i, score = model.ids.get(p, (-1, float("-inf")))
            entries[h] = (i, score, p in model.starts)
        self.bits = max(4, (len(entries) * 16).bit_length())
        slots = 1 << self.bits
        self.key, self.at = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.id = np.array([e[0] for e in entries.values()] + [-1], np.int32)
        self.score = np.array([e[1] for e in entries.values()] + [-np.inf])
        self.more = np.array([e[2] for e in entries.values()] + [False])
        for n, h in enumerate(entries):
            x = self._slot(np.array([h], np.uint64))[0]
            while self.at[x] >= 0:
                x = (x + 1) % slots
            self.key[x], self.at[x] = h, n

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Entries of prefix hashes; -1 (the last entry) where there is none."""
        x = self._slot(h)
        out = self.at[x]
        odd = np.flatnonzero((out >= 0) & (self.key[x] != h))
        while len(odd):
            x[odd] = (x[odd] + 1) % len(self.at)
            out[odd] = self.at[x[odd]]
            odd = odd[(out[odd] >= 0) & (self.key[x[odd]] != h[odd])]
        return out

    def split(self, text: str) -> tuple[np.ndarray, ...]:
        """Code points and character codes of a text, and the starts and lengths of its units."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.code[points]
        cut = ~self.joined[c[:-1].astype(np.int64) * self.k + c[1:]]
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        return points, c, starts, np.diff(np.append(starts, len(points)))

    def viterbi(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For units of one length (rows of codes): best score, cost of the second choice, ids and their number."""
        u, n = c.shape
        top = min(n, self.longest)
        scores = np.full((top + 1, u, n + 1), -np.inf)
        ids = np.full((top + 1, u, n + 1), -1, np.int32)
        row, col = np.divmod(np.arange(u * n), n)
        h = np.zeros(u * n, np.uint64)
        for k in range(1, top + 1):
            h = h * self.base + c[row, col + k - 1].astype(np.uint64)
            e = self.look_up(h)
            scores[k, row, col], ids[k, row, col] = self.score[e], self.id[e]
            go = self.more[e] & (e >= 0) & (col + k < n)
            row, col, h = row[go], col[go], h[go]
            if not len(row):
                top = k
                break
        ahead = np.full((n + 1, u), -np.inf)
        back = np.zeros((n + 1, u), np.int8)
        ahead[0] = 0
        for b in range(1, n + 1):
            for k in range(min(top, b), 0, -1):
                s = ahead[b - k] + scores[k, :, b - k]
                better = s > ahead[b]
                ahead[b][better], back[b][better] = s[better], k
        after = np.full((n + 1, u), -np.inf)
        after[n] = 0
        for a in range(n - 1, -1, -1):
            for k in range(1, min(top, n - a) + 1):
                np.maximum(after[a], after[a + k] + scores[k, :, a], out=after[a])
        best = ahead[n]
        out = np.full((u, n), -1, np.int32)
        at, filled, rows = np.full(u, n), np.zeros(u, np.int64), np.arange(u)
        on = np.zeros((top + 1, u, n + 1), bool)
        while len(rows):
            k = back[at[rows], rows].astype(np.int64)
            at[rows] -= k
            out[rows, n - 1 - filled[rows]] = ids[k, rows, at[rows]]
            on[k, rows, at[rows]] = True
            filled[rows] += 1
            rows = rows[at[rows] > 0]
        second = np.full(u, -np.inf)
        for a in range(n):
            for k in range(1, min(top, n - a) + 1):
                s = ahead[a] + scores[k, :, a] + after[a + k]
                np.maximum(second, np.where(on[k, :, a], -np.inf, s), out=second)
        return best, best - second, out, filled

    def search(self, text: str, n_best: int, slow) -> tuple:
        """The distinct units: pool of ids, where each one's begin and how many, score, second cost; and each occurrence's unit."""
        points, c, starts, sizes = self.split(text)
        power = np.ones(int(sizes.max()), np.uint64)
        power[1:] = self.base
        power = np.cumprod(power)
        # hash of each unit: sum of code * base^place, by segments; the size keeps padding apart
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        h = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * power[place], starts)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + sizes.astype(np.uint64)
        _, first, unit = np.unique(h, return_index=True, return_inverse=True)
        n = len(first)
        score, second = np.zeros(n), np.full(n, np.inf)
        pool_at, pool_n, pool, used = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        size = sizes[first]
        plain = np.logical_and.reduceat(self.single[c], starts)[first] & (size <= LONGEST)
        for length in np.unique(size[plain]):
            for which in np.array_split(np.flatnonzero(plain & (size == length)), -(-int((plain & (size == length)).sum()) // 4_000)):
                rows = c[starts[first[which]][:, None] + np.arange(length)]
                score[which], second[which], ids, filled = self.viterbi(rows)
                keep = np.arange(length)[None, :] >= length - filled[:, None]
                pool_at[which], pool_n[which] = used + np.cumsum(filled) - filled, filled
                pool.append(ids[keep])
                used += len(pool[-1])
        for k in np.flatnonzero(~plain):
            a = starts[first[k]]
            found = slow(text[a : a + size[k]])
            score[k], second[k] = found[0][0], (found[0][0] - found[1][0] if len(found) > 1 else np.inf)
            pool_at[k], pool_n[k] = used, len(found[0][1])
            pool.append(np.array(found[0][1], np.int32))
            used += pool_n[k]
        return np.concatenate(pool), pool_at, pool_n, score, second, unit, starts, sizes


def ragged(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices at[0], at[0] + 1, ... n[0] of them, then those of the next."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + n, n)


OTHERS_SQL = "others array<struct<score:double,swaps:array<struct<at:int,n:int,ids:array<int>>>>>"
OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("swaps", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def swapped(ids: list[int], swaps) -> list[int]:
    """The ids of another segmentation, given the best one's."""
    out = list(ids)
    for at, n, new in sorted(((x["at"], x["n"], x["ids"]) for x in swaps), reverse=True):
        out[at : at + n] = new
    return out


_READY: dict[str, tuple] = {}


def encode_documents(docs: DataFrame, model: str = MODEL, n_best: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids, score, others, exact (decoding gives the text).

    others has the next n_best - 1 segmentations, best first: score, and where they differ from ids, as swaps: instead of the
    `n` ids from place `at` (counted in the best one) stand others. `swapped` writes one out."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model))

    def run(batches):
        if model not in _READY:  # a worker serves many tasks
            ready = PieceModel(shared.value)
            _READY[model] = ready, Units(ready), lru_cache(CACHE)(ready.nbest)
        ready, units, nbest = _READY[model]
        raw = ready.raw
        for part in slices(batches, 2 << 20):
            texts = [" " + t if t else "" for t in part[1].to_pylist()]
            full = [k for k, t in enumerate(texts) if t]
            n, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            other: list[list[tuple]] = [[] for _ in texts]
            exact = np.ones(len(texts), bool)
            ids = np.empty(0, np.int32)
            if full:
                whole = "\n".join(texts[k] for k in full) + "\n"  # nothing joins a newline: it is a unit of its own
                pool, pool_at, pool_n, scores, second, unit, starts, sizes = units.search(whole, n_best, lambda u: nbest(u, n_best))
                ends = np.cumsum([len(texts[k]) + 1 for k in full])
                upto = np.searchsorted(starts, ends)
                kept = np.ones(len(unit), bool)
                kept[upto - 1] = False  # the newlines between the texts
                ids = pool[ragged(pool_at[unit[kept]], pool_n[unit[kept]])]
                counts = np.where(kept, pool_n[unit], 0)
                lower = np.concatenate([[0], upto[:-1]])
                n[full] = np.add.reduceat(counts, lower)
                score[full] = np.add.reduceat(np.where(kept, scores[unit], 0.0), lower)
                costs = np.where(kept, second[unit], np.inf)
                upto_here = np.cumsum(counts) - counts
                at = 0
                for k, a, b in zip(full, lower, upto, strict=True):
                    exact[k] = b"".join([raw[i] for i in ids[at : at + n[k]].tolist()]) == texts[k].encode("utf-8", "surrogatepass")
                    at += n[k]
                    if n_best > 1:
                        near = np.argpartition(costs[a:b], n_best - 2)[: n_best - 1] + a if b - a >= n_best else np.arange(a, b)
                        near = [x for x in near if costs[x] < np.inf]
                        found = []
                        for x in near:  # of equal ones the first is what the text was given
                            own = pool[pool_at[unit[x]] : pool_at[unit[x]] + counts[x]].tolist()
                            next_ = nbest(whole[starts[x] : starts[x] + sizes[x]], n_best)
                            found.append([(next_[0][0], own), *[f for f in next_ if f[1] != own][: n_best - 1]])
                        for cost, picks in combine([tuple(f[0][0] - s for s, _ in f) for f in found], n_best)[1:]:
                            swaps = sorted((int(upto_here[near[i]] - upto_here[a]), int(counts[near[i]]), found[i][j][1]) for i, j in picks)
                            other[k].append((score[k] - cost, swaps))
            flat = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [part[0].combine_chunks().cast(pa.int64()), pa.array(n), flat, pa.array(score), pa.array(other, OTHERS), pa.array(exact)],
                names=["doc_id", "n_pieces", "ids", "score", "others", "exact"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(
        run, f"doc_id long, n_pieces long, ids array<int>, score double, {OTHERS_SQL}, exact boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the texts decoded from its ids; null ids are an empty text."""
    from pyspark.sql import functions as F

    shared = encoded.sparkSession.sparkContext.broadcast(load_model(model))

    @F.pandas_udf("string")
    def decode(column):
        m = PieceModel(shared.value)
        return column.map(lambda x: "" if x is None else m.decode(x))

    return encoded.withColumn(text, decode(F.col(ids)))
