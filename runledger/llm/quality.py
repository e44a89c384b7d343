"""Document quality by a factorisation machine (Rendle 2010).

A document's features are its hashed words, statistics of its structure in bins, and its metadata in bins. The machine's
logit has a weight for each feature and, for each pair, the dot product of two short vectors; the sum over all pairs is
half of (sum of v * x)^2 - sum of (v * x)^2, linear in the number of features. Words count by log(1 + n), scaled to
length 1; every statistic has a fine bin and a coarse one, of the same value.

Features are computed by Spark's tasks, vectorised over a batch's bytes; the model has one size whatever the corpus's and
is broadcast. It is fitted by AdaGrad on a sample of at most SAMPLE different labelled texts with at most ENTRIES features
together, those with the least hashes: documented bounds, which keep what reaches the driver under 100 MB. All documents
are scored, whole.

Defined results: null and empty texts have no words and the bins of empty statistics; labels that are null, or whose
document isn't there, count for nothing; a document labelled twice counts with each label; equal texts with equal
metadata score alike (scores have nine digits); without a label of either kind every score is the share of good ones, smoothed; ties and repeated
rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fold, hash_words, slices, stage

WORDS = 1 << 16  # buckets of hashed words
BINS = 24
COARSE = 6  # bins that a coarse one holds
EACH = BINS + BINS // COARSE  # numbers of a statistic
FACTORS = 8
SAMPLE = 20_000
ENTRIES = 8_000_000
KEEP = 0.3
#: Characters whose share of a text is a statistic; a last one is all other ASCII signs.
SIGNS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".", "comma": b",;:", "ask": b"?", "shout": b"!", "bar": b"|", "line": b"\n", "quote": b"'\"()-"}
STATISTICS = ["words", "letters", "wide", *SIGNS, "other", "word_length", "different", "again", "long_words", "line_length", "shouted", "signs_at_end"]


@dataclass
class QualityModel:
    """Bias, weights and vectors of the machine; share: of good ones, where nothing could be learnt."""
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    share: float | None = None


def share_bin(x: np.ndarray) -> np.ndarray:
    """0 for nothing, then finer bins for small shares of 0 to 1."""
    return np.where(x > 0, 1 + np.minimum(BINS - 2, np.sqrt(np.clip(x, 0, 1)) * (BINS - 2)), 0).astype(np.int64)


def log_bin(x: np.ndarray, each: float = 1.0) -> np.ndarray:
    return np.minimum(BINS - 1, np.log2(1 + np.maximum(x, 0)) * each).astype(np.int64)


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column, and where each text begins in them (one entry more)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = (texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of a text's bytes (or words) are in the mask."""
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


_CLASS = np.full(256, len(SIGNS) + 1, np.uint8)
for _k, _signs in enumerate(SIGNS.values()):
    _CLASS[list(_signs)] = _k
_CLASS[[*range(97, 123), 32, 9, 11, 12, 13, *range(128, 256)]] = len(SIGNS) + 2


def features(texts: pa.Array, meta: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of a column's texts, and where each text's begin (one entry more)."""
    raw, offsets = _raw(texts)
    h, begins = hash_words(texts, alnum=True)
    n, doc = len(offsets) - 1, np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    size, words = np.maximum(1, np.diff(offsets)), np.diff(begins)
    kinds = _CLASS[raw]
    letters = (kinds == 0) | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    last = np.zeros(len(raw), bool)  # a white-space word's last byte
    if len(raw):
        last[:-1] = inside[:-1] & ~inside[1:]
        last[-1] = inside[-1]
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        last[ends] = inside[ends]
    tokens, lines = _per_text(last, offsets), _per_text(raw == 10, offsets) + 1
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    # words of a text by bucket, each once, with its count
    place, count = np.unique(doc * WORDS + (h >> np.uint64(48)).astype(np.int64), return_counts=True)
    of, bucket = place // WORDS, place % WORDS
    log = np.log1p(count)
    norm = np.sqrt(np.bincount(of, log * log, minlength=n))
    different = np.bincount(of, minlength=n)
    shares = [_per_text(kinds == k, offsets) / size for k in range(len(SIGNS) + 1)]
    upper_words = _per_text(last & (kinds == 0), offsets)
    signs_at_end = _per_text(last & (kinds == len(SIGNS) + 1), offsets)
    some = np.maximum(1, tokens)
    found = [log_bin(words), share_bin(_per_text(letters, offsets) / size), share_bin(_per_text(raw >= 192, offsets) / size), *map(share_bin, shares),
             log_bin(_per_text(inside, offsets) / some, 4), share_bin(different / np.maximum(1, words)), share_bin(_per_text(again, begins) / np.maximum(1, words)),
             share_bin((words > 0) * np.clip(size / np.maximum(1, words) / 64, 0, 1)), log_bin(tokens / lines, 2), share_bin(upper_words / some), share_bin(signs_at_end / some)]
    for column in meta:
        known = np.array([x is not None for x in column.to_pylist()], bool)
        value = np.array([0.0 if x is None else float(x) for x in column.to_pylist()])
        found.append(np.where(known, np.minimum(log_bin(value), BINS - 2), BINS - 1))
    own = np.stack([WORDS + k * EACH + y for k, x in enumerate(found) for y in (x, BINS + x // COARSE)], 1)
    numbers = np.concatenate([own.ravel(), bucket])
    values = np.concatenate([np.full(own.size, 0.5), log / np.maximum(norm[of], 1e-9)])
    rows = np.concatenate([np.repeat(np.arange(n), own.shape[1]), of])
    order = np.argsort(rows, kind="stable")
    return numbers[order].astype(np.int32), values[order].astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)


def logits(model: QualityModel, numbers: np.ndarray, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """bias + sum of w * x + half of ((sum of v * x)^2 - sum of (v * x)^2), by text."""
    if len(begins) < 2:
        return np.empty(0)
    values = values.astype(float)
    linear = np.add.reduceat(model.weights[numbers] * values, begins[:-1])
    vx = model.vectors[numbers] * values[:, None]
    total = np.add.reduceat(vx, begins[:-1])
    return model.bias + linear + 0.5 * (total * total - np.add.reduceat(vx * vx, begins[:-1])).sum(1)


def fit_machine(numbers: np.ndarray, values: np.ndarray, begins: np.ndarray, good: np.ndarray, dims: int,
                epochs: int = 12, batch: int = 256, rate: float = 0.1, decay: float = 2e-3, seed: int = 11) -> QualityModel:
    """Logistic loss, AdaGrad, mini-batches in an order of their own in each epoch."""
    rng = np.random.default_rng(seed)
    share = (good.sum() + 0.5) / (len(good) + 1)
    model = QualityModel(float(np.log(share / (1 - share))), np.zeros(dims, np.float32), rng.normal(0, 0.02, (dims, FACTORS)).astype(np.float32))
    if not 0 < good.sum() < len(good):
        model.share = float(share)
        return model
    seen_w, seen_v, seen_b = np.full(dims, 1e-4, np.float32), np.full((dims, FACTORS), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(good))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = begins[pick + 1] - begins[pick]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.repeat(begins[pick] - starts[:-1], sizes) + np.arange(starts[-1])
            x = values[flat]
            used, local = np.unique(numbers[flat], return_inverse=True)
            vx = model.vectors[numbers[flat]] * x[:, None]
            total = np.add.reduceat(vx, starts[:-1])
            z = model.bias + np.add.reduceat(model.weights[numbers[flat]] * x, starts[:-1]) + 0.5 * (total * total - np.add.reduceat(vx * vx, starts[:-1])).sum(1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[pick]) / len(pick)
            each = np.repeat(error, sizes) * x
            grad_w = np.bincount(local, each, len(used)) + decay / len(order) * model.weights[used]
            pull = each[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            grad_v = np.stack([np.bincount(local, pull[:, k], len(used)) for k in range(FACTORS)], 1) + decay / len(order) * model.vectors[used]
            grad_b = float(error.sum())
            seen_b += grad_b * grad_b
            seen_w[used] += grad_w * grad_w
            seen_v[used] += grad_v * grad_v
            model.bias -= rate * grad_b / np.sqrt(seen_b)
            model.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            model.vectors[used] -= 0.3 * rate * grad_v / np.sqrt(seen_v[used])
    return model


def _plain(docs: DataFrame, doc_id: str, text: str, meta: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(c).cast("double").alias(f"meta{k}") for k, c in enumerate(meta)])


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ("n_chars",),
                sample: int = SAMPLE, entries: int = ENTRIES) -> QualityModel:
    """Learns from documents outside fold 0 of 5 and their labels. meta: numeric columns of docs."""
    digest = F.xxhash64("text", *[f"meta{k}" for k in range(len(meta))])
    train = _plain(docs, doc_id, text, meta).where("doc_id is not null").where(fold(F.col("doc_id"), 5) != 0).withColumn("digest", digest)
    marks = labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) quality").where("quality in (0, 1) and doc_id is not null").distinct()
    rank = F.xxhash64("doc_id", "digest", "quality", F.lit(5))
    chosen = train.select("doc_id", "digest").join(marks.hint("shuffle_hash"), "doc_id").select(rank.alias("rank"), "doc_id", "digest", "quality").distinct().orderBy("rank", "doc_id", "digest", "quality").limit(sample)
    rows = train.join(F.broadcast(chosen), ["doc_id", "digest"]).dropDuplicates(["rank", "doc_id", "digest", "quality"])  # chosen: sample rows of four numbers
    extra = [f"meta{k}" for k in range(len(meta))]

    def run(batches):
        for part in slices(batches):
            numbers, values, begins = features(part[2], [part[k + 3] for k in range(len(extra))])
            lists = [pa.LargeListArray.from_arrays(pa.array(begins), pa.array(x)) for x in (numbers, values)]
            yield pa.RecordBatch.from_arrays([part[0].combine_chunks(), part[1].combine_chunks(), *[x.cast(pa.list_(x.type.value_type)) for x in lists]], names=["rank", "quality", "numbers", "values"])

    found = rows.select("rank", "quality", "text", *extra).mapInArrow(run, "rank long, quality int, numbers array<int>, values array<float>")
    # the first of them by rank whose features stay within bounds; only those come to the driver
    found = stage(found, "features")
    sizes = found.select("rank", F.size("numbers").alias("size")).orderBy("rank").toPandas()
    within = sizes["rank"][sizes["size"].cumsum() <= entries]
    table = found.where(F.col("rank") <= (int(within.max()) if len(within) else -(1 << 63))).orderBy("rank", "quality").toArrow()
    drop(found)
    dims = WORDS + (len(STATISTICS) + len(meta)) * EACH
    begins = np.concatenate([[0], np.cumsum([len(x) for x in table["numbers"]])]).astype(np.int64)
    flat = [table[c].combine_chunks().flatten().to_numpy() if len(table) else np.empty(0) for c in ("numbers", "values")]
    return fit_machine(flat[0].astype(np.int64), flat[1], begins, table["quality"].to_numpy().astype(float), dims)


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for part in slices(batches, max_bytes=2 << 20):
            if m.share is not None:
                score = np.full(len(part), m.share)
            else:
                score = 1 / (1 + np.exp(-np.clip(logits(m, *features(part[1], [part[k] for k in range(2, part.num_columns)])), -30, 30)))
            yield pa.RecordBatch.from_arrays([part[0].combine_chunks(), pa.array(np.round(score, 9))], names=["doc_id", "score"])

    scored = _plain(docs, doc_id, text, meta).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
