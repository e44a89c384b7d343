"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Tokens score by their log-odds between toxic and other labelled documents under a Dirichlet prior drawn from all
training tokens (Monroe, Colaresi and Quinn 2008), less a margin and one and a half standard errors; what isn't surely
toxic costs a little. A token has the higher of two scores, its own and that of its first five bytes, so that
inflected forms count. Ruzzo and Tompa's linear scan finds every maximal scoring segment of a text. Under Karlin and Altschul's
statistics a segment of score S among n tokens has an expected number of chance equals of K * n * exp(-lambda * S),
lambda and a bound on K coming from the tokens of documents labelled clean; a text's evidence is that of its
significant segments together. A monotone fit on the training labels turns evidence into a probability.

Tokens are counted in 2^20 hash buckets, so counts, model and broadcast have one size whatever the corpus's. Counts
are summed in the tasks first and cover every labelled training row.

Defined results: null and empty texts have no tokens and get the score of texts without evidence; labels that are
null, or whose document isn't there, count for nothing; a document labelled twice counts with each label; without
toxic or without clean training rows every score is the share of toxic ones; ties and repeated rows score alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, hash_words, slices

BUCKETS = 1 << 20
BINS = 256
PREFIX = 5
REJECT = 0.7


@dataclass
class ToxicModel:
    """Token scores by bucket (of words, of their beginnings), lambda, log K, and the probability for each bin of evidence."""
    scores: np.ndarray
    scale: float
    log_k: float
    chance: np.ndarray


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def token_scores(clean: np.ndarray, toxic: np.ndarray, prior: float = 0.1, errors: float = 1.5, margin: float = 2.0, cost: float = 0.02) -> np.ndarray:
    """Log-odds less margin and error where that is positive, else a small cost. prior: tokens it's worth per token seen."""
    n0, n1 = clean.sum(), toxic.sum()
    if not n0 or not n1:
        return np.full(len(clean), -cost, np.float32)
    alpha = np.maximum((clean + toxic) * prior, 1e-3)
    a0 = alpha.sum()
    odds = np.log((toxic + alpha) / (n1 + a0 - toxic - alpha)) - np.log((clean + alpha) / (n0 + a0 - clean - alpha))
    sure = odds - errors * np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha)) - margin
    return np.where(sure > 0, sure, -cost).astype(np.float32)


def tokens(texts, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scores of all tokens of a column, and where each text's begin."""
    h, begins, start = hash_words(texts, alnum=True, prefix=PREFIX)
    return np.maximum(scores[0, bucket(h)], scores[1, bucket(start)]), begins


def karlin_lambda(clean: np.ndarray, scores: np.ndarray) -> float:
    """The lambda with E[exp(lambda * score)] = 1 over clean tokens; at most 1, which log-odds have by nature."""
    seen = clean > 0
    if not seen.any() or not (scores[seen] > 0).any():
        return 1.0
    w, s = clean[seen] / clean.sum(), scores[seen].astype(float)
    lo, hi = 0.0, 1.0
    if w @ np.exp(s) <= 1:
        return 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if w @ np.exp(mid * s) < 1 else (lo, mid)
    return max(lo, 0.05)


def karlin_k(clean: np.ndarray, scores: np.ndarray, scale: float) -> float:
    """log of a bound on K: a segment begins with a positive token. Unseen ones count as half a token."""
    up = scores > 0
    if not up.any():
        return float(-np.log(max(2, clean.sum())))
    seen = float(clean[up] @ np.exp(scale * scores[up].astype(float))) + 0.5 * float(np.exp(scale * scores[up].astype(float)).mean())
    return float(np.log(seen / max(1, clean.sum())))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in linear time (Ruzzo and Tompa 1999).

    Runs between positive tokens only matter by their sum, so the scan steps from one positive token to the next."""
    positive = np.flatnonzero(scores > 0)
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=float)])
    found: list[tuple[int, int, float, float, int]] = []  # begin, end, left sum, right sum, next candidate with a smaller left
    for x in positive.tolist():
        begin, end, left, right = x, x + 1, total[x], total[x + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((begin, end, left, right, j))
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in found]


def evidence(scores: np.ndarray, scale: float, log_k: float) -> float:
    """Over all segments, log(1 + 1 / e), e being the expected number of chance equals: near 0 for insignificant ones."""
    chance = np.log(max(1, len(scores))) + log_k
    return float(sum(np.logaddexp(0.0, scale * s - chance) for _, _, s in segments(scores)))


def evidence_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.ceil(np.log1p(x) * 32)).astype(np.int32)


def monotone(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Probabilities rising with the bin that fit k of n best (pooled neighbours), with one row of the overall share added to each."""
    share = (k.sum() + 0.5) / (n.sum() + 1)
    blocks: list[list[float]] = []
    for a, b in zip(n + 0.1, k + 0.1 * share, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            x = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], x, strict=True)]
    return np.concatenate([np.full(int(c), b / a) for a, b, c in blocks])


def _counts(rows: DataFrame) -> np.ndarray:
    """Token counts of rows (text, toxic): by kind (word, beginning), label and bucket; each task sums its own first."""

    def run(batches):
        total = np.zeros((4, BUCKETS), np.int64)
        for part in slices(batches):
            h, begins, start = hash_words(part[0], alnum=True, prefix=PREFIX)
            toxic = np.repeat(np.array(part[1].to_pylist(), np.int64), np.diff(begins)) * BUCKETS
            for k, x in ((0, h), (2, start)):
                total[k : k + 2] += np.bincount(toxic + bucket(x), minlength=2 * BUCKETS).reshape(2, BUCKETS)
        for kind in (0, 1):
            two = total[2 * kind : 2 * kind + 2]
            seen = np.flatnonzero(two.any(0))
            for at in range(0, len(seen), 65536):
                s = seen[at : at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array((s + kind * BUCKETS).astype(np.int32)), pa.array(two[0, s]), pa.array(two[1, s])],
                                                 names=["bucket", "clean", "toxic"])

    sums = rows.mapInArrow(run, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    out = np.zeros((2, 2 * BUCKETS), np.int64)
    at = sums["bucket"].to_numpy()
    out[0, at], out[1, at] = sums["clean"].to_numpy(), sums["toxic"].to_numpy()
    return out.reshape(2, 2, BUCKETS).transpose(1, 0, 2)


def _evidence_rows(docs: DataFrame, scores: np.ndarray, scale: float, log_k: float) -> DataFrame:
    """doc_id and the bin of its evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part[0].combine_chunks(), pa.array(evidence_bins(part[1], shared.value, scale, log_k))], names=["doc_id", "bin"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, bin int")


def evidence_bins(texts, scores: np.ndarray, scale: float, log_k: float) -> np.ndarray:
    s, begins = tokens(texts, scores)
    hits = np.concatenate([[0], np.cumsum(s > 0)])
    out = np.zeros(len(begins) - 1)
    for k in np.flatnonzero(hits[begins[1:]] > hits[begins[:-1]]):
        out[k] = evidence(s[begins[k] : begins[k + 1]], scale, log_k)
    return evidence_bin(out)


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> ToxicModel:
    """Learns from documents outside fold 1 of 3 and their labels."""
    train = _plain(docs, doc_id, text).where(fold(F.col("doc_id"), 3) != 1)
    marks = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("toxic in (0, 1) and doc_id is not null").where(fold(F.col("doc_id"), 3) != 1)
    counts = _counts(train.join(marks.hint("shuffle_hash"), "doc_id").select("text", "toxic"))
    scores = np.stack([token_scores(*kind) for kind in counts])
    scale = min(karlin_lambda(k[0], x) for k, x in zip(counts, scores, strict=True))
    log_k = float(np.logaddexp.reduce([karlin_k(k[0], x, scale) for k, x in zip(counts, scores, strict=True)]))
    seen = _evidence_rows(train, scores, scale, log_k).join(marks, "doc_id").groupBy("bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).collect()
    n, k = np.zeros(BINS), np.zeros(BINS)
    for r in seen:
        n[r["bin"]], k[r["bin"]] = r["n"], r["k"]
    return ToxicModel(scores, scale, log_k, monotone(n, k))


def score_toxicity(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted."""
    score = F.element_at(F.array(*[F.lit(float(x)) for x in model.chance]), F.col("bin") + 1)
    return (_evidence_rows(_plain(docs, doc_id, text), model.scores, model.scale, model.log_k)
            .select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), score.alias("score"), (score >= REJECT).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """The rows whose text isn't rejected, unchanged."""
    sc = docs.sparkSession.sparkContext
    shared, scale, log_k, chance = sc.broadcast(model.scores), model.scale, model.log_k, model.chance
    at = docs.columns.index(text)

    def run(batches):
        for part in slices(batches):
            kept = part.filter(pa.array(chance[evidence_bins(part[at], shared.value, scale, log_k)] < REJECT))
            yield from kept.to_batches()

    return docs.mapInArrow(run, docs.schema)


def toxic_passages(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every significant toxic passage: doc_id, first and last token number, score."""
    shared, scale = docs.sparkSession.sparkContext.broadcast(model.scores), model.scale
    log_k = model.log_k

    def run(batches):
        for part in slices(batches):
            s, begins = tokens(part[1], shared.value)
            rows = [(doc, a, b - 1, x) for k, doc in enumerate(part[0].to_pylist()) for a, b, x in segments(s[begins[k] : begins[k + 1]])
                    if scale * x - log_k > np.log(max(1, begins[k + 1] - begins[k]))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.float64()], strict=True)],
                                             names=["doc_id", "first_token", "last_token", "score"])

    return _plain(docs, doc_id, text).mapInArrow(run, "doc_id long, first_token long, last_token long, score double")
