"""LM scoring: a gated recurrent language model and a unigram baseline, learnt from one part of the corpus.

Words and their counts cover the whole training part. The network predicts symbols: the most frequent words and the
end have one each, all other words share one for each class of first three bytes, inside which a word w has
probability (c(w) + 1) / (sum of (c + 1) + 1), the last 1 standing for any word never seen. So every text has a
probability, of which the network's class-factored softmax, trained by truncated backpropagation through windows,
gives the symbols. The state runs on over windows from a text's first word to its end: scores are of whole texts.

Training is data-parallel: in each round every task trains on its share of the training texts, all of them over the
rounds, from the same weights, and the weights are averaged by tokens, summed by Spark. Frequent words (at most
HEAD, by count) are broadcast; the rest of the vocabulary is joined by key. The network has a fixed size. Words are
told apart by 64-bit hashes.

Defined results: a null, empty or white text is its end alone; texts with the same words score alike; without training texts every
base score is 0; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyIndex, fold, hash_words, mixed, slices, stage
from .gru import Network, Trainer, score_documents

HEAD = 1 << 18
SHORT = 511
KINDS = 512
PREFIX = 3
#: The end's hash, apart from words' by chance.
END = np.uint64(0x1D8AF9C5E3B7A641)
LOG10 = float(np.log(10))


def _kind(prefix: np.ndarray) -> np.ndarray:
    return (prefix >> np.uint64(55)).astype(np.int32)


def word_counts(docs: DataFrame) -> DataFrame:
    """h, kind, c of every word of (doc_id, text), the end included; tasks sum their own first."""

    def merged(held):
        h, kind, c = (np.concatenate(x) for x in zip(*held, strict=True))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return u, kind[first], np.bincount(inverse, c, len(u)).astype(np.int64)

    def batch(rows):
        for at in range(0, len(rows[0]), 1 << 17):
            h, kind, c = (x[at : at + (1 << 17)] for x in rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind), pa.array(c)], names=["h", "kind", "c"])

    def run(batches):
        held, size = [], 0
        for part in slices(batches):
            h, begins, prefix = hash_words(part[0], prefix=PREFIX)
            u, first, c = np.unique(h, return_index=True, return_counts=True)
            held += [(u, _kind(prefix[first]), c.astype(np.int64)), (np.array([END]), np.zeros(1, np.int32), np.array([len(begins) - 1]))]
            size += len(u)
            if size > 1 << 22:
                yield from batch(merged(held))
                held, size = [], 0
        if held:
            yield from batch(merged(held))

    return docs.select("text").mapInArrow(run, "h long, kind int, c long").groupBy("h").agg(F.first("kind").alias("kind"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Frequent words and their counts, symbols, and the mass of each kind of other words."""
    head: np.ndarray
    count: np.ndarray
    tokens: int
    words: int
    symbol: np.ndarray  # by number in head, the end last; -1: by kind
    kinds: np.ndarray  # symbol of each kind
    log_mass: np.ndarray  # log10 of each kind's sum of (c + 1) + 1
    symbol_counts: np.ndarray
    end: int
    end_count: int

    def index(self) -> KeyIndex:
        return KeyIndex(self.head)

    def read(self, texts, index: KeyIndex):
        """Words, where texts begin, each word's number in head (or -1), and the symbols with ends, and where those begin."""
        h, begins, prefix = hash_words(texts, prefix=PREFIX)
        at = index.find(h)
        s = np.where(at >= 0, self.symbol[at], -1)
        kind = _kind(prefix)
        s = np.where(s >= 0, s, self.kinds[kind])
        full = np.insert(s, begins[1:], self.end)
        return h, begins, at, kind, full, begins + np.arange(len(begins))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Reduces the counts to what has a fixed size: at most `head` words, by a threshold on the count, and sums by kind."""
    words = counts.where(F.col("h") != int(END.view(np.int64)))
    total = words.groupBy("kind").agg(F.sum(F.col("c") + 1).alias("mass"), F.count("*").alias("n"), F.sum("c").alias("c")).toArrow()
    ends = counts.where(F.col("h") == int(END.view(np.int64))).agg(F.sum("c")).first()[0] or 0
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = sorted(((r[0], r[1]) for r in words.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, have = 1 << 20, 0
    for k, n in levels:
        if have + n > head:
            break
        least, have = k, have + n
    top = words.where(level >= least).toArrow()
    h, c, kind = (top[x].to_numpy() for x in ("h", "c", "kind"))
    order = np.lexsort((h, -c))
    h, c, kind = h[order].view(np.uint64), c[order], kind[order]
    mass = np.zeros(KINDS)
    kc = np.zeros(KINDS)
    at = total["kind"].to_numpy()
    mass[at], kc[at] = total["mass"].to_numpy(), total["c"].to_numpy()
    short = min(SHORT, len(h))
    np.subtract.at(mass, kind[:short], c[:short] + 1)
    np.subtract.at(kc, kind[:short], c[:short])
    every = np.concatenate([c[:short], kc, [ends]])
    order = np.argsort(-every, kind="stable")
    number = np.empty(len(every), np.int32)
    number[order] = np.arange(len(every))
    symbol = np.full(len(h) + 1, -1, np.int32)
    symbol[:short] = number[:short]
    n_words = int(total["n"].to_numpy().sum()) + (ends > 0)
    return Vocabulary(h, c, int(total["c"].to_numpy().sum()) + ends, n_words, symbol, number[short : short + KINDS],
                      np.log10(mass + 1), every[order], int(number[-1]), int(ends))


def train(docs: DataFrame, vocab: Vocabulary, hidden: int = 16, rounds: int = 2, streams: int = 256, steps: int = 16, rate: float = 0.02) -> np.ndarray:
    """The network's weights, from all rows of (doc_id, text); round k takes the texts whose id falls into part k."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    weights = Network(vocab.symbol_counts, hidden).flat()
    for k in range(rounds):
        start = docs.sparkSession.sparkContext.broadcast(weights)

        def run(batches, start=start):
            vocab, tokens, index, trainer = shared.value, 0, None, None
            for part in slices(batches, 8 << 20, 1 << 14):
                if trainer is None:
                    index = vocab.index()
                    trainer = Trainer(Network(vocab.symbol_counts, hidden).load(start.value), vocab.end, streams, steps, rate)
                symbols = vocab.read(part[0], index)[4]
                trainer.feed(symbols)
                tokens += len(symbols)
            if tokens:
                flat = trainer.net.flat().astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * tokens), pa.array(np.full(len(flat), float(tokens)))],
                                                 names=["i", "sum", "tokens"])

        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("text")
        mean = part.mapInArrow(run, "i int, sum double, tokens double").groupBy("i").agg((F.sum("sum") / F.sum("tokens")).alias("v")).toArrow()
        if mean.num_rows:
            weights = np.empty(mean.num_rows, np.float32)
            weights[mean["i"].to_numpy()] = mean["v"].to_numpy()
    return weights


def _keys(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A digest of each text's words in their order."""
    place = np.arange(len(h)) - np.repeat(begins[:-1], np.diff(begins))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))])
    return (total[begins[1:]] - total[begins[:-1]]).view(np.int64)


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: np.ndarray, hidden: int = 16) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for rows of (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    shared, net = sc.broadcast(vocab), sc.broadcast(weights)

    def run(batches):
        vocab, index = shared.value, None
        for part in slices(batches, 8 << 20, 1 << 14):
            if index is None:
                index = vocab.index()
                model = Network(vocab.symbol_counts, hidden).load(net.value)
                logs = np.append(np.log10(vocab.count + 1.0), 0.0)
            h, begins, at, kind, symbols, ends = vocab.read(part[1], index)
            n = np.diff(begins)

            def sums(x, begins=begins):
                t = np.concatenate([[0.0], np.cumsum(x, dtype=float)])
                return t[begins[1:]] - t[begins[:-1]]

            rare, unheaded = vocab.symbol[at] < 0, np.flatnonzero(at < 0)
            tails = np.searchsorted(unheaded, begins).astype(np.int32)
            log_p = score_documents(model, symbols, ends, vocab.end) / LOG10 + sums(np.where(rare, logs[at] - vocab.log_mass[kind], 0.0))
            yield pa.RecordBatch.from_arrays(
                [part[0].combine_chunks(), pa.array(_keys(h, begins)), pa.array(n + 1), pa.array(sums(at >= 0).astype(np.int64) + (vocab.end_count > 0)),
                 pa.ListArray.from_arrays(tails, pa.array(h[unheaded].view(np.int64))), pa.array(sums(logs[at]) + np.log10(vocab.end_count + 1)), pa.array(log_p)],
                names=["doc_id", "key", "n_tokens", "n_known", "tail", "base", "log_p"])

    rows = stage(docs.mapInArrow(run, "doc_id long, key long, n_tokens long, n_known long, tail array<long>, base double, log_p double"), "scored")
    rare = rows.where(F.size("tail") > 0)
    rest = rare.select("key", "n_tokens", F.explode("tail").alias("h")).join(counts.select("h", "c"), "h").groupBy("key", "n_tokens").agg(
        F.sum(F.log10(F.col("c") + 1)).alias("logs"), F.count("*").alias("known"))
    copies = rare.groupBy("key", "n_tokens").agg(F.count("*").alias("m"))
    rest = rest.join(copies, ["key", "n_tokens"]).select("key", "n_tokens", (F.col("logs") / F.col("m")).alias("logs"), (F.col("known") / F.col("m")).alias("known"))
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.join(rest, ["key", "n_tokens"], "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.round(F.coalesce("known", F.lit(0.0))).cast("long")).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(np.log10(vocab.tokens + vocab.words + 1))).alias("base_score"), (F.col("log_p") + logs).alias("score"))


def score_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 7, held: int = 2) -> DataFrame:
    """Learns from the texts outside part `held` of `parts` and scores all."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    part = fold(F.col("doc_id"), parts)
    learn = docs.where(part != held)
    counts = stage(word_counts(learn), "counts")
    vocab = vocabulary(counts)
    return score(docs, counts, vocab, train(learn, vocab)).withColumn("held_out", part == held)
