"""Token counts: a separator scan over flat token files without an index.

A token file is a stream of fixed-width token ids, documents one after the other, each closed by an end-of-document
id. Files are stored as consecutive blocks of a fixed number of tokens (file, block, data), cut without regard to
documents. A block is searched for separators with one vectorised comparison. A document may begin blocks before
its separator, so blocks are stitched with a prefix scan: running sums of tokens and separators and the last
separator's place before each block, per file over one row for each block.

Defined results: a null or empty text is a document of 0 tokens; runs of any length, of white space too, are encoded as ever; repeated rows are documents of their own; tokens
after the last separator of a file are an unfinished document (closed = false); a block that isn't a whole number of
tokens raises ValueError; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 1 << 18
#: The characters that the pattern's \\s matches (Unicode's White_Space).
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 4096
BLOCKS = "file long, block long, data binary, closes array<long>"


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary as bytes and ranks; its size is fixed by the public file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(ranks: dict[bytes, int], long_run: int = LONG_RUN):
    """Encodes a text. A long run of white space, which the pattern's engine can't take, goes to the vocabulary as the one piece it is.

    That piece ends before the run's last character, unless the text does: the last one belongs to what follows."""
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = tiktoken.Encoding("whole", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    runs = re.compile(f"[{SPACES}]{{{long_run},}}")

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for m in runs.finditer(text):
            end = m.end() - (m.end() < len(text))
            ids += plain.encode_ordinary(text[at : m.start()])
            ids += whole.encode_ordinary(text[m.start() : end])
            at = end
        return ids + plain.encode_ordinary(text[at:])

    return encode


def token_blocks(docs: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenizes the texts into flat files, one for each partition: file, block, data (16-bit ids), closes.

    The separator is the first id that the vocabulary leaves free. closes names the documents whose separators the
    block holds; the scan doesn't read it."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(tokenizer))

    def run(batches):
        encode = encoder(ranks.value)
        end = np.array([len(ranks.value)], np.uint16)
        file, block, held, size, closes = TaskContext.get().partitionId(), 0, [], 0, []

        def cut(flush: bool):
            nonlocal block, held, size, closes
            stream = np.concatenate(held) if held else np.empty(0, np.uint16)
            rows, at = [], 0
            ends = np.flatnonzero(stream == end[0])
            while len(stream) - at >= block_tokens or (flush and at < len(stream)):
                upto = min(at + block_tokens, len(stream))
                n = int(np.searchsorted(ends, upto) - np.searchsorted(ends, at))
                rows.append((file, block, stream[at:upto].tobytes(), closes[:n]))
                closes, block, at = closes[n:], block + 1, upto
            held, size = [stream[at:]], len(stream) - at
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                names=["file", "block", "data", "closes"])

        for part in slices(batches, 4 << 20):
            for doc, text_ in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
                ids = encode(text_) if text_ else []
                held += [np.array(ids, np.uint16), end]
                size += len(ids) + 1
                closes.append(doc)
            if size >= 4 * block_tokens:
                yield cut(False)
        if size:
            yield cut(True)

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, BLOCKS)


def scan_blocks(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """file, doc_no, n_tokens, closed: every document of flat files given as (file, block, data)."""
    parts = "file long, block long, n long, n_ends long, first long, last long, inner array<long>"

    def run(batches):
        for batch in batches:
            out = []
            for file, block, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if len(data or b"") % width:
                    raise ValueError("a block has part of a token")
                ids = np.frombuffer(data or b"", f"<u{width}")
                ends = np.flatnonzero(ids == separator)
                out.append((file, block, len(ids), len(ends), int(ends[0]) if len(ends) else None,
                            int(ends[-1]) if len(ends) else None, (np.diff(ends) - 1).tolist()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64()] * 6 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             names=["file", "block", "n", "n_ends", "first", "last", "inner"])

    found = blocks.select("file", "block", "data").mapInArrow(run, parts)
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    placed = (found.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .withColumn("doc_no", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
              .withColumn("open_at", F.coalesce(F.last(F.col("at") + F.col("last") + 1, ignorenulls=True).over(before), F.lit(0)))
              .withColumn("is_last", F.lead("block").over(order).isNull()))
    closed = placed.where("n_ends > 0").select(
        "file", "doc_no", F.posexplode(F.concat(F.array(F.col("at") + F.col("first") - F.col("open_at")), "inner")).alias("k", "n_tokens")
    ).select("file", (F.col("doc_no") + F.col("k")).alias("doc_no"), "n_tokens", F.lit(True).alias("closed"))
    start = F.when(F.col("n_ends") > 0, F.col("at") + F.col("last") + 1).otherwise(F.col("open_at"))
    rest = placed.where("is_last").select("file", (F.col("doc_no") + F.col("n_ends")).alias("doc_no"),
                                          (F.col("at") + F.col("n") - start).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest.where("n_tokens > 0"))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens: writes the token files and counts their documents' tokens by the scan."""
    separator = len(load_ranks(tokenizer))
    blocks = stage(token_blocks(docs, tokenizer, block_tokens, doc_id, text), "tokens")
    order = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    names = blocks.select("file", "block", "closes").withColumn(
        "doc_no", F.coalesce(F.sum(F.size("closes")).over(order), F.lit(0))).select(
        "file", "doc_no", F.posexplode("closes").alias("k", "doc_id")).select(
        "file", (F.col("doc_no") + F.col("k")).alias("doc_no"), "doc_id")
    return scan_blocks(blocks, separator).join(names, ["file", "doc_no"]).select("doc_id", "n_tokens")
