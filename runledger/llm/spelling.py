"""Grouping of spelling variants by anagram hashing (Reynaert 2005).

A letter's value is its code point to the fifth power and a word's key is the sum over its letters, modulo a prime, so
anagrams share a key and an inserted, deleted or replaced letter changes it by one value or by a difference of two. Words
meet at the key that is left when one letter is taken out: a longer word less a letter has the shorter one's key, and two
words of one length that differ in one letter have the same rest. One changed letter leaves one half of a word as it was,
so the join also asks for a common half; that splits large classes of anagrams. Letter order is verified on the pairs.

Runs are counted in the tasks first, then summed by word. A word adds a row for each different letter of each half and
two for itself, whatever its length: 182 at most. The number of a word's near words is bounded by its length times the
alphabet, so neither keys nor forms grow with the corpus. Forms rise tenfold in count at each step: a few rounds reach
every root.

Defined results: null and empty texts have no words; a null id counts as the empty text; texts of any length are read
in parts that end between words; repeated rows count each time; a tie between forms goes to the word that is smallest in
code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, slices, stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(65, 91)}
PRIME = (1 << 61) - 1
PART = 1 << 20  # characters of a text that are read at a time
HELD = 1 << 18  # different words that a task holds before it gives them out


def parts(text: str):
    """The text in parts of about PART characters that end where no run goes on."""
    at = 0
    while at < len(text):
        cut = GAP.search(text, at + PART) if at + PART < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def run_counts(doc_id: str, text: str, shortest: int, every: int, counts: Counter) -> None:
    """Adds the text's words to counts. Where every divides the crc32 of "id:run", the run loses one letter."""
    prefix = zlib.crc32(f"{doc_id}:".encode())
    for part in parts(text):
        for run, n in Counter(RUN.findall(part)).items():
            if len(run) < shortest:
                continue
            run = run.lower() if run.isascii() else run.translate(LOWER)
            h = zlib.crc32(run.encode(), prefix)
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < shortest:
                    continue
            counts[run] += n


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n for words of at least so many letters and occurrences. every: 0 leaves the runs as they are."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            words = list(counts)
            for at in range(0, len(words), 65536):
                some = words[at : at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([counts[w] for w in some], pa.int64())], names=["word", "n"])
            counts.clear()

        for part in slices(batches):
            for doc, body in zip(part[0], part[1], strict=True):
                if (body := body.as_py()):
                    run_counts(doc.as_py(), body, shortest, every, counts)
                if len(counts) >= HELD:
                    yield from out()
        yield from out()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda k, x: F.when(x == "", k).otherwise((k + letter_value(x)) % PRIME))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of words (word, n) at one edit, once."""
    size, key = F.length("word"), anagram_key(F.col("word"))
    half = (size / 2).cast("int")
    left, right = F.substring("word", F.lit(1), half), F.substring("word", half + 1, size)
    rests = lambda lost, kept, side: F.transform(F.array_remove(F.array_distinct(F.split(lost, "")), ""), lambda x: F.struct(
        F.pmod(F.col("key") - letter_value(x), F.lit(PRIME)).alias("rest"), F.xxhash64(kept).alias("kept"), F.lit(side).alias("side"), size.alias("size"), F.lit(False).alias("whole")))
    longer = ((size + 1) / 2).cast("int")  # where a word with one letter more is halved
    whole = lambda kept, side: F.struct(F.col("key").alias("rest"), F.xxhash64(kept).alias("kept"), F.lit(side).alias("side"), (size + 1).alias("size"), F.lit(True).alias("whole"))
    met = words.withColumn("key", key).select("word", "n", F.inline(F.concat(
        rests(right, left, 0), rests(left, right, 1),
        F.array(whole(F.substring("word", F.lit(1), longer), 0), whole(F.substring("word", longer, size), 1)))))
    a, b = met.where("not whole").alias("a"), met.alias("b")
    same = F.expr("a.rest = b.rest and a.kept = b.kept and a.side = b.side and a.size = b.size and (b.whole or a.word < b.word)")
    # letter order; what can be taken from either half is found on both sides and counts on the first
    order = F.expr("levenshtein(a.word, b.word, 1) = 1 and (a.side = 0 or left(a.word, int(a.size / 2)) <> left(b.word, int(a.size / 2)))")
    return a.join(b, same & order).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for forms (word, form): the end of each chain. Chains are followed one step a round."""
    at = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    while not at.where("open").isEmpty():
        old = at
        moved = at.where("open").join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        at = stage(at.where("not open").unionByName(moved), "roots")
        drop(old)
    return at.drop("open")


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31, times: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n.

    form: the near word with the largest n, where that is at least so many times the word's own; root: where forms lead."""
    words = stage(word_counts(docs, shortest, least, every, doc_id, text), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    is_form = -F.col("best.less") >= F.lit(times) * F.col("n")
    near = stage(near.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "near")
    ends = roots(near.where("form is not null").select("word", "form"))
    told = near.join(ends, "word", "left")
    return words.join(told, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
