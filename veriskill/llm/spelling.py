"""Spelling variant groups: words one edit apart, found by Gram matrices of their letter counts.

One edit changes a word's letter counts by a squared distance of one (a letter more or less) or two (another letter). The
squared distances of all pairs of two blocks of words come from one matrix product. A block holds words of one length and
of equal counts in GROUPS groups of letters, which one edit changes by one as well: so a block meets those of its own cell,
those of the same length with one letter in another group, and those a letter longer with one more in some group. Pairs at
the right distance are verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriskill.llm.common import written

LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
DROP_EVERY = 199  # one in so many (document, word) pairs loses a letter
GROUPS = 6  # groups of letters, by code point modulo GROUPS
BLOCK = 512  # words of a block, on average at most
HELD = 1 << 18  # different words that a task counts before it sends them on
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})

#: Column of each Latin-1 letter in the letter counts.
COLUMN = np.zeros(256, np.int64)
COLUMN[97:123] = np.arange(26)
COLUMN[0xC0:] = 26 + np.arange(64)
LETTERS = 90


def noisy(doc_id: object, word: str) -> str:
    """`word` as it stands in the document: where the CRC of both is divisible by DROP_EVERY, it lacks one letter."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % DROP_EVERY else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of `least_letters` letters and `least_count` occurrences over all texts, at least.

    Words are runs of Latin letters with A-Z in lower case, some of them less one letter (`noisy`). A task counts before it
    sends words on, HELD different ones at a time. Null and empty texts have no words; a null doc_id counts as empty.
    """

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for k in range(len(texts)):
                own = ids[k].as_py()
                own = "" if own is None else own
                for word, n in Counter(RUN.findall((texts[k].as_py() or "").translate(LOWER))).items():
                    if len(word) >= least_letters and len(word := noisy(own, word)) >= least_letters:
                        held[word] += n
                if len(held) >= HELD:
                    yield sent()
        yield sent()

    counted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(stage, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _cells(words: DataFrame) -> DataFrame:
    """`words` with `cell`: the length and the counts of the letter groups, as an array."""
    letters = F.transform(F.split("word", ""), lambda c: F.pmod(F.ascii(c), F.lit(GROUPS)))
    counts = [F.expr(f"size(filter(of, x -> x = {g}))") for g in range(GROUPS)]
    return words.withColumn("of", letters).withColumn("cell", F.array(F.length("word"), *counts)).drop("of")


def _blocks(words: DataFrame) -> DataFrame:
    """(cell, part, letters, ns): the words of each cell in blocks of about BLOCK words at most, dealt by hash.

    As the words of a block are equally long, `letters` is all of them in Latin-1, one after the other.
    """
    placed = written(_cells(words), "cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = placed.join(parts, "cell").withColumn("part", F.expr("pmod(xxhash64(word), parts)"))
    blocks = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("word", "n")).alias("items"))
    return blocks.select("cell", "part", F.encode(F.array_join("items.word", ""), "ISO-8859-1").alias("letters"), F.col("items.n").alias("ns"))


def _counts(letters: np.ndarray) -> np.ndarray:
    """Letter counts of words (rows of Latin-1 codes)."""
    cell = COLUMN[letters] + LETTERS * np.arange(len(letters))[:, None]
    return np.bincount(cell.ravel(), minlength=LETTERS * len(letters)).reshape(-1, LETTERS).astype(np.float32)


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs one edit apart; words are rows of Latin-1 codes, those of `b` as long as those of `a` or a letter longer.

    `same`: both are one block, of which each pair is given once.
    """
    x = _counts(a)
    y = x if same else _counts(b)
    distance = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    if a.shape[1] == b.shape[1]:
        i, j = np.nonzero(distance == 2)
        i, j = (i[i < j], j[i < j]) if same else (i, j)
        good = (a[i] != b[j]).sum(1) == 1
    else:
        i, j = np.nonzero(distance == 1)
        head = np.cumprod(a[i] == b[j][:, :-1], axis=1).sum(1)
        tail = np.cumprod((a[i] == b[j][:, 1:])[:, ::-1], axis=1).sum(1)
        good = head + tail >= a.shape[1]
    return i[good], j[good]


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, n, other_n): pairs of `words` (word, n; words of Latin letters) one edit apart, in both directions."""
    blocks = written(_blocks(words), "blocks")
    up = lambda *g: [F.col("cell")[k] + sum(d for at, d in g if at == k) for k in range(GROUPS + 1)]
    longer = [F.array(*up((0, 1), (g + 1, 1))) for g in range(GROUPS)]
    other = [F.array(*up((g + 1, -1), (k + 1, 1))) for g in range(GROUPS) for k in range(g + 1, GROUPS)]
    sent = blocks.select("cell", "part", "letters", "ns", F.explode(F.array(F.col("cell"), *longer, *other)).alias("to"))
    home = blocks.select(F.col("cell").alias("to"), F.col("part").alias("of"), F.col("letters").alias("others"), F.col("ns").alias("other_ns"))
    met = sent.join(home, "to").where((F.col("cell") != F.col("to")) | (F.col("part") <= F.col("of")))
    met = met.select("letters", "ns", "others", "other_ns", ((F.col("cell") == F.col("to")) & (F.col("part") == F.col("of"))).alias("same"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks_of(batch: pa.RecordBatch, letters: str, ns: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            lists = batch.column(ns)
            for k in range(batch.num_rows):
                n = lists[k].values.to_numpy()
                yield np.frombuffer(batch.column(letters)[k].as_buffer(), np.uint8).reshape(len(n), -1), n

        text = lambda rows: [r.tobytes().decode("latin-1") for r in rows]
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for (a, n), (b, m), same in zip(blocks_of(batch, "letters", "ns"), blocks_of(batch, "others", "other_ns"), batch.column("same").to_pylist()):
                i, j = near_pairs(a, b, same)
                if len(i):
                    for col, more in zip(cols, (text(a[i]), text(b[j]), n[i].tolist(), m[j].tolist())):
                        col += more
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["word", "other", "n", "other_n"])

    found = written(met.mapInArrow(stage, "word string, other string, n bigint, other_n bigint"), "near")
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("other_n").alias("n"), F.col("n").alias("other_n")))


def variant_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of `words` (word, n; different words of Latin letters).

    A word's form is the near word of the largest n (ties: the smallest by code points), where that n is at least `times`
    the word's own (over once); else null, and the root is the word itself. The root follows forms to the last. Counts
    grow by `times` with every form, so the few forms of a word are followed in doublings.
    """
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    per = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.less") >= times * F.col("n")
    out = words.join(per, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    out = written(out, "forms")
    to = written(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        to = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return out.join(to, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of all words of `docs` that are long and frequent enough; see `variant_groups`.

    Null, empty and wordless texts give no words, very long ones are read whole, repeated rows count each time, an empty
    table gives an empty frame; other columns are dropped.
    """
    return variant_groups(written(word_counts(docs, doc_id, text, least_letters, least_count), "words"), times)
