"""Quality rules: statistics of each text, a base rule, and an isolation forest over the statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriskill.llm.common import SPACE, arrow_stage, word_bounds, word_hashes, written

MIN_WORDS, MAX_REPEAT, REPEAT_WINDOW = 10, 20, 5
#: The method's own: each tree isolates SUBSAMPLE rows, drawn for it alone from all labelled rows.
TREES, SUBSAMPLE = 100, 256
#: Of the rows labelled good, at most this share may be found anomalous.
MOST_GOOD_LOST = 0.002
LEAST_AREA, BAD_SHARE = 0.6, 0.02

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The counts named in `STATS` and the shares named in `FEATURES`. A null or empty text has zeros."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    start, end = word_bounds(data)
    n = len(start)
    symbols = int(SYMBOL[data].sum())
    if not n:
        return [0, 0, symbols, 0, 0], [0.0] * len(FEATURES)
    chars = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(chars & ~SPACE[data])])
    word_chars = int((at[end] - at[start]).sum())
    words = word_hashes(data, start, end)
    repeat = 0
    if n >= REPEAT_WINDOW:
        m = n - REPEAT_WINDOW + 1
        gram = np.zeros(m, np.uint64)
        for k in range(REPEAT_WINDOW):
            gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m]
        order = np.argsort(gram)
        same = gram[order][1:] == gram[order][:-1]
        twice = np.zeros(m, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(n + 1, np.int64)
        cover[np.flatnonzero(twice)] += 1
        cover[np.flatnonzero(twice) + REPEAT_WINDOW] -= 1
        repeat = int((np.cumsum(cover)[:n] > 0).sum())
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\v\f\r")]  # those with a word
    dup_lines = len(lines) - len(set(lines))
    size = max(1, word_chars)
    upper = int(((data >= 65) & (data <= 90)).sum())
    marks = int(((data == 33) | (data == 63) | (data == 124)).sum())
    return [n, word_chars, symbols, dup_lines, repeat], [symbols / size, dup_lines / max(1, len(lines)), repeat / n, upper / size, marks / size]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the counts of `STATS` and `features` (array of double) for every row; one narrow Arrow pass.

    Null and empty texts have zeros; a very long text is looked at whole, in memory in proportion to it; repeated rows
    are all kept, an empty table gives an empty frame. Other columns are dropped, whatever their names.
    """

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        rows = [text_stats(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "features": [f for _, f in rows]} | {s: [c[k] for c, _ in rows] for k, s in enumerate(STATS)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_stage(docs.select("doc_id", F.col(text).alias("text")), each, f"doc_id {kind}, " + ", ".join(f"{s} bigint" for s in STATS) + ", features array<double>")


@dataclass
class IsolationForest:
    """Trees of random splits in flat arrays; `score` is 2^(-mean path length / the length expected)."""

    feature: np.ndarray  # -1: a leaf
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray  # of a leaf: its depth and the mean depth below, had it been split further
    roots: list[int]
    expected: float
    threshold: float = 1.0
    use: list[int] | None = None  # the statistics looked at

    @staticmethod
    def mean_depth(n: int) -> float:
        return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n

    @staticmethod
    def fit(samples: list[np.ndarray], seed: int = 7) -> IsolationForest:
        """A tree for each of `samples`, which have equally many rows."""
        rng = np.random.default_rng(seed)
        size = max(map(len, samples), default=0)
        most = int(np.ceil(np.log2(max(2, size))))
        nodes: list[list[float]] = []

        def grow(x: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, depth + IsolationForest.mean_depth(len(x))])
            wide = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 and depth < most else []
            if len(wide):
                f = int(rng.choice(wide))
                s = float(rng.uniform(x[:, f].min(), x[:, f].max()))
                nodes[me][:2] = f, s
                nodes[me][2] = grow(x[x[:, f] <= s], depth + 1)
                nodes[me][3] = grow(x[x[:, f] > s], depth + 1)
            return me

        roots = [grow(x, 0) for x in samples if len(x)]
        flat = np.array(nodes, float).reshape(-1, 5)
        return IsolationForest(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], roots, max(1e-9, IsolationForest.mean_depth(size)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        rows = rows if self.use is None else rows[:, self.use]
        total = np.zeros(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while len(go := np.flatnonzero(self.feature[at] >= 0)):
                here = at[go]
                at[go] = np.where(rows[go, self.feature[here]] <= self.split[here], self.left[here], self.right[here])
            total += self.depth[at]
        return 2.0 ** (-total / max(1, len(self.roots)) / self.expected)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _before(values: DataFrame) -> DataFrame:
    """(k, v, good, bad, before) for each different value `v` of `k`: rows that have it, and good rows of lesser ones.

    `values` has k, v and label. Values are sorted by ranges, so that no task sees all; what stands before a range is one
    number for each k.
    """
    counts = values.groupBy("k", "v").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    ranged = written(counts.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("k", "part").agg(F.sum("good").alias("held"))  # a row for each task of the sort, or two
    sums = sums.select("k", "part", (F.sum("held").over(Window.partitionBy("k").orderBy("part")) - F.col("held")).alias("earlier"))
    upto = F.sum("good").over(Window.partitionBy("k", "part").orderBy("v")) - F.col("good")
    return ranged.withColumn("upto", upto).join(F.broadcast(sums), ["k", "part"]).select("k", "v", "good", "bad", (F.col("earlier") + F.col("upto")).alias("before"))


def telling(rows: DataFrame, good: int, bad: int) -> list[int]:
    """The statistics in which a bad row has the greater value with a chance of LEAST_AREA or more, ties counted half; all if none."""
    both = _before(rows.select("label", F.posexplode("features").alias("k", "v")))
    twice = both.groupBy("k").agg(F.sum(F.col("bad") * (2 * F.col("before") + F.col("good"))).alias("n")).collect()  # a row for each statistic
    return sorted(r.k for r in twice if good and bad and r.n / 2 / good / bad >= LEAST_AREA) or list(range(len(FEATURES)))


def draw_samples(rows: DataFrame, good: int, bad: int, trees: int = TREES, size: int = SUBSAMPLE) -> list[np.ndarray]:
    """For each tree `size` rows, those with the least hash of id and tree, of all good rows and a share of the bad ones.

    Bad rows are let in by the hash of their id, about BAD_SHARE of the good ones in number. Only rows whose hash can be among the
    least come to the driver: at most `trees` times a little over `size`, whatever the input.
    """
    span = 1 << 40
    let_in = min(1.0, float(np.ceil(BAD_SHARE * good)) / max(1, bad))
    seen = rows.where((F.col("label") == 1) | (F.pmod(F.xxhash64("h"), F.lit(span)) < int(let_in * span)))
    share = min(1.0, (size + 8 * size**0.5) / max(1, good))
    drawn = seen.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("key", F.pmod(F.xxhash64("h", "tree"), F.lit(span))).where(F.col("key") < int(share * span))
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("key", "label", "features"))
    got: list[list[tuple]] = [[] for _ in range(trees)]
    for r in drawn.withColumn("nth", nth).where(F.col("nth") <= size).select("tree", "nth", "features").collect():  # trees * size rows
        got[r.tree].append((r.nth, r.features))
    return [np.array([f for _, f in sorted(g)], float).reshape(-1, len(FEATURES)) for g in got]


def _score(forest: IsolationForest, session) -> object:
    from pyspark.sql.functions import pandas_udf

    shared = session.sparkContext.broadcast(forest)

    @pandas_udf("double")
    def anomaly(features):
        return __import__("pandas").Series(shared.value.score(np.stack(features.to_numpy())) if len(features) else [], dtype=float)

    return anomaly("features")


def calibrated(rows: DataFrame, forest: IsolationForest, good: int, most_good_lost: float = MOST_GOOD_LOST) -> float:
    """The threshold with the most bad rows above it that puts at most that share of all good rows above it; 2 without good ones."""
    if not good:
        return 2.0
    scores = written(_before(rows.select("label", F.lit(0).alias("k"), _score(forest, rows.sparkSession).alias("v"))), "scores")
    place = int(np.ceil((good - 1) * (1 - most_good_lost)))
    threshold = float(np.nextafter(scores.where(F.col("before") + F.col("good") > place).agg(F.min("v")).first()[0], 2))
    worse = scores.where((F.col("bad") > 0) & (F.col("v") >= threshold)).agg(F.min("v")).first()[0]
    return threshold if worse is None else (threshold + worse) / 2  # in the middle of the gap, where there is one


def fit_stats(stats: DataFrame, labels: DataFrame, quality: str = "quality") -> IsolationForest:
    """A forest over all labelled rows of `with_stats` that pass the base rule, calibrated by all of their labels.

    Only statistics that tell bad rows from good ones (area under the curve of LEAST_AREA or more) are looked at. The
    trees see good rows and a few bad ones (BAD_SHARE of the good), for a statistic that no good row varies in
    could not be split on else, and too many bad rows would look normal to each other. A tree isolates SUBSAMPLE rows, as
    the method has it; areas and the threshold are exact counts over every labelled row. Rows without a 0 or 1 label take no
    part; with none at all the forest keeps everything. `stats` is read once.
    """
    known = labels.where(F.col(quality).isin(0, 1)).select("doc_id", F.col(quality).cast("int").alias("label"))
    rows = written(stats.where(~base_failed()).select("doc_id", "features").join(known, "doc_id").select("features", "label", F.xxhash64("doc_id").alias("h")), "labelled")
    count = rows.agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")).first()
    use = telling(rows, count.good, count.bad)
    forest = IsolationForest.fit([x[:, use] for x in draw_samples(rows, count.good, count.bad)])
    forest.use = use
    forest.threshold = calibrated(rows, forest, count.good)
    return forest


def fit_forest(docs: DataFrame, labels: DataFrame, quality: str = "quality", text: str = "text") -> IsolationForest:
    """`fit_stats` from texts: every labelled one is looked at."""
    return fit_stats(with_stats(docs, text), labels, quality)


def judge(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """Adds base_failed, anomaly (the forest's score) and kept to `stats`; drops features.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT percent of them inside repeated windows. kept: the
    base rule passed and the score is under the calibrated threshold. Empty and null texts fail the base rule.
    """
    return stats.withColumn("base_failed", base_failed()).withColumn("anomaly", _score(forest, stats.sparkSession)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(forest.threshold))).drop("features")
