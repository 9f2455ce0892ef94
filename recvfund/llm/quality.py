"""Quality rules: two fixed limits, then an isolation forest over rule statistics.

Each text's rule statistics (repetition, symbols, case, lines) are counted over the whole text. The forest is a set of
trees of random splits, each grown on a small random part of the good rows in a bounded sample of labelled rows, within
the box that the shares can span; a text that few splits set apart has short paths and a high anomaly score. The score's limit is calibrated on the same labelled
rows: the one that finds most of the rows labelled bad while losing no more than a stated share of those labelled good.

Edge cases: a null or empty text has no words and fails the fixed limit on length; without labelled rows, or without
bad ones among them, only the fixed limits decide; ties at the limit are kept; repeated rows and repeated labels
count once each in the sample; an empty table gives an empty result. Other columns are passed by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, text_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SPAN = 8  # words of a window whose repetition counts
#: The sample of labelled rows that the forest and its limit are fitted on.
MAX_LABELLED = 20_000
TREES, ROWS_A_TREE, MAX_DEPTH = 100, 256, 14
MAX_GOOD_LOST = 0.0005
SEED = 8
DRAW = 40.0  # words of plain prose added to each text's shares

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


def repeated_words(words: list[bytes], span: int = SPAN) -> int:
    """How many words stand in windows of ``span`` (a power of 2) words that occur twice or more, the first included.

    Windows are numbered by doubling: a window of 2k words is a pair of numbered windows of k. Exact, not hashed.
    """
    if len(words) <= span:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    width, top = 1, len(known)
    while width < span:
        values, ids, counts = np.unique(ids[:-width] * top + ids[width:], return_inverse=True, return_counts=True)
        width, top = 2 * width, len(values)
        if top == len(ids):
            return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[ids] > 1)
    edge[starts] += 1
    edge[starts + span] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_stats(text: str) -> tuple:
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at ASCII white space
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n_words, spaces = len(words), int(seen[_SPACES].sum())
    chars = len(text) - spaces
    symbols = int(seen[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper, digits = int(seen[65:91].sum()), int(seen[48:58].sum())
    stops = int(seen[[44, 46]].sum())
    other = int(seen[33:127].sum()) - upper - digits - stops - symbols - int(seen[97:123].sum())
    # shares, drawn towards what plain prose has so that a short text's chance rates do not look rare
    features = (
        symbols / (n_words + DRAW), other / (n_words + DRAW), (upper + 0.02 * 6 * DRAW) / (chars + 6 * DRAW), digits / (chars + 6 * DRAW),
        dup_lines / (len(lines) + 5), repeat / (n_words + DRAW), (len(set(words)) + DRAW) / (n_words + DRAW) ** 0.9, (stops + 0.1 * DRAW) / (n_words + DRAW),
    )
    return n_words, chars, symbols, dup_lines, repeat, [float(x) for x in features]


def _stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"])


def stats_of(text: Column) -> Column:
    """A struct of the rule statistics, one Arrow batch of texts at a time."""
    return F.pandas_udf(_stats, STATS)(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _unsuccessful(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n rows."""
    n = np.maximum(n, 1).astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: at node i, go to ``kids[i] + (x[feature[i]] >= split[i])``; leaves have feature -1 and their path's length."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    normal: float
    limit: float = float("inf")

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1."""
        total = np.zeros(len(x))
        for feature, split, kids, length in self.trees:
            at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(rows):
                rows = rows[feature[at[rows]] >= 0]
                node = at[rows]
                at[rows] = kids[node] + (x[rows, feature[node]] >= split[node])
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / self.normal) if self.trees else total


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> tuple:
    """One tree of random splits over the rows of ``x`` within the box ``low`` to ``high``.

    A split falls anywhere in its node's box, also where no row is, so a text outside of what ``x`` covers is set apart
    by the first split between them.
    """
    nodes: list[list] = [[-1, 0.0, 0, 0.0]]
    todo = [(0, x, low, high, 0)]
    while todo:
        i, part, low, high, depth = todo.pop()
        free = np.flatnonzero(high > low)
        if depth >= MAX_DEPTH or len(part) < 2 or not len(free):
            nodes[i][3] = depth + float(_unsuccessful(np.array(len(part))))
            continue
        f = int(rng.choice(free))
        cut = float(rng.uniform(low[f], high[f]))
        nodes[i][:3] = [f, cut, len(nodes)]
        up = part[:, f] >= cut
        below, above = high.copy(), low.copy()
        below[f] = above[f] = cut
        todo += [(len(nodes), part[~up], low, below, depth + 1), (len(nodes) + 1, part[up], above, high, depth + 1)]
        nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
    cols = list(zip(*nodes, strict=True))
    return np.array(cols[0], np.int64), np.array(cols[1]), np.array(cols[2], np.int64), np.array(cols[3])


def fit(x: np.ndarray, bad: np.ndarray, trees: int = TREES, rows: int = ROWS_A_TREE, max_good_lost: float = MAX_GOOD_LOST, seed: int = SEED) -> Forest:
    """A forest over the rows of ``x``, its limit calibrated with the labels ``bad``."""
    if not len(x) or bad.all() or not bad.any():
        return Forest([], 1.0)
    rng = np.random.default_rng(seed)
    plain = x[~bad]
    n = min(rows, len(plain))
    forest = Forest([grow(plain[rng.choice(len(plain), n, replace=False)], np.minimum(0, x.min(0)), np.maximum(1, x.max(0)), rng) for _ in range(trees)], float(_unsuccessful(np.array(max(n, 3)))))
    s = forest.scores(x)
    good = np.sort(s[~bad])
    least = good[min(len(good) - 1, int(np.ceil(len(good) * (1 - max_good_lost))))]  # no more than that share lies above
    limits = np.unique(s[s >= least])
    gain = [np.mean(s[bad] > t) - np.mean(good > t) for t in limits]
    limit = float(limits[int(np.argmax(gain))])
    above = s[bad & (s > limit)]  # halfway to the nearest bad row, as good texts beyond the sample may lie somewhat higher
    return Forest(forest.trees, forest.normal, (limit + float(above.min())) / 2 if len(above) else limit)


def _matrix(features: pd.Series) -> np.ndarray:
    return np.array(features.tolist(), float) if len(features) else np.zeros((0, 1))


def fit_forest(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Forest:
    """Fitted on up to ``max_labelled`` labelled documents, chosen by a hash of their ids: that many rows of statistics reach the driver."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    one = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = one.select("doc_id", "quality", stats_of(F.col("text")).alias("s")).filter(~base_failed(F.col("s"))).select("doc_id", "quality", "s.features").toPandas()
    rows = rows.sort_values("doc_id")
    x = _matrix(rows["features"])
    return fit(x, rows["quality"].to_numpy() == 0)


def judged(docs: DataFrame, forest: Forest, name: str) -> DataFrame:
    """``docs`` with a struct column ``name``: the statistics, ``base_failed``, ``anomaly`` and ``kept``.

    One function counts and scores a batch: two in a row would hold two Python processes a task, with the batch in both.
    """

    def judge(texts: pd.Series) -> pd.DataFrame:
        stats = _stats(texts)
        return stats.assign(anomaly=forest.scores(_matrix(stats["features"])))

    s = docs.withColumn(name, F.pandas_udf(judge, STATS + ", anomaly double")(text_of()))
    c = F.col(name)
    return s.withColumn(name, c.withField("base_failed", base_failed(c))).withColumn(
        name, c.withField("kept", ~c["base_failed"] & (c["anomaly"] <= F.lit(forest.limit)))
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly``."""
    out = judged(docs.select("doc_id", "text"), fit_forest(docs, labels), "q")
    return out.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")])


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    (name,) = free_names(docs.columns, "q")
    return judged(docs, fit_forest(docs, labels), name).filter(F.col(name)["kept"]).select(*docs.columns)
