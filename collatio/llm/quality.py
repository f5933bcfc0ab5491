"""Quality rules: an isolation forest on rule statistics, its trees and its threshold from all labelled rows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD, in_text_batches, table, written

TREES, POINTS, SEED, LOSS = 100, 256, 11, 0.005
#: Levels of a tree whose rows are counted, and digits of its scores: bounds of what comes to the driver, however many rows there are.
LEVELS, DIGITS = 10, 4
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(WORD)
_SYMBOL_CODES = np.frombuffer(SYMBOLS.encode(), np.uint8)
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_LETTER = np.r_[65:91, 97:123, 192:256]
_PUNCT = np.r_[33:48, 58:65, 91:97, 123:127]


def rule_stats(text: str | None) -> tuple[list[int], list[float]]:
    """Base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the forest's features of a whole text."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    repeat = 0
    if len(counts) < len(grams):
        upto = 0  # words before it are counted
        for i, g in enumerate(grams):
            if counts[g] > 1:
                repeat += i + 3 - max(upto, i)
                upto = i + 3
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hist = np.bincount(data, minlength=256)
    chars, symbols = sum(map(len, words)), int(hist[_SYMBOL_CODES].sum())
    size = max(len(data), 1)
    features = [  # shares only: a text is not anomalous for its length
        chars / max(n, 1), symbols / max(n, 1), dup / max(lines, 1), repeat / max(n, 1),
        hist[_UPPER].sum() / max(hist[_LETTER].sum(), 1), hist[_PUNCT].sum() / size, hist[_DIGIT].sum() / size, hist[33] / max(n, 1),
    ]
    return [n, chars, symbols, dup, repeat], [float(x) for x in features]


class IsolationForest:
    """Trees of random splits over subsamples of points in memory; anomalies have short paths. Flat arrays: child -1 marks a leaf. Documents are judged by CountedForest.

    Splits are drawn from a node's box, which begins as ``box`` (lowest and highest values of each
    feature), not from the range of the points in it: a feature that never varies among the points still parts
    them from the rest of the box, and a document there ends in an empty leaf near the root.
    """

    def __init__(self, x: np.ndarray, box: tuple[np.ndarray, np.ndarray] | None = None, trees: int = TREES, points: int = POINTS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        low, high = box if box is not None else (x.min(0), x.max(0))
        self.points = min(points, len(x))
        self.depth_limit = 2 * int(np.ceil(np.log2(max(self.points, 2))))
        self.roots, self.rows = [], []
        for _ in range(trees):
            self.roots.append(self._grow(x[rng.choice(len(x), self.points, replace=False)], low.copy(), high.copy(), 0, rng))
        packed = np.array(self.rows)
        self.feature, self.left, self.right = (packed[:, i].astype(np.int32) for i in (0, 2, 3))
        self.cut, self.depth = packed[:, 1].copy(), packed[:, 4].copy()
        del self.rows

    @staticmethod
    def mean_path(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng) -> int:
        at = len(self.rows)
        open_ = np.flatnonzero(high > low)
        self.rows.append([0, 0.0, -1, -1, depth + self.mean_path(len(x))])
        if depth >= self.depth_limit or len(x) < 2 or not len(open_):
            return at
        f = int(rng.choice(open_))
        cut = float(rng.uniform(low[f], high[f]))
        go = x[:, f] < cut
        upper, lower = high.copy(), low.copy()
        upper[f] = lower[f] = cut
        left = self._grow(x[go], low, upper, depth + 1, rng)
        right = self._grow(x[~go], lower, high, depth + 1, rng)
        self.rows[at] = [f, cut, left, right, depth]
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for anomalies."""
        total = np.zeros(len(x))
        at_row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(self.depth_limit + 1):
                inner = self.left[node] >= 0
                if not inner.any():
                    break
                down = np.where(x[at_row, self.feature[node]] < self.cut[node], self.left[node], self.right[node])
                node = np.where(inner, down, node)
            total += self.depth[node]
        return 2.0 ** (-(total / len(self.roots)) / max(self.mean_path(self.points), 1e-9))


class CountedForest(IsolationForest):
    """The same forest of any number of rows: splits depend on the box alone, so a tree is drawn first and the rows that reach each of its leaves are counted afterwards, wherever they stand.

    Trees have ``levels`` levels, nodes of a tree the order of a heap. Scores have DIGITS digits, so that rows may be counted by score.
    """

    def __init__(self, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, levels: int = LEVELS, seed: int = SEED):
        rng, self.levels, self.points = np.random.default_rng(seed), levels, 0
        low, high = (np.tile(np.asarray(x, dtype=float), (trees, 1, 1)) for x in box)
        open_ = np.flatnonzero(high[0, 0] > low[0, 0])
        open_ = open_ if len(open_) else np.arange(low.shape[2])
        features, cuts = [], []
        for level in range(levels):
            f = open_[rng.integers(len(open_), size=(trees, 1 << level))][..., None]
            least, most = (np.take_along_axis(x, f, 2) for x in (low, high))
            cut = least + (most - least) * rng.random(f.shape)
            features.append(f[..., 0])
            cuts.append(cut[..., 0])
            low, high = np.repeat(low, 2, 1), np.repeat(high, 2, 1)
            left, right = high[:, ::2].copy(), low[:, 1::2].copy()
            np.put_along_axis(left, f, cut, 2)
            np.put_along_axis(right, f, cut, 2)
            high[:, ::2], low[:, 1::2] = left, right
        self.feature, self.cut = np.concatenate(features, 1).astype(np.int8), np.concatenate(cuts, 1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """For each tree the number of the leaf that each row reaches."""
        out, at_row = np.zeros((len(self.feature), len(x)), np.int32), np.arange(len(x))
        for node, feature, cut in zip(out, self.feature, self.cut):
            for _ in range(self.levels):
                node[:] = 2 * node + 1 + (x[at_row, feature[node]] >= cut[node])
        return out - ((1 << self.levels) - 1)

    def count(self, rows: np.ndarray) -> CountedForest:
        """Takes the rows of each leaf of each tree. A path ends at the first node of fewer than two rows, or at the leaf, and is longer by the mean path among the leaf's rows."""
        trees, n = rows.shape
        sizes = np.maximum(rows, 2).astype(float)
        rest = np.where(rows > 2, 2 * (np.log(sizes - 1) + 0.5772156649) - 2 * (sizes - 1) / sizes, (rows == 2) * 1.0)
        self.path = self.levels + rest
        for level in range(self.levels - 1, -1, -1):
            few = rows.reshape(trees, 1 << level, -1).sum(2) < 2
            self.path = np.where(np.repeat(few, n >> level, 1), level, self.path)
        self.points = int(rows[0].sum())
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        mean = np.take_along_axis(self.path, self.leaves(x), 1).mean(0) if len(x) else np.zeros(0)
        return np.round(2.0 ** (-mean / max(self.mean_path(self.points), 1e-9)), DIGITS)


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, x): the features of every document with a label of quality 0 or 1. Texts become features where they stand, and only these are joined."""

    def features(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.array, "x": [rule_stats(t)[1] for t in b.text]})

    texts = in_text_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL"))
    judged_by = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    return texts.mapInPandas(features, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>").join(judged_by, "doc_id").select(F.col("quality").cast("int").alias("quality"), "x")


def fitted(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> tuple[CountedForest | None, float]:
    """The forest and the score above which a document goes, from all labelled rows.

    The box of the trees is that of all of them, their leaves count all good ones; the threshold is the one that catches most bad rows
    while it drops at most ``loss`` of the good ones. Only numbers of rows by leaf and by score come to the driver. Without labels of both kinds nothing is dropped.
    """
    rows = written(labelled_features(docs, labels), "labelled")
    n = len(rule_stats(None)[1])
    ends = [f(F.col("x")[i]) for f in (F.min, F.max) for i in range(n)]
    first = rows.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0), *ends).first()
    n_good, n_bad = first[0], first[1]
    if n_good < 2 or not n_bad:
        return None, float("inf")
    forest = CountedForest((np.array(first[2 : 2 + n]), np.array(first[2 + n :])))
    shape = len(forest.feature), 1 << forest.levels

    def by_leaf(batches):
        found = np.zeros(shape, np.int64)
        for b in batches:
            for own, leaves in zip(found, forest.leaves(np.array(b.x.tolist()).reshape(-1, n))):
                own += np.bincount(leaves, minlength=shape[1])
        at = np.flatnonzero(found)
        yield pd.DataFrame({"leaf": at, "n": found.ravel()[at]})

    counts = rows.where("quality = 1").select("x").mapInPandas(by_leaf, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(shape, np.int64)
    found.ravel()[counts["leaf"].to_numpy()] = counts["n"].to_numpy()
    forest.count(found)

    def by_score(batches):
        for b in batches:
            yield pd.DataFrame({"quality": b.quality.array, "score": forest.score(np.array(b.x.tolist()).reshape(-1, n))})

    scored = rows.mapInPandas(by_score, "quality int, score double").groupBy("score").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).orderBy("score").toArrow()
    score, good, bad = (scored[c].to_numpy() for c in ("score", "good", "bad"))
    least = int(np.searchsorted(np.cumsum(good), np.ceil((1 - loss) * n_good)))  # so few good rows lie above
    worth = (n_bad - np.cumsum(bad)) / n_bad - (n_good - np.cumsum(good)) / n_good
    return forest, float(max(zip(worth[least:], score[least:]))[1])


def judged(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id of every document, the columns ``keep`` as k_0, k_1 and so on, and s_ counts, s_base_failed, s_score and s_kept.

    Null and empty texts have no words and fail the base; texts are taken whole; repeated rows are judged alike,
    row for row; null ids are kept as they are; an empty table gives no rows.
    """
    forest, threshold = fitted(docs, labels)
    keep = tuple(c for c in keep if c != "doc_id")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches):
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.iloc[lo : lo + 2000]
                stats = [rule_stats(t) for t in part.text]
                counts = np.array([s[0] for s in stats], dtype=np.int64).reshape(-1, 5)
                score = forest.score(np.array([s[1] for s in stats])) if forest is not None else np.zeros(len(part))
                failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
                out = {f"k_{i}": part[f"k_{i}"].array for i in range(len(keep))} | {"doc_id": part.doc_id.array}
                out |= {f"s_{c}": counts[:, i] for i, c in enumerate(names)}
                yield pd.DataFrame(out | {"s_base_failed": failed, "s_score": score, "s_kept": ~failed & (score <= threshold)})

    typed = dict(docs.dtypes)
    cols = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)])
    schema = "".join(f"k_{i} {typed[c]}, " for i, c in enumerate(keep)) + f"doc_id {typed['doc_id']}, " + "".join(f"s_{c} long, " for c in names) + "s_base_failed boolean, s_score double, s_kept boolean"
    return in_text_batches(cols).mapInPandas(judge, schema)


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.col(f"s_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")])
