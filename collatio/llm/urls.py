"""URL filter: host and path rules first, then gradient-boosted trees on lexical features, all as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_among, salted, sampled, table

#: (host and path, verdict); a rule's host is up to its first slash.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
SAMPLE, TREES, DEPTH, RATE, SUFFIXES, SEED = 2000, 24, 3, 0.3, 64, 5
#: Most rules that become one expression; more are joined with the urls' hosts and paths.
MOST_RULES = 500
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end; else both empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UP, _LOW), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equal ones the first by text), and its verdict; nulls where none does."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def rules_joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (__url, host, path, ..) with ``rule`` and ``__says`` as by rule_for, for any number of rules (rule, verdict): equality joins of the host's suffixes, then of the path's beginnings, of each different place once.

    Of a path only beginnings as long as a rule's of the same host are looked up. A rule that is given with both verdicts allows. Places that very many urls share are dealt over several tasks.
    """
    host = F.substring_index("rule", "/", 1)
    rules = rules.groupBy("rule").agg(F.min("verdict").alias("says")).select("rule", "says", host.alias("of"), F.substring(F.col("rule"), F.length(host) + 1, F.length("rule")).alias("begins"))
    lengths = rules.groupBy("of").agg(F.collect_set(F.length("begins")).alias("lengths"))
    places = urls.groupBy("host", "path").agg(F.count("*").alias("c"))
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    asked = places.select("host", "path", F.explode(suffixes).alias("of")).join(lengths, "of").select("host", "path", "of", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    fits = asked.select("host", "path", "of", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("begins")).join(rules, ["of", "begins"])
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "says")).alias("x")).select("host", "path", F.col("x.rule").alias("rule"), F.col("x.says").alias("__says"))
    every = places.join(best, ["host", "path"], "left").drop("c")
    return salted(urls, every, ["host", "path"], hot_among(places, "c", urls.count()), ["page_id", "__url"])


FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "host_length", "labels", "hyphens", "secure", "path_length", "extension")


def lexical(urls: DataFrame) -> DataFrame:
    """urls (with __url, host, path) and the features of FEATURES, and the host's last label as suffix."""
    url, n = F.col("__url"), F.greatest(F.length("__url"), F.lit(1))
    count = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what)))
    entropy = F.expr("aggregate(transform(array_distinct(split(__url, '')), c -> (length(__url) - length(replace(__url, c, ''))) / cast(greatest(length(__url), 1) AS double)), 0.0D, (a, p) -> a - if(p > 0, p * log2(p), 0.0D))")
    return urls.select(
        "*",
        F.length("__url").cast("double").alias("length"), count(F.col("path"), "/").cast("double").alias("depth"),
        ((F.length("__url") - F.length(F.translate(url, "0123456789", ""))) / n).alias("digit_ratio"), entropy.alias("entropy"),
        count(url, "=").cast("double").alias("parameters"), F.length("host").cast("double").alias("host_length"), (count(F.col("host"), ".") + 1).cast("double").alias("labels"),
        count(F.col("host"), "-").cast("double").alias("hyphens"), url.startswith("https:").cast("double").alias("secure"), F.length("path").cast("double").alias("path_length"),
        F.col("path").rlike(r"\.[A-Za-z]+$").cast("double").alias("extension"), F.substring_index("host", ".", -1).alias("suffix"),
    )


class BoostedTrees:
    """Logistic gradient boosting on a small matrix; trees are nested (feature, cut, left, right) or a leaf's value."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p), depth)
            self.trees.append(tree)
            margin += rate * self.value(tree, x)
        self.rate = rate

    def _grow(self, x, grad, hess, depth):
        leaf = float(grad.sum() / (hess.sum() + 1.0))
        best = (1e-6, None)
        if depth:
            whole = grad.sum() ** 2 / (hess.sum() + 1.0)
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
                cuts = np.flatnonzero(v[1:] > v[:-1])
                if len(cuts):
                    gain = g[cuts] ** 2 / (h[cuts] + 1) + (g[-1] - g[cuts]) ** 2 / (h[-1] - h[cuts] + 1) - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)))
        if best[1] is None:
            return leaf
        f, cut = best[1]
        go = x[:, f] < cut
        return f, cut, self._grow(x[go], grad[go], hess[go], depth - 1), self._grow(x[~go], grad[~go], hess[~go], depth - 1)

    def value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, left, right = tree
        return np.where(x[:, f] < cut, self.value(left, x), self.value(right, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum(self.value(t, x) for t in self.trees)

    def expression(self, columns: list[Column]) -> Column:
        def of(tree):
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, cut, left, right = tree
            return F.when(columns[f] < F.lit(cut), of(left)).otherwise(of(right))

        return F.lit(self.base) + F.lit(self.rate) * reduce(lambda a, b: a + b, [of(t) for t in self.trees])


def suffix_table(suffixes: list[str], y: np.ndarray) -> tuple[dict[str, tuple[float, float]], tuple[float, float]]:
    """Smoothed block rate and log count of the commonest suffixes of the labelled sample; and those of any other."""
    prior = float(y.mean())
    seen: dict[str, list] = {}
    for s, blocked in zip(suffixes, y):
        seen.setdefault(s, []).append(blocked)
    top = sorted(seen, key=lambda s: (-len(seen[s]), s))[:SUFFIXES]
    return {s: ((sum(seen[s]) + 5 * prior) / (len(seen[s]) + 5), float(np.log1p(len(seen[s])))) for s in top}, (prior, 0.0)


def _suffix_columns(stats, other) -> list[Column]:
    out = []
    for i in (0, 1):
        c = F
        for s, v in stats.items():
            c = c.when(F.col("suffix") == s, F.lit(v[i]))
        out.append(c.otherwise(F.lit(other[i])) if stats else F.lit(other[i]))
    return out


def judged_urls(pages: DataFrame, rules: tuple | list | DataFrame = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score (probability of block) of every page.

    ``rules`` are (rule, verdict) pairs or such a table, of any number. ``labelled`` has (url, verdict); without it the urls that a rule decides serve as labels. At most ``sample`` different urls of either verdict, the
    first by a seeded hash, come to the driver as features to train on; with one verdict only, no tree is grown and the
    method allows. Null urls and such without ``://`` have empty host and path and get the trees' verdict; repeated rows and
    null ids are kept; columns besides page_id and url are ignored.
    """
    def parts(df: DataFrame, *keep: str) -> DataFrame:
        df = df.select(*keep, F.coalesce(F.col("url").cast("string"), F.lit("")).alias("__url"))
        host, path = host_and_path(F.col("__url"))
        return df.select("*", host.alias("host"), path.alias("path"))

    own = parts(pages.select("page_id", "url"), "page_id")
    if not isinstance(rules, DataFrame) and len(rules) <= MOST_RULES:
        rule, says = rule_for(F.col("host"), F.col("path"), rules)
        own = own.select("*", rule.alias("rule"), says.alias("__says"))
    else:
        given = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "rule string, verdict string")
        own = rules_joined(own, given.select("rule", "verdict"))
    taught = own.select("__url", "host", "path", F.col("__says").alias("label")) if labelled is None else parts(labelled, "verdict").select("__url", "host", "path", F.col("verdict").alias("label"))
    rows = []
    for label in ("allow", "block"):
        some = sampled(taught.where(F.col("label") == label).dropDuplicates(["__url"]), sample, SEED, "__url")
        rows += lexical(some).select("suffix", "label", *FEATURES).collect()
    y = np.array([r["label"] == "block" for r in rows], dtype=float)
    scored = lexical(own)
    if len(set(y)) == 2:
        stats, other = suffix_table([r["suffix"] for r in rows], y)
        x = np.array([[*(r[f] for f in FEATURES), *stats.get(r["suffix"], other)] for r in rows])
        trees = BoostedTrees(x, y)
        scored = scored.select("*", *[c.alias(f"__t{i}") for i, c in enumerate(_suffix_columns(stats, other))])
        margin = trees.expression([F.col(c) for c in (*FEATURES, "__t0", "__t1")])
    else:
        margin = F.lit(-10.0)
    scored = scored.select("*", margin.alias("__m"))
    score = 1 / (1 + F.exp(-F.col("__m")))
    verdict = F.coalesce("__says", F.when(F.col("__m") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))


def judged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judged_urls(table(spark, sf_dir, "pages"))
