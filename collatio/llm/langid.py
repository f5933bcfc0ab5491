"""Language identification: a linear-chain conditional random field labels the words of code-switched text by forward-backward."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_text_batches, table

#: Most labelled documents of a language that the field is trained on, its rounds, and words of a training sequence.
SAMPLE, ROUNDS, SEQUENCE, SEED = 250, 40, 64, 17
#: Most runs of half a sequence that one document gives, and the decay of the weights.
RUNS, DECAY = 64, 0.1
GRAMS, RARE = (1, 2, 3, 4), 2
CACHED_TYPES, WORDS_AT_ONCE = 300_000, 600_000
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """Affixes (runs at ^ or $), inner n-grams, and the word itself as the lexicon's entry."""
    w = f"^{word}$"
    out = [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)]
    if len(w) > max(GRAMS):
        out.append(w)
    return out


class Field:
    """Feature weights, transitions and a cache of word emissions."""

    class _Types(dict):
        def __init__(self, make):
            self.make = make

        def __missing__(self, word):
            at = self[word] = self.make(word)
            return at

    def __init__(self, langs: list[str], index: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.langs, self.index, self.weights, self.transitions = langs, index, weights, transitions
        self.types, self.rows = self._Types(self._type), 0
        self.table = np.empty((1024, len(langs)))

    def __reduce__(self):
        return Field, (self.langs, self.index, self.weights, self.transitions)

    def _type(self, word: str) -> int:
        if not any(c.isalpha() for c in word):
            return -1
        if self.rows >= len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        e = self.weights[[self.index[f] for f in features(word) if f in self.index]].sum(0)
        self.table[self.rows] = np.exp(e - e.max())
        self.rows += 1
        return self.rows - 1

    def emissions(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the row of each of its words' emissions (in self.table)."""
        if len(self.types) > CACHED_TYPES:
            self.types.clear()
            self.rows = 0
        out = []
        for t in texts:
            a = np.array(list(map(self.types.__getitem__, _LETTERS.findall(t.lower()))), np.int64)
            out.append(a if len(a) == 0 or a.min() >= 0 else a[a >= 0])
        return out

    def _groups(self, texts: list[str], sums: bool):
        """(numbers of texts, their lengths in words, result) of texts with words, the longest first, some at a time."""
        ids = self.emissions(texts)
        order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: -len(ids[i]))
        lo = 0
        while lo < len(order):
            hi, size = lo, 0
            while hi < len(order) and (hi == lo or size + len(ids[order[hi]]) <= WORDS_AT_ONCE):
                size += len(ids[order[hi]])
                hi += 1
            some = order[lo:hi]
            length = np.array([len(ids[i]) for i in some])
            yield some, length, forward_backward(self.table[np.concatenate([ids[i] for i in some])], length, np.exp(self.transitions), sums=sums)
            lo = hi

    def posteriors(self, texts: list[str]) -> list[np.ndarray]:
        """Words by languages, for each text."""
        out: list = [np.empty((0, len(self.langs)))] * len(texts)
        for some, length, p in self._groups(texts, False):
            for i, part in zip(some, np.split(p, np.cumsum(length)[:-1])):
                out[i] = part
        return out

    def means(self, texts: list[str]) -> list[np.ndarray | None]:
        """Each text's mean posterior over its words; None without words."""
        out: list = [None] * len(texts)
        for some, length, total in self._groups(texts, True):
            for i, mean in zip(some, total / length[:, None]):
                out[i] = mean
        return out


def forward_backward(e: np.ndarray, length: np.ndarray, trans: np.ndarray, pairs: np.ndarray | None = None, sums: bool = False) -> np.ndarray:
    """Marginals of sequences laid end to end, the longest first, or (``sums``) their sums by sequence; ``pairs`` gets the expected transitions added.

    Rows are laid out by place in the sequence, so that each step works on one slice over all sequences that are that long.
    """
    k, start = e.shape[1], np.cumsum(length) - length
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # sequences longer than t
    off = np.r_[0, np.cumsum(active)]
    source = start[np.arange(len(e)) - np.repeat(off[:-1], active)] + np.repeat(np.arange(length[0]), active)
    e, ones, back = e[source], np.ones((k, k)), np.ascontiguousarray(trans.T)
    alpha = np.empty_like(e)
    a = np.ones((len(length), k))
    for t in range(length[0]):
        lo, hi = off[t], off[t + 1]
        a = (a[: hi - lo] @ trans if t else a) * e[lo:hi]
        a /= a @ ones
        alpha[lo:hi] = a
    beta, total = np.ones((len(length), k)), np.zeros((len(length), k))
    for t in range(length[0] - 1, -1, -1):
        lo, hi = off[t], off[t + 1]
        n = hi - lo
        g = alpha[lo:hi] * beta[:n]
        g /= g @ ones
        if t:
            eb = e[lo:hi] * beta[:n]
            if pairs is not None:
                prev = alpha[off[t - 1] : off[t - 1] + n]
                pairs += trans * (prev.T @ (eb / (((prev @ trans) * eb) @ ones)))
            b = eb @ back
            b /= b @ ones
            beta[:n] = b
        if sums:
            total[:n] += g
        else:
            alpha[lo:hi] = g
    if sums:
        return total
    out = np.empty_like(alpha)
    out[source] = alpha
    return out


def trained(samples: list[tuple[str, str]], langs: list[str], seed: int = SEED, rounds: int = ROUNDS) -> Field:
    """The field that fits labelled texts. Sequences are cut from the texts and half of them go on in another language, so that switches have a price that is learned."""
    rng = np.random.default_rng(seed)
    label = {x: i for i, x in enumerate(langs)}
    vocabulary: dict[str, int] = {}
    runs = []
    for text, lang in samples:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in _LETTERS.findall(text.lower())]
        for lo in range(0, len(ids), SEQUENCE // 2):
            runs.append((np.array(ids[lo : lo + SEQUENCE // 2], np.int64), label[lang]))
    if not runs:
        return Field(langs, {}, np.zeros((1, len(langs))), np.zeros((len(langs), len(langs))))
    switch = rng.random(len(runs)) < 0.5
    other = rng.permutation(len(runs))
    ids, gold, lengths = [], [], []
    for i in range(0, len(runs) - 1, 2):
        j = other[i] if switch[i] else i + 1
        ids.append(np.r_[runs[i][0], runs[j][0]])
        gold.append(np.r_[np.full(len(runs[i][0]), runs[i][1]), np.full(len(runs[j][0]), runs[j][1])])
    if len(runs) % 2:
        ids.append(runs[-1][0])
        gold.append(np.full(len(runs[-1][0]), runs[-1][1]))
    order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
    ids, gold = [ids[i] for i in order], [gold[i] for i in order]
    lengths = np.array([len(x) for x in ids])
    flat, truth = np.concatenate(ids), np.concatenate(gold)
    per_type = [features(w) for w in vocabulary]
    seen: dict[str, int] = {}
    for fs in per_type:
        for f in fs:
            seen[f] = seen.get(f, 0) + 1
    index: dict[str, int] = {}
    for f, n in seen.items():
        if n >= RARE or len(f) > max(GRAMS):
            index[f] = len(index)
    column = np.array([index[f] for fs in per_type for f in fs if f in index], np.int64)
    row = np.repeat(np.arange(len(per_type)), [sum(f in index for f in fs) for fs in per_type])
    k, first = len(langs), np.cumsum(lengths) - lengths
    inner = np.ones(len(flat), bool)
    inner[first] = False
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    weights, trans = np.zeros((len(index), k)), np.zeros((k, k))
    squares_w, squares_t = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    wanted = np.zeros((len(per_type), k))
    np.add.at(wanted, (flat, truth), 1.0)
    for _ in range(rounds):
        grad_w, grad_t = gradient(weights, trans, flat, lengths, row, column, wanted, gold_pairs)
        squares_w += grad_w**2
        weights += 0.3 * grad_w / np.sqrt(squares_w)
        squares_t += grad_t**2
        trans += 0.3 * grad_t / np.sqrt(squares_t)
    return Field(langs, index, weights, trans)


def gradient(weights, trans, flat, lengths, row, column, wanted, gold_pairs, decay: float = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """Of the labelled sequences' log-likelihood, less ``decay`` / 2 times the squares: true counts less expected ones, for features and for transitions.

    ``flat`` are the words' types, sequence after sequence; type ``row[i]`` has feature ``column[i]``; ``wanted`` counts a type's true labels, ``gold_pairs`` true transitions.
    """
    k, n = trans.shape[0], len(wanted)
    emit = np.stack([np.bincount(row, weights[column, c], n) for c in range(k)], 1)
    emit = np.exp(emit - emit.max(1, keepdims=True))
    pairs = np.zeros((k, k))
    p = forward_backward(emit[flat], lengths, np.exp(trans), pairs)
    miss = wanted - np.stack([np.bincount(flat, p[:, c], n) for c in range(k)], 1)
    grad = np.stack([np.bincount(column, miss[row, c], len(weights)) for c in range(k)], 1)
    return grad - decay * weights, gold_pairs - pairs - decay * trans


def drawn(text: str, seed: int = SEED) -> str:
    """The text's words, or RUNS runs of SEQUENCE / 2 words from all over it if it has more, in order."""
    words, step = _LETTERS.findall(text.lower()), SEQUENCE // 2
    n = -(-len(words) // step)
    if n > RUNS:
        words = [w for k in sorted(np.random.default_rng(seed).choice(n - 1, RUNS, replace=False)) for w in words[k * step : (k + 1) * step]]
    return " ".join(words)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Trains on at most ``sample`` documents of each language that are not held out, the first by a seeded hash of the id; of a document at most RUNS runs of words, drawn by chance, come to the driver."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    h = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 12) / float(1 << 52)
    chance = F.lit(0.0)
    for x in langs:
        chance = F.when(F.col("lang") == x, min(1.0, 1.3 * sample / counts[x] + 1e-9)).otherwise(chance)

    def cut(batches):
        for b in batches:
            yield pd.DataFrame({"text": [drawn(t) for t in b.text], "lang": b.lang.array, "h": b.h.array})

    some = known.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), h.alias("h")).where(F.col("h") < chance)
    rows = some.mapInPandas(cut, "text string, lang string, h double").orderBy("h", "text").limit(2 * sample * len(langs)).collect()
    taken: dict[str, int] = {}
    samples = []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= sample:
            samples.append((r["text"], r["lang"]))
    return trained(samples, langs)


def identified(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row: the language with the largest mean posterior over all its words, and that mean.

    Null texts and texts without letters are ``und`` with score 0, as is all if nothing was learned. Texts are labelled whole; repeated rows alike; null ids are not held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # its size is bounded by the sample

    def label(batches):
        f = sent.value
        for b in batches:
            if f is None:
                yield pd.DataFrame({"doc_id": b.doc_id.array, "held_out": b.held_out.array, "lang_pred": UNKNOWN, "score": 0.0})
                continue
            pred, score = [], []
            for mean in f.means([t or "" for t in b.text]):
                pred.append(UNKNOWN if mean is None else f.langs[int(mean.argmax())])
                score.append(0.0 if mean is None else float(min(max(mean.max(), 0.0), 1.0)))
            yield pd.DataFrame({"doc_id": b.doc_id.array, "held_out": b.held_out.array, "lang_pred": pred, "score": score})

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return in_text_batches(own).mapInPandas(label, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def tagged(field: Field, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) for each word of one text."""
    words = [w for w in _LETTERS.findall(text.lower()) if any(c.isalpha() for c in w)]
    p = field.posteriors([text])[0]
    return [(w, field.langs[int(q.argmax())], float(q.max())) for w, q in zip(words, p)]


def identified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identified(docs, fitted(docs))
