"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics, long spans removed."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, _POWERS, gram_hashes, hot_among, in_text_batches, mixed, row_ids, salted, table, word_hashes, written

LENGTH, GRAM = 35, 8
#: Words of one shard's automaton, and most different contexts of one anchor that go to a shard as they are.
SHARD_WORDS, SPLIT_CONTEXTS = 60_000, 1_000
#: How many of a window's smallest hashes make the finer anchors of contexts that an anchor has too many of; at last the whole window does.
FINER = (2, 5)
#: Most rows, of some 20 bytes each, that are broadcast.
BROADCAST_KEYS = 500_000
#: Most words of a reference whose automata are broadcast; a larger one meets the documents in a shuffle.
REFERENCE_WORDS = 2_000_000


class SuffixAutomaton:
    """Of several sequences; ``count`` holds how often a state's strings occur, by the sequences' weights."""

    def __init__(self):
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]

    def _clone(self, p: int, c, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence, weight: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
            else:
                new = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                count.append(0)
                link.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = new
            count[last] += weight

    def finish(self) -> SuffixAutomaton:
        """Adds counts up the suffix links; to be called once, after the last sequence."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]
        return self

    def statistics(self, sequence, least: int = 1):
        """For each place of the sequence, the longest run that ends there and occurs at least ``least`` times."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        v = n = 0
        for c in sequence:
            while True:
                t = nxt[v].get(c)
                if t is not None and count[t] >= least:
                    v, n = t, n + 1
                    break
                if v == 0:
                    n = 0
                    break
                v = link[v]
                n = length[v]
            yield n


# ---- the corpus as its own reference ------------------------------------------------------------------


def anchors(words: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, first window, windows, context hash) of the runs of windows with the same anchor.

    A window's anchor is its leftmost smallest run of ``gram`` words, so equal windows have equal anchors
    at equal places, wherever they stand; every window belongs to one run. A run's context is the words that its windows cover.
    """
    n = len(words) - length + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 4
    h = gram_hashes(words, gram)
    span = length - gram + 1
    at, have = np.arange(len(h)), 1
    while have < span:
        step = min(have, span - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        have += step
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, n])
    return h[at[first]].view(np.int64), first, count, _digests(words, first, count)


def _digests(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of the words under runs of windows."""
    up, down = _POWERS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[first + count + LENGTH - 1] - sums[first]) * down[first] ^ (count.astype(np.uint64) << np.uint64(50))).view(np.int64)


def finer_anchors(words: np.ndarray, level: int):
    """(anchor hash, first window, windows, context hash) as by ``anchors``, of more anchors: the FINER[level] smallest hashes of a window, or all in order beyond that."""
    h = gram_hashes(words, GRAM)
    rows = np.lib.stride_tricks.sliding_window_view(h, LENGTH - GRAM + 1)
    rows = np.sort(rows, axis=1)[:, : FINER[level]] if level < len(FINER) else rows
    key = np.full(len(rows), level + 1, np.uint64)
    for column in rows.T:
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + column)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(rows)])
    return key[first].view(np.int64), first, count, _digests(words, first, count)


def _shards(batches):
    """Whole anchors, about SHARD_WORDS words at a time, from batches sorted by anchor."""
    held, size = [], 0
    for b in batches:
        if not len(b):
            continue
        if size >= SHARD_WORDS and held:
            key = held[-1].key.iloc[-1]
            cut = int(np.searchsorted((b.key.to_numpy() != key).astype(int), 1)) if (b.key == key).any() else 0
            held.append(b.iloc[:cut])
            yield pd.concat(held)
            held, size, b = [], 0, b.iloc[cut:]
            if not len(b):
                continue
        words = (b.nw + LENGTH - 1).to_numpy().cumsum()
        keys, lo = b.key.to_numpy(), 0
        ends = np.flatnonzero(np.r_[keys[1:] != keys[:-1], False]) + 1  # places where another anchor begins
        for e in ends:
            if size + words[e - 1] - (words[lo - 1] if lo else 0) >= SHARD_WORDS:
                yield pd.concat([*held, b.iloc[lo:e]])
                held, size, lo = [], 0, e
        held.append(b.iloc[lo:])
        size += int(words[-1] - (words[lo - 1] if lo else 0))
    if held:
        yield pd.concat(held)


def _matched(least: int):
    """A function to (key, digest, mask): which windows of a context that itself occurs less than ``least`` times occur so often, by a suffix automaton of each shard with the contexts of such contexts' anchors."""

    def match(batches):
        for shard in _shards(batches):
            n, key = shard.n.to_numpy(), shard.key.to_numpy()
            used = np.flatnonzero(np.isin(key, np.unique(key[n < least]))).tolist()
            ids: dict[str, int] = {}
            contexts = [[ids.setdefault(w, len(ids)) for w in shard.words.iloc[i].split(" ")] for i in used]
            auto = SuffixAutomaton()
            for i, c in zip(used, contexts):
                auto.add(c, int(n[i]))
            auto.finish()
            seldom, masks = [], []
            for i, c in zip(used, contexts):
                if n[i] < least:
                    mask = 0
                    for e, long in enumerate(auto.statistics(c, least)):
                        if long >= LENGTH:
                            mask |= 1 << (e - LENGTH + 1)
                    seldom.append(i)
                    masks.append(mask)
            some = shard.iloc[seldom]
            yield pd.DataFrame({"key": some.key.array, "digest": some.digest.array, "mask": masks})

    return match


def _few(batches, n: int):
    """Parts of at most ``n`` rows, so that what is made of them stays small."""
    for b in batches:
        for lo in range(0, len(b), n):
            yield b.iloc[lo : lo + n]


def _contexts(batches):
    """The words of the contexts that a text carries for all."""
    for b in _few(batches, 250):
        rows: dict[str, list] = {k: [] for k in ("key", "digest", "n", "nw", "words")}
        for text, spans in zip(b.text, b.spans):
            words = text_words(text)
            for s in spans:
                for k, v in zip(rows, (s["key"], s["digest"], s["n"], s["nw"], " ".join(words[s["lo"] : s["lo"] + s["nw"] + LENGTH - 1]))):
                    rows[k].append(v)
        yield pd.DataFrame(rows)


def _split(level: int):
    """A function that cuts contexts into those of finer anchors: (key, digest, off, finer, part, n, nw, words), off being the first window's place in the context."""

    def cut(batches):
        for b in _few(batches, 500):
            rows: dict[str, list] = {k: [] for k in ("key", "digest", "off", "finer", "part", "n", "nw", "words")}
            for key, digest, n, text in zip(b.key, b.digest, b.n, b.words):
                words = text.split(" ")
                for finer, first, count, part in zip(*(x.tolist() for x in finer_anchors(word_hashes(text)[3], level))):
                    for k, v in zip(rows, (key, digest, first, finer, part, n, count, " ".join(words[first : first + count + LENGTH - 1]))):
                        rows[k].append(v)
            yield pd.DataFrame(rows)

    return cut


def text_words(text: str | None) -> list[str]:
    data, starts, ends, _ = word_hashes(text or "")
    raw = data.tobytes()
    return [raw[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts, ends)]


def _often(contexts: DataFrame, least: int) -> DataFrame:
    """(key, digest, mask) of the contexts that occur ``least`` times themselves, so that all their windows do."""
    return contexts.where(F.col("n") >= least).select("key", "digest", F.expr("shiftleft(1L, nw) - 1").alias("mask"))


def _seldom(contexts: DataFrame, keys: DataFrame, least: int, level: int = 0) -> DataFrame:
    """(key, digest, mask) of those different contexts (key, digest, n, nw, words) that occur less than ``least`` times, but have windows that do not; ``keys`` has the contexts' keys.

    All contexts of an anchor meet in a shard. Where there are more than SPLIT_CONTEXTS, they are cut at finer anchors first; equal parts are
    counted as one context, and what is found of them goes back to the contexts that they were cut from. At the last level a part is one window, so an anchor
    has one context and the cutting ends.
    """
    wide = written(keys.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > SPLIT_CONTEXTS).select("key"), "wide")
    n_wide = wide.count()
    narrow = contexts
    if n_wide:
        wide = F.broadcast(wide) if n_wide <= BROADCAST_KEYS else wide
        narrow = contexts.join(wide, "key", "left_anti")
    masks = narrow.repartition("key").sortWithinPartitions("key").mapInPandas(_matched(least), "key long, digest long, mask long").where("mask != 0")
    if not n_wide:
        return masks
    parts = written(contexts.join(wide, "key", "left_semi").mapInPandas(_split(level), "key long, digest long, off int, finer long, part long, n long, nw int, words string"), "parts")
    finer = parts.groupBy(F.col("finer").alias("key"), F.col("part").alias("digest")).agg(F.sum("n").alias("n"), F.first("nw").alias("nw"), F.first("words").alias("words"))
    finer = written(finer, "finer")
    again = written(_seldom(finer, finer, least, level + 1).unionByName(_often(finer, least)), "masks")
    again = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    back = parts.where(F.col("n") < least).select("key", "digest", "off", "finer", "part").join(again.toDF("finer", "part", "mask"), ["finer", "part"])
    return masks.unionByName(back.groupBy("key", "digest").agg(F.bit_or(F.expr("shiftleft(mask, off)")).alias("mask")))


def flagged(own: DataFrame, least: int = 2) -> DataFrame:
    """(ROW, spans) of the rows (ROW, text, weight) with windows that occur ``least`` times, by the rows' weights: spans are (lo, mask), bit i for the window at word lo + i."""

    def scan(batches):
        for b in batches:
            for lo in range(0, len(b), 500):
                few = b.iloc[lo : lo + 500]
                parts = [anchors(word_hashes(t or "")[3]) for t in few.text]
                size = [len(p[0]) for p in parts]
                key, first, count, digest = (np.concatenate([p[i] for p in parts]) for i in range(4))
                ids = {c: np.repeat(few[c].to_numpy(), size) for c in (*ROW, "weight")}
                yield pd.DataFrame(ids | {"key": key, "digest": digest, "lo": first.astype(np.int32), "nw": count.astype(np.int32)})

    runs = written(in_text_batches(own).select(*ROW, "weight", "text").mapInPandas(scan, "rid long, rid2 long, weight int, key long, digest long, lo int, nw int"), "runs")
    counts = runs.groupBy("key").agg(F.count("*").alias("c"), F.sum("weight").alias("w")).where((F.col("c") > 1) & (F.col("w") >= least))
    counts = written(counts, "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    runs = written(salted(runs, counts.select("key"), ["key"], hot_among(counts, "c", total), ["rid", "lo"]), "repeated")
    distinct = runs.groupBy("key", "digest").agg(F.sum("weight").alias("n"), F.count("*").alias("c"), F.min(F.struct(*ROW, "lo", "nw")).alias("at"))
    distinct = written(distinct.select("key", "digest", "n", "c", "at.*"), "distinct")
    # Anchors whose contexts all occur often enough need no automaton, and none of their words.
    anchors_ = distinct.groupBy("key").agg(F.min("n").alias("low"), F.count("*").alias("m")).where(F.col("low") < least)
    anchors_ = written(anchors_, "anchors")
    some = written(salted(distinct, anchors_.select("key"), ["key"], hot_among(anchors_, "m", total), ["digest"]).select("key", "digest", "n", *ROW, "lo", "nw"), "some")
    carriers = some.groupBy(*ROW).agg(F.collect_list(F.struct("key", "digest", "n", "lo", "nw")).alias("spans"))
    contexts = own.join(carriers, ROW).select(*own.columns, "spans").mapInPandas(_contexts, "key long, digest long, n long, nw int, words string")
    contexts = written(contexts, "contexts")  # whether or not an anchor has to be split, so that the work is alike at every size
    masks = _seldom(contexts, some, least).unionByName(_often(distinct, least))
    found = salted(runs.select(*ROW, "key", "digest", "lo"), masks, ["key", "digest"], hot_among(distinct, "c", total), ["rid", "lo"])
    return found.groupBy(*ROW).agg(F.collect_set(F.struct("lo", "mask")).alias("spans"))


def _uncovered(n: int, spans) -> np.ndarray:
    """Which of n words lie under no window of the spans."""
    cover = np.zeros(n + 1, np.int32)
    for s in spans if spans is not None else ():
        lo, mask = s["lo"], s["mask"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            cover[lo + low] += 1
            cover[lo + low + LENGTH] -= 1
            mask &= mask - 1
    return np.cumsum(cover)[:n] == 0


def deduplicated(docs: DataFrame, keep: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """doc_id, the columns ``keep`` as k_0, k_1 and so on, n_words, n_removed and kept_sha256 of every row, and with ``texts`` what is left as ``kept``.

    A window is 35 consecutive words of one row. Every word under a window that stands anywhere else too, in the same
    text or in another row, goes; repeated rows of at least 35 words lose all. Null and empty texts have no words; ids are not looked at;
    ``kept`` is the text without the removed words and the blanks after them; extra columns pass through.

    The reference of a document is the rest of the corpus, which no broadcast holds, so its automata come in shards that
    meet the documents' parts in a shuffle. Windows fall to anchors (the smallest hash of eight words in them), equal windows to equal anchors. Anchors
    seen once are dropped; different contexts of the others are counted. Those that occur twice go as they are; for the others each shard holds all contexts of some anchors in
    a suffix automaton, through which they are streamed for the longest run that occurs twice. The automata compare words, so hashes
    only route. An anchor with more than SPLIT_CONTEXTS different contexts is split at finer anchors (see _seldom); rows of anchors
    and contexts that very many places share are joined over several tasks.
    """
    keep = tuple(c for c in keep if c not in ("doc_id", "text"))
    kinds = dict(docs.dtypes)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)])
    own = own.select("*", *row_ids(), F.lit(1).alias("weight"))

    def remove(batches):
        for b in _few(batches, 500):
            rows: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept")}
            for text, spans in zip(b.text, b.spans):
                data, starts, ends, _ = word_hashes(text or "")
                raw, n = data.tobytes(), len(starts)
                stay = _uncovered(n, spans)
                rows["n_words"].append(n)
                rows["n_removed"].append(int(n - stay.sum()))
                rows["kept_sha256"].append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(starts[stay], ends[stay])])).hexdigest())
                if texts and not stay.all():
                    upto = np.r_[starts[1:], len(raw)]
                    out = raw[: starts[0]] + b"".join([raw[s:e] for s, e in zip(starts[stay], upto[stay])])
                    rows["kept"].append(out.decode("utf-8", "surrogatepass"))
                else:
                    rows["kept"].append(text if texts else None)
            out = {"doc_id": b.doc_id.array} | {f"k_{i}": b[f"k_{i}"].array for i in range(len(keep))} | rows
            yield pd.DataFrame(out)

    marked = own.join(flagged(own), ROW, "left")
    schema = f"doc_id {kinds['doc_id']}, " + "".join(f"k_{i} {kinds[c]}, " for i, c in enumerate(keep)) + "n_words long, n_removed long, kept_sha256 string, kept string"
    return marked.select(*own.columns, "spans").mapInPandas(remove, schema)


def deduplicated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


DEDUPLICATED_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win SEMI JOIN again USING (s)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM hit)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS k FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


# ---- another reference --------------------------------------------------------------------------------


def without_reference(docs: DataFrame, reference: DataFrame, most: int = REFERENCE_WORDS) -> DataFrame:
    """doc_id and text of docs without the spans of at least 35 words that also stand in a text of ``reference``; texts that lose words are joined by blanks.

    A reference of at most ``most`` words is cut into shards, whose automata are broadcast and through which every document is streamed. A larger one
    meets the documents in a shuffle, as ``flagged`` does with the rest of a corpus: its rows weigh one, the documents nothing, and windows of weight one
    go. Null texts stay null; a null or empty reference text has no words.
    """
    kind = dict(docs.dtypes)["doc_id"]
    out = f"doc_id {kind}, text string"
    joined = lambda words, stay: " ".join([w for w, k in zip(words, stay) if k])
    size = reference.select(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"))).alias("n")).first().n or 0
    if size > most:
        own = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", "text", *row_ids(), F.lit(0).alias("weight"))
        other = reference.select(F.lit(None).cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", *row_ids(), F.lit(1).alias("weight"))

        def remove(batches):
            for b in _few(batches, 500):
                words = [text_words(t) for t in b.text]
                left = [_uncovered(len(w), s) for w, s in zip(words, b.spans)]
                yield pd.DataFrame({"doc_id": b.doc_id.array, "text": [t if t is None or k.all() else joined(w, k) for t, w, k in zip(b.text, words, left)]})

        return own.join(flagged(own.unionByName(other), 1), ROW, "left").select("doc_id", "text", "spans").mapInPandas(remove, out)
    shards, auto, held = [], SuffixAutomaton(), 0
    for row in reference.select("text").collect():
        words = text_words(row.text)
        auto.add(words)
        held += len(words)
        if held >= SHARD_WORDS:
            shards, auto, held = [*shards, auto.finish()], SuffixAutomaton(), 0
    shards.append(auto.finish())
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    def stream(batches):
        for b in batches:
            texts = []
            for text in b.text:
                words = text_words(text)
                gone = np.zeros(len(words) + 1, np.int32)
                for a in sent.value:
                    for e, n in enumerate(a.statistics(words)):
                        if n >= LENGTH:
                            gone[e - n + 1] += 1
                            gone[e + 1] -= 1
                left = np.cumsum(gone)[: len(words)] == 0
                texts.append(text if text is None or left.all() else joined(words, left))
            yield pd.DataFrame({"doc_id": b.doc_id.array, "text": texts})

    return docs.select("doc_id", "text").mapInPandas(stream, out)
