"""Pairing of paragraphs: k-th occurrence with k-th occurrence, then greedily by similarity, then in document order."""

from __future__ import annotations

import bisect
import logging
import math
import os
import re
from collections import Counter, deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CLOSE, MAJOR, MATCH_TYPES, TIERS, confidence, rounded, tier
from ..functions.text import LINE_BREAK, paragraphs
from ..plans.scratch import written
from .alignment import SEGMENTS, diff_texts, word_diff
from .similarity import provider

#: Most paragraph combinations of a pair that is matched within a task.
LOCAL_CELLS = 4_000_000
#: Most edges of a pair that are matched greedily within a task.
LOCAL_EDGES = 1_000_000
#: About how many matches, with their texts and segments, a task holds at a time.
MATCHES_AT_ONCE = 5_000


def split_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, idx, text) of the paragraphs of pairs (pair_id, original, modified); side is o or m."""
    both = F.array(F.struct(F.lit("o").alias("side"), F.coalesce("original", F.lit("")).alias("text")), F.struct(F.lit("m").alias("side"), F.coalesce("modified", F.lit("")).alias("text")))
    sides = pairs.select("pair_id", F.explode(both).alias("s"))
    return sides.select("pair_id", "s.side", F.posexplode(paragraphs(F.col("s.text"))).alias("idx", "text"))


def occurrences(parts: DataFrame) -> DataFrame:
    """(pair_id, text, o, m): the rows of parts with a text, on either side, as structs in order of idx. What matches exactly and what is left both follow from it, with one shuffle."""
    row = F.struct("idx", *[c for c in parts.columns if c not in ("pair_id", "side", "text", "idx")])
    return parts.groupBy("pair_id", "text").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, row))).alias(s) for s in ("o", "m")])


def exact_matches(parts: DataFrame) -> DataFrame:
    """(pair_id, o_idx, m_idx, text): the k-th occurrence of a text on one side goes with the k-th on the other."""
    both = F.least(F.size("o"), F.size("m"))
    pairs = F.arrays_zip(F.slice("o.idx", F.lit(1), both).alias("o_idx"), F.slice("m.idx", F.lit(1), both).alias("m_idx"))
    return occurrences(parts.select("pair_id", "side", "idx", "text")).select("pair_id", "text", F.inline(pairs)).select("pair_id", "o_idx", "m_idx", "text")


def unmatched(parts: DataFrame) -> DataFrame:
    """The rows of parts that have no exact match: those whose occurrence number the other side does not reach."""
    both = F.least(F.size("o"), F.size("m"))
    left = [F.transform(F.slice(s, both + 1, F.size(s)), lambda r: F.struct(F.lit(s).alias("side"), r.alias("r"))) for s in ("o", "m")]  # noqa: B023
    rows = occurrences(parts).select("pair_id", "text", F.explode(F.concat(*left)).alias("x"))
    return rows.select("pair_id", "text", "x.side", "x.r.*").select(parts.columns)


def plain_matches(parts: DataFrame) -> DataFrame:
    """(pair_id, o_idx, m_idx, type): exact matches, and what is left as removed or added."""
    both, none = F.least(F.size("o"), F.size("m")), F.lit(None).cast(dict(parts.dtypes)["idx"])
    row = lambda o, m, kind: F.struct(o.alias("o_idx"), m.alias("m_idx"), F.lit(kind).alias("type"))
    exact = F.transform(F.arrays_zip(F.slice("o.idx", F.lit(1), both).alias("a"), F.slice("m.idx", F.lit(1), both).alias("b")), lambda x: row(x["a"], x["b"], "exact_match"))
    removed = F.transform(F.slice("o.idx", both + 1, F.size("o")), lambda x: row(x, none, "removed"))
    added = F.transform(F.slice("m.idx", both + 1, F.size("m")), lambda x: row(none, x, "added"))
    return occurrences(parts.select("pair_id", "side", "idx", "text")).select("pair_id", F.inline(F.concat(exact, removed, added)))


def _greedy(edges: pd.DataFrame) -> pd.DataFrame:
    edges = edges.sort_values(["sim", "o_idx", "m_idx"], ascending=[False, True, True], kind="stable")
    rows, cols, keep = set(), set(), []
    for o, m in zip(edges.o_idx, edges.m_idx):
        free = o not in rows and m not in cols
        keep.append(free)
        if free:
            rows.add(o)
            cols.add(m)
    return edges[keep]


def greedy_pairs(edges: DataFrame, floor: float = 0.0) -> DataFrame:
    """The rows of edges (pair_id, o_idx, m_idx, sim) that a greedy matching takes: highest similarity first, ties by o_idx, m_idx."""
    schema = edges.select("pair_id", "o_idx", "m_idx", "sim").schema
    edges = edges.where(F.col("sim") >= floor).select("pair_id", "o_idx", "m_idx", "sim")
    # Edges take few bytes and a pair's matching milliseconds, so that partitions must not be merged by size.
    edges = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair_id")
    return edges.groupBy("pair_id").applyInPandas(_greedy, schema)


def greedy_rounds(edges: DataFrame, floor: float = 0.0, most: int = LOCAL_EDGES) -> DataFrame:
    """The same matching for pairs of any size: pairs of at most ``most`` edges are matched within a task, of larger ones a round takes every edge that is best for its row and its column, until few enough are left."""
    left = written(edges.where(F.col("sim") >= floor).select("pair_id", "o_idx", "m_idx", "sim"), "edges")
    taken = None
    order = [F.col("sim").desc(), "o_idx", "m_idx"]
    while True:
        large = left.groupBy("pair_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("pair_id")
        large = written(large, "large")
        some = not large.isEmpty()
        small = greedy_pairs(left.join(large, "pair_id", "left_anti") if some else left)
        taken = small if taken is None else taken.unionByName(small)
        if not some:
            return taken
        left = left.join(large, "pair_id", "left_semi")
        best = left.withColumn("__r", F.row_number().over(Window.partitionBy("pair_id", "o_idx").orderBy(*order))).withColumn("__c", F.row_number().over(Window.partitionBy("pair_id", "m_idx").orderBy(*order)))
        now = written(best.where("__r = 1 AND __c = 1").drop("__r", "__c"), "taken")
        taken = taken.unionByName(now)
        left = left.join(now.select("pair_id", "o_idx"), ["pair_id", "o_idx"], "left_anti").join(now.select("pair_id", "m_idx"), ["pair_id", "m_idx"], "left_anti")
        left = written(left, "edges")


def _rest(parts: DataFrame, taken: DataFrame, side: str) -> DataFrame:
    idx = f"{side}_idx"
    own = parts.where(F.col("side") == side).select("pair_id", F.col("idx").alias(idx))
    return own.join(taken.select("pair_id", idx), ["pair_id", idx], "left_anti")


def match_paragraphs(parts: DataFrame, similarity: str | None = None) -> DataFrame:
    """(pair_id, o_idx, m_idx, type, sim, provider): exact matches, greedy matches in tiers, and what is left as removed or added.

    There is no floor: as long as both sides have paragraphs left they are paired, those without a common term in document order.
    """
    exact = exact_matches(parts)
    left = unmatched(parts)
    sides = left.groupBy("pair_id").agg(F.count_distinct("side").alias("n"))
    both = left.join(sides.where("n = 2").select("pair_id"), "pair_id")
    name, score = provider(parts, similarity)
    greedy = greedy_rounds(score(both))
    number = lambda idx: F.row_number().over(Window.partitionBy("pair_id").orderBy(idx))
    o, m = _rest(left, greedy, "o").withColumn("k", number("o_idx")), _rest(left, greedy, "m").withColumn("k", number("m_idx"))
    rest = o.join(m, ["pair_id", "k"], "full").select("pair_id", "o_idx", "m_idx", F.when(F.col("o_idx").isNotNull() & F.col("m_idx").isNotNull(), 0.0).alias("sim"))
    scored = greedy.unionByName(rest)
    kind = F.when(F.col("m_idx").isNull(), "removed").when(F.col("o_idx").isNull(), "added").otherwise(tier(F.col("sim")))
    scored = scored.join(sides, "pair_id").select("pair_id", "o_idx", "m_idx", kind.alias("type"), "sim", F.when(F.col("n") == 2, name).otherwise("n/a").alias("provider"))
    return exact.select("pair_id", "o_idx", "m_idx", F.lit("exact_match").alias("type"), F.lit(1.0).alias("sim"), F.lit("n/a").alias("provider")).unionByName(scored)


def document_order(matches: DataFrame) -> DataFrame:
    """matches with ``pos``: place in the original, added paragraphs between the matched neighbours of the modified side."""
    byt = Window.partitionBy("pair_id").orderBy("m_idx")
    before, after = byt.rowsBetween(Window.unboundedPreceding, -1), byt.rowsBetween(1, Window.unboundedFollowing)
    anchor = F.when(F.col("o_idx").isNotNull() & F.col("m_idx").isNotNull(), F.struct(F.col("m_idx").alias("m"), F.col("o_idx").alias("o")))
    on = matches.where(F.col("m_idx").isNotNull()).withColumn("__a", anchor)
    on = on.withColumn("__p", F.last("__a", ignorenulls=True).over(before)).withColumn("__n", F.first("__a", ignorenulls=True).over(after)).drop("__a")
    p, n, m = F.col("__p"), F.col("__n"), F.col("m_idx")
    between = p["o"] + ((m - p["m"]) / (n["m"] - p["m"])) * (n["o"] - p["o"])
    place = F.when(p.isNotNull() & n.isNotNull(), between).when(p.isNotNull(), p["o"] + 0.5 + 0.01 * (m - p["m"])).when(n.isNotNull(), n["o"] - 0.5 + 0.01 * (m - n["m"])).otherwise(m)
    est = F.when(F.col("o_idx").isNotNull(), F.col("o_idx").cast("double")).otherwise(place.cast("double"))
    off = matches.where(F.col("m_idx").isNull()).withColumn("__e", F.col("o_idx").cast("double"))
    placed = on.withColumn("__e", est).drop("__p", "__n").unionByName(off)
    key = Window.partitionBy("pair_id").orderBy("__e", F.coalesce("o_idx", F.lit(-1)), F.coalesce("m_idx", F.lit(-1)))
    return placed.withColumn("pos", F.row_number().over(key) - 1).drop("__e")


def relational_matches(pairs: DataFrame, similarity: str | None = None, segments: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """semantic_matches by joins and windows over exploded paragraphs: no pair has to fit a task."""
    parts = split_pairs(pairs)
    if vectors is not None:
        parts = parts.join(vectors.select("pair_id", "side", "idx", "vector"), ["pair_id", "side", "idx"], "left")
    parts = written(parts, "paragraphs")
    placed = document_order(match_paragraphs(parts, similarity))
    text = lambda side: parts.where(F.col("side") == side).select("pair_id", F.col("idx").alias(f"{side}_idx"), F.col("text").alias("original" if side == "o" else "modified"))
    out = placed.join(text("o"), ["pair_id", "o_idx"], "left").join(text("m"), ["pair_id", "m_idx"], "left")
    sure = F.col("type").isin("exact_match", "added", "removed")
    out = out.select(
        "pair_id", F.col("pos").cast("int").alias("pos"), "type", "original", "modified", "o_idx", "m_idx", "provider",
        F.when(F.col("type").isin("added", "removed"), F.lit(None)).otherwise(rounded(F.col("sim"), 4)).alias("similarity"), F.when(~sure, confidence(F.col("sim"))).alias("confidence"),
    )
    return out.withColumn("segments", word_diff(F.col("original"), F.col("modified"))["segments"]) if segments else out


_TERM = re.compile(r"\b\w\w+\b")
_BLANK = re.compile(r"\n\s*\n")
MATCH = "pos int, type string, original string, modified string, o_idx int, m_idx int, provider string, similarity double, confidence string"


def split_text(text: str | None) -> list[str]:
    blocks = [x for b in _BLANK.split(text or "") if (x := b.strip())]
    return blocks if len(blocks) > 1 else [x for b in (text or "").splitlines() if (x := b.strip())]


def _similar(left: list[str], right: list[str]) -> list[tuple[float, int, int]]:
    """(-similarity, i, j) of the pairs that share a term, by an index of the right side's terms."""
    counts = [Counter(_TERM.findall(t.lower())) for t in (*left, *right)]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    unit = []
    for c in counts:
        w = {t: n * idf[t] for t, n in c.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        unit.append({t: x / size for t, x in w.items()})
    where: dict[str, list[tuple[int, float]]] = {}
    for j, w in enumerate(unit[len(left) :]):
        for t, x in w.items():
            where.setdefault(t, []).append((j, x))
    out = []
    for i, w in enumerate(unit[: len(left)]):
        row: dict[int, float] = {}
        for t, x in w.items():
            for j, y in where.get(t, ()):
                row[j] = row.get(j, 0.0) + x * y
        out += [(-min(s, 1.0), i, j) for j, s in row.items()]
    return out


def match_texts(original: str | None, modified: str | None) -> list[dict]:
    """The matches of one pair in document order; see match_paragraphs and document_order for what they are."""
    o, m = split_text(original), split_text(modified)
    places: dict[str, deque] = {}
    for j, t in enumerate(m):
        places.setdefault(t, deque()).append(j)
    rows, left = [], []
    for i, t in enumerate(o):
        if places.get(t):
            rows.append((i, places[t].popleft(), "exact_match", 1.0))
        else:
            left.append(i)
    right = sorted(j for js in places.values() for j in js)
    both = bool(left and right)
    if both:
        free_o, free_m = set(left), set(right)
        for s, a, b in sorted(_similar([o[i] for i in left], [m[j] for j in right])):
            if left[a] in free_o and right[b] in free_m:
                rows.append((left[a], right[b], None, -s))
                free_o.remove(left[a])
                free_m.remove(right[b])
        rest_o, rest_m = sorted(free_o), sorted(free_m)
        rows += [(i, j, None, 0.0) for i, j in zip(rest_o, rest_m)]
        left, right = rest_o[len(rest_m) :], rest_m[len(rest_o) :]
    anchors = sorted((j, i) for i, j, _, _ in rows)
    rows += [(i, None, "removed", None) for i in left] + [(None, j, "added", None) for j in right]

    def place(row):
        i, j = row[:2]
        if i is not None:
            return float(i), i, -1 if j is None else j
        k = bisect.bisect(anchors, (j, -1))
        before, after = anchors[k - 1] if k else None, anchors[k] if k < len(anchors) else None
        if before and after:
            return before[1] + ((j - before[0]) / (after[0] - before[0])) * (after[1] - before[1]), -1, j
        if before:
            return before[1] + 0.5 + 0.01 * (j - before[0]), -1, j
        return (after[1] - 0.5 + 0.01 * (j - after[0]) if after else float(j)), -1, j

    out = []
    for pos, (i, j, kind, s) in enumerate(sorted(rows, key=place)):
        scored = kind is None
        if scored:
            kind = next((t for t, least in TIERS if s >= least), MAJOR)
        sure = "low" if scored and min(abs(s - least) for _, least in TIERS) <= CLOSE else "high" if scored else None
        out.append({
            "pos": pos, "type": kind, "original": None if i is None else o[i], "modified": None if j is None else m[j], "o_idx": i, "m_idx": j,
            "provider": "tfidf" if both and kind != "exact_match" else "n/a", "similarity": None if s is None else round(s, 4), "confidence": sure,
        })
    return out


def semantic_matches(pairs: DataFrame, similarity: str | None = None, segments: bool = True, errors: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """One row a match, in ``pos`` order: type, texts, similarity (4 digits), confidence (null where it is certain) and word segments.

    Pairs are matched where they stand, without a shuffle. Pairs of more than LOCAL_CELLS paragraph combinations, and all pairs if another
    provider than TF-IDF is asked for, go through relational_matches. The provider ``vectors`` takes the cosine of ``vectors`` (pair_id, side, idx, vector), which a
    model has filled for the paragraphs of split_pairs; a paragraph without one is like no other. With ``errors`` a pair that breaks off gives one row of null type.
    """
    if (similarity or os.environ.get("SEMANTIC_PROVIDER", "tfidf")) != "tfidf":
        return relational_matches(pairs, similarity, segments, vectors)
    pairs = pairs.select("pair_id", "original", "modified")
    breaks = lambda c: F.length(F.coalesce(c, F.lit(""))) - F.length(F.regexp_replace(F.coalesce(c, F.lit("")), LINE_BREAK, "")) + 1
    large = breaks("original").cast("long") * breaks("modified") > LOCAL_CELLS

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["pair_id", *(c.split()[0] for c in MATCH.split(", ")), *["segments"] * segments])
        return out.astype({"pos": "Int32", "o_idx": "Int32", "m_idx": "Int32"})

    def run(batches):
        for b in batches:
            rows = []
            for pair, original, modified in zip(b.pair_id, b.original, b.modified):
                try:
                    found = match_texts(original, modified)
                    for r in found:
                        r["pair_id"] = pair
                        if segments:
                            r["segments"] = diff_texts(r["original"], r["modified"])["segments"]
                except Exception:
                    if not errors:
                        raise
                    logging.getLogger(__name__).warning("no matches of pair %s", pair, exc_info=True)
                    found = [{"pair_id": pair, "type": None}]
                rows += found
                if len(rows) >= MATCHES_AT_ONCE:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    schema = f"pair_id {dict(pairs.dtypes)['pair_id']}, {MATCH}" + f", segments {SEGMENTS}" * segments
    local = pairs.where(~large).mapInPandas(run, schema)
    if not pairs.agg(F.max(large).alias("any")).first()["any"]:
        return local
    return local.unionByName(relational_matches(pairs.where(large), similarity, segments))


def match_stats(matches: DataFrame) -> DataFrame:
    """(pair_id, one count for each match type)."""
    return matches.groupBy("pair_id").agg(*[F.count_if(F.col("type") == t).alias(t) for t in MATCH_TYPES])
