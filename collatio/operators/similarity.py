"""Similarity providers: TF-IDF cosine over each pair's own paragraphs (default), or cosine of given vectors."""

from __future__ import annotations

import logging
import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD

#: Most rows and queries, about, that meet in a task of ``nearest``.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4_096
#: Python's ``\\b\\w\\w+\\b``, which matching uses on texts in a task.
TERM = WORD + "{2,}"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def tfidf_weights(parts: DataFrame) -> DataFrame:
    """(pair_id, side, idx, term, w) of paragraphs (pair_id, side, idx, text); the corpus is the pair's paragraphs of both sides.

    Weights are term counts times ln((1 + n) / (1 + df)) + 1, each paragraph scaled to length 1.
    """
    n = parts.groupBy("pair_id").agg(F.count("*").alias("n"))
    tf = parts.select("pair_id", "side", "idx", F.explode(terms(F.col("text"))).alias("term")).groupBy("pair_id", "side", "idx", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("pair_id", "term").agg(F.count("*").alias("df"))
    raw = tf.join(df, ["pair_id", "term"]).join(n, "pair_id").withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("pair_id", "side", "idx")))
    return raw.select("pair_id", "side", "idx", "term", (F.col("x") / norm).alias("w"))


def tfidf_similarity(parts: DataFrame) -> DataFrame:
    """(pair_id, o_idx, m_idx, sim) of paragraphs that share a term; all other pairs have similarity 0."""
    w = tfidf_weights(parts)
    o = w.where("side = 'o'").select("pair_id", F.col("idx").alias("o_idx"), "term", F.col("w").alias("ow"))
    m = w.where("side = 'm'").select("pair_id", F.col("idx").alias("m_idx"), "term", F.col("w").alias("mw"))
    sim = o.join(m, ["pair_id", "term"]).groupBy("pair_id", "o_idx", "m_idx").agg(F.sum(F.col("ow") * F.col("mw")).alias("sim"))
    return sim.withColumn("sim", F.least(F.greatest("sim", F.lit(0.0)), F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 if either has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def vector_similarity(parts: DataFrame) -> DataFrame:
    """As tfidf_similarity, from a column ``vector`` that a model has filled beforehand."""
    o = parts.where("side = 'o'").select("pair_id", F.col("idx").alias("o_idx"), F.col("vector").alias("ov"))
    m = parts.where("side = 'm'").select("pair_id", F.col("idx").alias("m_idx"), F.col("vector").alias("mv"))
    sim = o.join(m, "pair_id").select("pair_id", "o_idx", "m_idx", F.least(F.greatest(cosine(F.col("ov"), F.col("mv")), F.lit(0.0)), F.lit(1.0)).alias("sim"))
    return sim.where("sim > 0")  # null vectors have no row either


def _cosines(q: list, e: list) -> np.ndarray:
    """Cosines rounded to 6 digits; 0 if either vector is null or has length 0, NaN if their sizes differ."""
    size = lambda some: np.array([-1 if x is None else len(x) for x in some])
    nq, ne = size(q), size(e)
    out = np.where((nq[:, None] < 0) | (ne < 0), 0.0, np.nan)
    for n in set(nq[nq >= 0]) & set(ne[ne >= 0]):
        i, j = np.flatnonzero(nq == n), np.flatnonzero(ne == n)
        a, b = (np.array([some[k] for k in at], dtype=float).reshape(len(at), n) for some, at in ((q, i), (e, j)))
        length = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
        out[np.ix_(i, j)] = np.round(np.divide(a @ b.T, length, out=np.zeros((len(i), len(j))), where=length != 0), 6)
    return out


def nearest(queries: DataFrame, rows: DataFrame, k: int, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, vec_id, sim, rank) of the k rows (vec_id, embedding) of other ids nearest to each of queries (vec_id, embedding), ties by vec_id.

    Every block of queries meets every block of rows in a task, which keeps k rows a query; these are merged. Vectors of another size have a null similarity and rank last.
    """
    n_rows, n_queries = -(-rows.count() // block_rows) or 1, -(-queries.count() // block_queries) or 1
    numbered = lambda df, own, n: df.where(F.col(df.columns[0]).isNotNull()).withColumn(own, F.monotonically_increasing_id() % n)
    side = lambda df, own, n, other, m: numbered(df, own, n).select("*", F.explode(F.expr(f"sequence(0L, {m - 1}L)")).alias(other))
    cells = side(rows.select("vec_id", "embedding"), "r", n_rows, "q", n_queries).groupBy("r", "q")
    asked = side(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "q", n_queries, "r", n_rows).groupBy("r", "q")
    id_type, asked_type = dict(rows.dtypes)["vec_id"], dict(queries.dtypes)["vec_id"]

    def best(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if e.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "sim": []})
        e = e.sort_values("vec_id", kind="stable")
        ids, vectors, found = e.vec_id.to_numpy(), list(e.embedding), []
        for at in range(0, len(q), 256):
            some = q.iloc[at : at + 256]
            own = some.query_id.to_numpy()
            sims = _cosines(list(some.vector), vectors)
            key = np.where(own[:, None] == ids, 3.0, np.where(np.isnan(sims), 2.0, -sims))
            first = np.argsort(key, axis=1, kind="stable")[:, :k]
            i = np.repeat(np.arange(len(some)), first.shape[1])
            j = first.ravel()
            keep = key[i, j] < 3.0
            found.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "sim": sims[i, j]})[keep])
        return pd.concat(found)

    sims = cells.cogroup(asked).applyInPandas(best, f"query_id {asked_type}, vec_id {id_type}, sim double").withColumn("sim", F.nanvl("sim", F.lit(None).cast("double")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc_nulls_last(), "vec_id"))
    return sims.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


PROVIDERS = {"tfidf": tfidf_similarity, "vectors": vector_similarity}


def provider(parts: DataFrame, name: str | None = None):
    """(name, function): the one asked for (by SEMANTIC_PROVIDER if none is named); TF-IDF if it is unknown or lacks its column."""
    name = name or os.environ.get("SEMANTIC_PROVIDER", "tfidf")
    if name not in PROVIDERS or (name == "vectors" and "vector" not in parts.columns):
        logging.getLogger(__name__).warning("similarity provider %r is not available; TF-IDF is used", name)
        name = "tfidf"
    return name, PROVIDERS[name]
