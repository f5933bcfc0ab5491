"""N-gram Jaccard join: banded MinHash candidates, Bayesian pruning by incremental comparison, exact verification."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, gram_hashes, hot_among, in_text_batches, mixed, row_ids, salted, table, word_hashes, written
from .graph import components

WORDS, THRESHOLD = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
STEP, TOLERANCE = 16, 1e-6
#: Most texts, and about the most shingles, of one component side by side in one task; larger components are compared block by block.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: Components of more blocks are compared bucket by bucket of their bands, so that only texts that agree in a band meet.
MOST_BLOCKS = 16
_RNG = np.random.default_rng(71)
_SEEDS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; a shorter text is one shingle, a text without words has none."""
    words = word_hashes(text)[3]
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else np.empty(0, np.uint64)


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.md5(s.tobytes()).digest() if len(s) else None


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, BANDS * ROWS for each set; none of the sets is empty."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= 60_000):
            size += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.r_[0, np.cumsum([len(s) for s in sets[lo : hi - 1]])].astype(np.int64)
        buffer = np.empty_like(flat)
        for i in range(BANDS * ROWS):
            np.bitwise_xor(flat, _SEEDS[i], out=buffer)
            np.multiply(buffer, _FACTORS[i], out=buffer)
            out[lo:hi, i] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
        lo = hi
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    key = np.repeat(key, len(sig), 0)
    for r in range(ROWS):
        key = mixed(key ^ sig[:, r::ROWS].astype(np.uint64)[:, :BANDS])
    return key.view(np.int64)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal MinHash values among n at which the similarity still reaches the threshold with posterior probability of at least the tolerance.

    The prior is uniform, so the posterior is Beta(m + 1, n - m + 1) and that probability is P(Binomial(n + 1, threshold) <= m).
    """
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


_LEAST = [(n, least_matches(n)) for n in range(STEP, BANDS * ROWS + 1, STEP)]


def pruned(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs outlive the comparison of ever more MinHash values."""
    alive = np.arange(len(i))
    match = np.zeros(len(i), np.int32)
    for n, least in _LEAST:
        if not len(alive):
            break
        match += (sig[i[alive], n - STEP : n] == sig[j[alive], n - STEP : n]).sum(1, dtype=np.int32)
        go = match >= least
        alive, match = alive[go], match[go]
    return alive


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs have an exact Jaccard similarity of at least the threshold."""
    size = np.array([len(s) for s in sets], np.int64)
    both = np.zeros(len(i), np.int64)
    if len(i) <= 8 * len(sets):
        for k, (a, b) in enumerate(zip(i, j)):
            both[k] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:  # a product of incidence matrices, some columns at a time
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times > 1
        rank = np.cumsum(shared) - 1
        use = shared[column]
        owner, column = owner[use], rank[column[use]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        dense = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(rank[-1]) + 1, 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            dense += part @ part.T
        both = dense[i, j].astype(np.int64)
    return np.flatnonzero(both >= threshold * (size[i] + size[j] - both) - 1e-9)


def compared(cell: pd.DataFrame) -> pd.DataFrame:
    """For the texts of one cell: each text's linked documents (copies counted) and the least text of its local component.

    A cell holds whole components, or two blocks (perhaps the same) of one large component, of which only pairs across count, or two
    blocks of the texts that agree in band ``band``, of which only pairs that agree in no earlier band count.
    """
    sets = [shingles(t) for t in cell.text]
    right = np.array([set_key(s) == bytes(k) for s, k in zip(sets, cell.key)], bool)
    cell = cell.assign(_set=sets)[right].drop_duplicates("key").sort_values("comp", kind="stable").reset_index(drop=True)
    keys, copies, comp = [bytes(k) for k in cell.key], cell.n.to_numpy(np.int64), cell.comp.to_numpy()
    links, up = np.zeros(len(cell), np.int64), np.arange(len(cell))
    sets = list(cell._set)
    if not sets:
        return pd.DataFrame({"key": [], "root": [], "links": np.empty(0, np.int64)})
    sig, size = signatures(sets), np.array([len(s) for s in sets])

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    band = int(cell.band.iloc[0])
    bands = band_keys(sig)[:, :band] if band > 0 else None
    edges = np.flatnonzero(np.r_[True, comp[1:] != comp[:-1], True])
    block, side = cell.blk.to_numpy(), cell.g2.iloc[0] == cell.g3.iloc[0]
    for lo, hi in zip(edges[:-1], edges[1:]):
        i, j = np.triu_indices(hi - lo, 1)
        i, j = i + lo, j + lo
        near = np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j]) - 1e-9
        if not side:
            near &= block[i] != block[j]
        i, j = i[near], j[near]
        if bands is not None:
            first = np.fromiter((not (bands[a] == bands[b]).any() for a, b in zip(i, j)), bool, len(i)) if len(i) < 1000 else ~np.logical_or.reduce([bands[i, k] == bands[j, k] for k in range(band)])
            i, j = i[first], j[first]
        keep = pruned(sig, i, j)
        i, j = i[keep], j[keep]
        if len(i):
            keep = verified(sets[lo:hi], i - lo, j - lo)
            i, j = i[keep], j[keep]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            for a, b in zip(i, j):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
    return pd.DataFrame({"key": keys, "root": [keys[find(x)] for x in range(len(keys))], "links": links})


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, rid2, class_key, class_id, n_links, n_copies) for every row of docs.

    A document's set holds its distinct runs of five words (all its words if there are fewer). ``n_links`` is the number of other
    rows whose set has a similarity of 0.8 or more, rows with an equal set included; ``class_id`` is the least doc_id among all rows reached over
    links, ``n_copies`` the rows with an equal set. Texts without words have no links and are classes of their own. Null ids take part and never are
    a class_id unless the class has no other. ``rid`` and ``rid2`` tell rows apart; only repeated rows share them.

    Equal sets are collapsed first. The rest are cut into MinHash bands; the sets of a band point to its least set only,
    and the components of these pointers (not their pairs) say which texts can be similar. Each component is compared once: in one cell of at most
    BLOCK texts, or in cells of two blocks, or, if it has more than MOST_BLOCKS, in cells of the texts that share a band. Pairs exist only
    as arrays within a task, and a cell emits a row a text. Rows of keys that hold very many (one text's copies, one component, one class, one band)
    are dealt over several tasks before they are joined.
    """
    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", "text", *row_ids())

    def sign(batches):
        for b in batches:
            for lo in range(0, len(b), 500):
                few = b.iloc[lo : lo + 500]
                sets = [shingles(t or "") for t in few.text]
                bands: list = [None] * len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    for i, row in zip(full, band_keys(signatures([sets[i] for i in full]))):
                        bands[i] = row
                yield pd.DataFrame({"doc_id": few.doc_id.array} | {c: few[c].array for c in ROW} | {"key": [set_key(s) for s in sets], "size": [len(s) for s in sets], "bands": bands})

    signed = written(in_text_batches(own).mapInPandas(sign, f"doc_id {kind}, rid long, rid2 long, key binary, size int, bands array<long>"), "signed")
    groups = signed.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.min(F.struct(*ROW)).alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    groups = written(groups.select("key", "n", "first_id", "row.*", "size", "bands", F.xxhash64("key").alias("node")), "groups")
    banded = groups.select("node", F.explode("bands").alias("band"))
    hubs = written(banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other"), F.count("*").alias("m")).where("hub != other").drop("other"), "hubs")
    total, n_banded = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()
    stars = salted(banded, hubs.drop("m"), ["band"], hot_among(hubs, "m", n_banded), ["node"]).where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    members = groups.select("key", "n", *ROW, "size", "node").join(components(stars).withColumnRenamed("root", "comp"), "node")
    cells = _cells(written(members, "members"), groups)
    texts = own.select(*ROW, "text").join(cells.groupBy(*ROW).agg(F.collect_list(F.struct("key", "n", "comp", "blk", "band", "g1", "g2", "g3")).alias("to")), ROW).dropDuplicates(ROW)
    found = written(texts.select("text", F.inline("to")).groupBy("g1", "g2", "g3").applyInPandas(compared, "key binary, root binary, links long"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    info = groups.select("key", "n", "first_id").join(links, "key", "left").join(classes.select(F.col("node").alias("key"), "root"), "key", "left")
    info = info.withColumn("class_key", F.coalesce("root", "key"))
    heads = written(info.groupBy("class_key").agg(F.min("first_id").alias("class_id"), F.count("*").alias("m")), "heads")
    info = salted(info, heads.drop("m"), ["class_key"], hot_among(heads, "m", total), ["key"])
    info = info.select("key", "class_key", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("n").alias("n_copies"))
    out = salted(signed.where(F.col("key").isNotNull()).select("doc_id", *ROW, "key"), info, ["key"], hot_among(groups, "n", total), ROW)
    out = out.select("doc_id", *ROW, "class_key", "class_id", "n_links", "n_copies")
    alone = signed.where(F.col("key").isNull()).select("doc_id", *ROW, F.lit(None).cast("binary").alias("class_key"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(alone)


def _cells(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, n, ROW, comp, blk, band, g1, g2, g3): the cells that members (key, n, ROW, size, node, comp) go to; a cell's size is bounded by texts and by shingles."""
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    many = lambda df, by: df.groupBy(by).agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    total, shingled = members.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bins = max(1, -(-total // BLOCK), -(-shingled // BLOCK_SHINGLES))
    sizes = many(members, "comp")
    sizes = written(sizes, "sizes")
    sized = salted(members, sizes.select("comp", blocks.alias("nb")), ["comp"], hot_among(sizes, "m", total), ["key"])
    block = F.pmod(F.xxhash64(F.lit(9), "key"), F.col("nb").cast("long")).cast("int").alias("blk")
    no_band, columns = F.lit(-1).alias("band"), ["key", "n", *ROW, "comp", "blk", "band", "g1", "g2", "g3"]
    small = sized.where("nb = 1").select("key", "n", *ROW, "comp", F.lit(0).alias("blk"), no_band, F.pmod(F.xxhash64(F.lit(5), "comp"), F.lit(bins)).alias("g1"), F.lit(-1).alias("g2"), F.lit(-1).alias("g3"))
    to = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("to")
    pairs = [F.least("blk", "to").alias("g2"), F.greatest("blk", "to").alias("g3")]
    mid = sized.where(f"nb BETWEEN 2 AND {MOST_BLOCKS}").select("*", block, no_band).select("*", to).select("key", "n", *ROW, "comp", "blk", "band", F.col("comp").alias("g1"), *pairs)
    out = small.union(mid.select(columns))
    giant = sized.where(f"nb > {MOST_BLOCKS}")
    if giant.take(1):
        giant = giant.select("key", "n", *ROW, "size").join(groups.select("key", "bands"), "key").select("key", "n", *ROW, "size", F.posexplode("bands").alias("band", "value"))
        giant = written(giant, "giant")
        buckets = written(many(giant, "value").where("m > 1"), "buckets")
        bucketed = salted(giant, buckets.select("value", blocks.alias("nb")), ["value"], hot_among(buckets, "m", giant.count()), ["key"])
        bucketed = bucketed.select("*", block).select("*", to).select("key", "n", *ROW, F.col("value").alias("comp"), "blk", "band", F.xxhash64(F.lit(6), "value").alias("g1"), *pairs)
        out = out.union(bucketed.select(columns))
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each class the row with the least doc_id (null last; ties by a hash of the text) stays, once."""
    found = written(linked(docs), "classes")
    names = [f"__{c}" for c in ROW]
    first = found.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)).alias("x")).select(*[F.col(f"x.{c}").alias(n) for c, n in zip(ROW, names)])
    own = docs.withColumns(dict(zip(names, row_ids())))
    alone = found.where(F.col("class_key").isNull()).select(*ROW).toDF(*names)
    stay = own.join(first, names, "left_semi").dropDuplicates(names)
    return stay.unionByName(own.join(alone, names, "left_semi")).drop(*names)


def joined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and its number of links."""
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


JOINED_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
runs AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM runs),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.r),
classes AS (SELECT doc_id, min(r) AS class_id FROM reached GROUP BY doc_id),
counts AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS copies FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, 1 + coalesce(copies, 0) AS n_copies FROM classes LEFT JOIN counts USING (doc_id)
"""
