"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle verification; column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, row_ids, table, text_or_empty, written

WORDS, THRESHOLD = 5, 0.8
#: Sets at the threshold lie at a cosine of 8/9, so 64 bits differ in 9.7 places on average, in more than 24 with probability 3e-6.
RADIUS, BITS = 24, 64
#: Largest tables that are broadcast, in rows of about 40 bytes; larger ones are joined by a shuffle.
BROADCAST_SHINGLES, BROADCAST_WINDOWS = 1_000_000, 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII blanks."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def run_hashes(hashes: str, k: int) -> Column:
    """The run of k words at each word as a hash of the words' hashes; the last k - 1 runs are too short and of no use."""
    following = "".join(f", get({hashes}, i + {j})" for j in range(1, k))
    return F.expr(f"transform({hashes}, (x, i) -> xxhash64(x{following}))")


def shingles_of(words: str, k: str) -> Column:
    """The runs of k words of an array, joined by blanks; a shorter array has none."""
    return F.expr(f"IF(size({words}) < {k}, cast(array() AS array<string>), transform(sequence(1, greatest(size({words}) - {k}, 0) + 1), i -> array_join(slice({words}, i, {k}), ' ')))")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are computed once: what follows, filters too, refers to their values, as nothing is moved through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def numbered(ordered: str) -> Column:
    """Sorted shingles with the number of their occurrence as a last word, so that such sets compare as the multisets do."""
    return F.expr(f"transform({ordered}, (s, i) -> concat(s, ' ', i + 1 - array_position({ordered}, s)))")


def characters(shingles: str, last_word: bool = False) -> str:
    """The characters of all shingles, without the last words of numbered ones."""
    less = " - char_length(substring_index(s, ' ', -1)) - 1" if last_word else ""
    return f"aggregate({shingles}, 0L, (a, s) -> a + char_length(s){less})"


def fingerprinted(df: DataFrame, shingles: str, total: str) -> DataFrame:
    """df's columns but ``shingles``, with ``print``, the 64-bit SimHash of the shingles, each weighted by its characters, of which there are ``total`` (below 2**31).

    A sum holds two of the 64 counts in its halves: bits i and i + 32 of a shingle's hash, times its weight. No two rows may be equal but for their shingles.
    """
    keys = [c for c in df.columns if c != shingles]
    each = df.select(*keys, F.explode(shingles).alias("__s")).select(*keys, F.xxhash64("__s").alias("__h"), F.char_length("__s").cast("long").alias("__c"))
    pair = lambda i: F.sum(F.shiftright("__h", i).bitwiseAND(F.lit((1 << 32) + 1)) * F.col("__c")).alias(f"__{i}")
    sums = each.groupBy(*keys).agg(*[pair(i) for i in range(32)])
    set_if = lambda half, i: F.when(2 * half > F.col(total), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    bits = [b for i in range(32) for b in (set_if(F.col(f"__{i}").bitwiseAND(F.lit((1 << 32) - 1)), i), set_if(F.shiftrightunsigned(f"__{i}", 32), i + 32))]
    return settled(sums, print=reduce(Column.bitwiseOR, bits)).select(*keys, "print")


def _cuts(radius: int) -> list[tuple[int, int]]:
    """First bit and bit after the last of radius + 1 blocks of a fingerprint."""
    cut = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return list(zip(cut, cut[1:]))


def blocks(fingerprint: str, radius: int = RADIUS) -> Column:
    """Numbered blocks of a fingerprint, one more than the radius: fingerprints within it agree in one of them at least."""
    return F.array(*[F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(i << 32) for i, (a, b) in enumerate(_cuts(radius))])


def _first_block(radius: int) -> Column:
    """Whether block ``b`` is the first in which the two fingerprints agree: a pair that agrees in several counts once."""
    cases = " ".join(f"WHEN (shiftrightunsigned(print ^ item_print, {a}) & {(1 << (b - a)) - 1}L) = 0 THEN {i}" for i, (a, b) in enumerate(_cuts(radius)))
    return F.expr(f"shiftright(b, 32) = CASE {cases} END")


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, item) and (item, w, n, k, sh, nsh, total, print) of items with words; those with equal words share the key ``item``."""
    items = settled(benchmark.select("item_id", words_of(text_or_empty()).alias("w")).where("size(w) > 0"), item=F.xxhash64("w"))
    kinds = items.select("item", "w", F.size("w").alias("n")).dropDuplicates(["item"]).withColumn("k", F.least(F.lit(WORDS), F.col("n")))
    kinds = settled(settled(kinds, sh=shingles_of("w", "k")), ordered=F.sort_array("sh"), total=F.expr(characters("sh")))
    kinds = written(kinds.select("item", "w", "n", "k", "sh", numbered("ordered").alias("nsh"), "total"), "items")
    prints = fingerprinted(kinds.select("item", "sh", "total"), "sh", "total").select("item", "print")
    return items.select("item_id", "item"), written(kinds.join(prints, "item"), "prints")


def _windows(own: DataFrame, items: DataFrame, threshold: float) -> DataFrame | None:
    """(ROW, item, n, k, total, start, most): every window of an item's size in which the item's runs weigh ``most``, at least the threshold's part of the item.

    No other window can be similar: what it shares with the item is at most ``most``. Runs are compared by hashes, which only select.
    """
    words = settled(own.select(*ROW, words_of(text_or_empty()).alias("w")), m=F.size("w"), wh=F.transform("w", lambda w: F.xxhash64(w))).select(*ROW, "m", "wh")
    found = []
    for k in sorted(r.k for r in items.select("k").distinct().collect()):  # at most WORDS values
        places = settled(items.where(F.col("k") == k).select("item", "n", "total", "w", "sh"), wh=F.transform("w", lambda w: F.xxhash64(w)))
        places = places.select("item", "n", "total", F.explode(F.arrays_zip(F.slice(run_hashes("wh", k), F.lit(1), F.size("sh")).alias("h"), F.transform("sh", lambda s: F.char_length(s)).alias("c"))).alias("x"))
        places = places.select("item", "n", "total", "x.h", "x.c").distinct()
        if places.count() <= BROADCAST_SHINGLES:
            places = F.broadcast(places)
        runs = words.where(F.col("m") >= k).select(*ROW, "m", F.posexplode(run_hashes("wh", k)).alias("p", "h")).where(F.col("p") <= F.col("m") - k)
        seeds = runs.join(places, "h")
        # A window that starts in part b of a text (n places) ends in part b + 1 at most.
        part = F.explode(F.expr("IF(p < n, array(0L), array(cast(p div n AS long), cast(p div n AS long) - 1))")).alias("b")
        keys = [*ROW, "item", "m", "n", "total", "b"]
        seeds = seeds.select(*keys[:-1], F.struct("p", "c").alias("seed"), part).groupBy(*keys)
        seeds = seeds.agg(F.sum("seed.c").alias("most"), F.collect_list("seed").alias("seeds")).where(F.col("most") >= threshold * F.col("total") - 1e-6).where("b * n <= greatest(0, m - n)")
        starts = "sequence(cast(b * n AS int), cast(least((b + 1) * n - 1, greatest(0, m - n)) AS int))"
        weighed = f"transform({starts}, s -> named_struct('start', s, 'most', aggregate(seeds, 0L, (a, x) -> a + IF(x.p BETWEEN s AND s + n - {k}, x.c, 0))))"
        seeds = seeds.select(*ROW, "item", "n", "total", F.inline(F.expr(f"filter({weighed}, x -> x.most >= {threshold} * total - 1e-6)")))
        found.append(seeds.select(*ROW, "item", "n", F.lit(k).alias("k"), "total", "start", "most"))
    return reduce(DataFrame.union, found) if found else None


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(doc_id, rid, rid2, item_id, start_word, n_words, similarity) for each row of docs and each benchmark item that stands in it, at its best place.

    A window has as many words as an item (the whole text if that is shorter) and may start at every word. Similarity is the weighted Jaccard similarity of the
    five-word shingles of window and item, counted with repeats and weighted by characters; 0.8 or more counts. Items of fewer words are one shingle.
    Only windows that share so much with an item that they can be similar are fingerprinted; this loses none, and all words are looked at. A pair
    at the threshold has fingerprints beyond the radius with probability 3e-6. Null and empty texts and items match nothing; ties go to the first
    place; repeated rows match alike and are returned once; repeated items all match. rid and rid2 tell rows apart.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", "text", *row_ids())
    ids, items = _items(benchmark)
    windows = _windows(own, items, threshold)
    if windows is None:
        return own.limit(0).select("doc_id", *ROW, F.lit(None).cast(dict(benchmark.dtypes)["item_id"]).alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    windows = written(windows, "windows")
    few = windows.count() <= BROADCAST_WINDOWS
    windows = windows.groupBy(*ROW).agg(F.collect_list(F.struct("item", "n", "k", "total", "start", "most")).alias("wins"))
    texts = settled(own.join(F.broadcast(windows) if few else windows, ROW).dropDuplicates(ROW), w=words_of(F.col("text")))
    cut = texts.select("doc_id", *ROW, F.inline(F.expr("transform(wins, x -> named_struct('item', x.item, 'k', x.k, 'total', x.total, 'start', x.start, 'most', x.most, 'w', slice(w, x.start + 1, x.n)))")))
    cut = settled(settled(cut, sh=shingles_of("w", "k")), own=F.expr(characters("sh")))
    cut = cut.where(F.col("most") * (1 + threshold) >= threshold * (F.col("total") + F.col("own")) - 1e-6)
    cut = fingerprinted(cut.select("doc_id", *ROW, "item", "start", "k", "own", F.array_join("w", " ").alias("window"), "sh"), "sh", "own")
    sought = items.select("item", "nsh", "total", F.col("print").alias("item_print")).withColumn("b", F.explode(blocks("item_print", radius)))
    near = cut.withColumn("b", F.explode(blocks("print", radius))).join(sought, ["item", "b"])
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).where(_first_block(radius))
    near = settled(near, w=F.split("window", " "))
    near = settled(near, ordered=F.sort_array(shingles_of("w", "k")))
    near = settled(near.withColumn("shared", F.array_intersect("nsh", numbered("ordered"))), both=F.expr(characters("shared", last_word=True)))
    near = near.withColumn("similarity", F.col("both") / F.greatest(F.col("own") + F.col("total") - F.col("both"), F.lit(1))).where(F.col("similarity") >= threshold)
    best = near.groupBy("doc_id", *ROW, "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), F.size("w").alias("n_words"))).alias("x"))
    return best.join(ids, "item").select("doc_id", *ROW, "item_id", (-F.col("x.s")).alias("start_word"), F.col("x.n_words").alias("n_words"), F.col("x.similarity").alias("similarity")).distinct()


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark item stands. The rows found are broadcast if they are few, so that no text is shuffled."""
    found = written(contaminated(docs, benchmark).select(*ROW).distinct(), "found")
    if found.count() <= BROADCAST_WINDOWS:
        found = F.broadcast(found)
    names = [f"__{c}" for c in ROW]
    marked = docs.withColumns(dict(zip(names, row_ids())))
    return marked.join(found.toDF(*names), names, "left_anti").select(docs.columns)


def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that stands in it."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(*ROW)


#: Every window between the first and the last place where a document and an item share a run; windows elsewhere share nothing.
CONTAMINATED_SQL = r"""
WITH items AS (SELECT item_id, ws, len(ws) AS n, least(5, len(ws)) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark) WHERE len(ws) > 0),
ig AS (SELECT item_id, n, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM items)),
ic AS (SELECT item_id, n, k, s, count(*) AS c FROM ig GROUP BY ALL),
it AS (SELECT item_id, sum(c * length(s)) AS total FROM ic GROUP BY ALL),
docs AS (SELECT doc_id, ws, len(ws) AS m FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)),
dg AS (SELECT doc_id, m, k, i - 1 AS p, array_to_string(ws[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items) WHERE m >= k)),
pairs AS (SELECT doc_id, m, item_id, n, k, min(p) AS first, max(p) AS last FROM dg JOIN ic USING (k, s) GROUP BY ALL),
starts AS (SELECT doc_id, m, item_id, n, k, unnest(range(greatest(0, least(first - n + k, m - n)), least(last, greatest(0, m - n)) + 1)) AS start FROM pairs),
wg AS (SELECT doc_id, item_id, n, m, k, start, s, count(*) AS c FROM starts JOIN dg USING (doc_id, m, k) WHERE p BETWEEN start AND start + least(n, m) - k GROUP BY ALL),
sims AS (SELECT doc_id, item_id, start, least(n, m) AS n_words, sum(least(wg.c, coalesce(ic.c, 0)) * length(s)) AS lo, sum(wg.c * length(s)) AS own FROM wg LEFT JOIN ic USING (item_id, n, k, s) GROUP BY ALL),
best AS (SELECT *, total + own - lo AS hi, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY lo / (total + own - lo) DESC, start) AS r FROM sims JOIN it USING (item_id) WHERE 10 * lo >= 8 * (total + own - lo))
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(n_words AS INTEGER) AS n_words, CAST(lo AS DOUBLE) / CAST(hi AS DOUBLE) AS similarity FROM best WHERE r = 1
"""
