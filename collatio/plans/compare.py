"""All layers of a comparison, for any number of pairs, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import SPACE, too_long
from ..operators import drawing, formatting, matching, raster, tables
from ..operators.alignment import word_diffs
from ..sources import parsers, storage
from .scratch import spread, written
from .summary import PAGE_DIFFERS, visible_matches, with_summary

ONE_SIDED_TABLES = "Only one of the two files has tables, so rows and cells were not compared; the texts were."
ONE_SIDED_FORMATS = "Fonts and styles were not compared: that takes two files in Word or PDF format, and only one of these is."
NO_PAGES = "The pages could not be drawn, so their looks were not compared."
NO_MEANING = "The paragraphs could not be matched by meaning."
NO_FORMATS = "Fonts and styles could not be compared."
BROKEN = "The comparison of these two files broke off."
STYLED = ("docx", "pdf")
FORMATTING = (
    "struct<changes:array<struct<out_idx:int,type:string,original_text:string,modified_text:string,changed_properties:array<struct<prop:string,from_value:string,to_value:string>>>>,"
    f"stats:struct<{','.join(f'{t}:bigint' for t in formatting.STATS)}>>"
)


def compare_files(pairs: DataFrame, pages: tuple[DataFrame, DataFrame] | None = None, plain: bool = False, images: str | None = None) -> DataFrame:
    """One row a pair of (pair_id, original_name, original_content, modified_name, modified_content): status, error, similarity, stats, segments, warnings and the layers.

    A layer that does not apply is null. A file that cannot be read, for whatever reason, makes its pair ``failed`` with a message; other pairs go on. A layer beyond
    the texts (meaning, formatting, pages) that breaks off is null and a warning, and the others go on.
    With ``plain`` all files are known to be texts, so that no other layer than text and meaning is planned.
    Pages of Word and PDF pairs are drawn by the provider ``raster`` (drawing.pages if none is registered), or given as ``pages``, rasters of the original and modified sides.
    With ``images``, a path, the difference images are stored there under the keys that the result names (storage.get_objects reads them).
    """
    docs = pairs.select("pair_id", *[f"{s}_{c}" for s in ("original", "modified") for c in ("name", "content")])
    for side in ("original", "modified"):
        files = docs.withColumnsRenamed({f"{side}_name": "filename", f"{side}_content": "content"})
        docs = parsers.extracted(files).withColumnRenamed("doc", side[0]).drop("filename", "content")
    docs = spread(written(docs.withColumn("error", F.coalesce("o.error", "m.error")), "documents"))
    good = docs.where("error IS NULL")
    texts = good.select("pair_id", F.col("o.text").alias("original"), F.col("m.text").alias("modified"))
    text = word_diffs(texts).select("pair_id", "similarity", "segments", F.struct("added", "removed", "replaced", "equal").alias("stats"))
    blank = lambda c: ~F.col(c).rlike(f"[^{SPACE}]")
    meaning = _meaning(texts.where(~blank("original") & ~blank("modified")))
    sheets = _tables(good.where((F.size("o.tables") > 0) & (F.size("m.tables") > 0)))
    fits = lambda c: F.col(c).isin(*STYLED)
    styled = good.where(fits("o.format") & fits("m.format")).select("pair_id")
    if plain:
        none = lambda name, kind, broken: good.limit(0).select("pair_id", F.lit(None).cast(kind).alias(name), F.lit(False).alias(broken))
        fields = [f for f in StructType.fromDDL(raster.PAGE) if f.name not in ("pair_id", "images")]
        style, shown = none("formatting_diff", FORMATTING, "no_formats"), none("visual_diff", ArrayType(StructType(fields)), "no_pages")
    else:
        style, shown = _formats(pairs, styled), _pages(pairs, good, styled, pages, images)
    out = docs
    for layer in (text, sheets, meaning, style, shown):
        out = out.join(layer, "pair_id", "left")
    broken = lambda c: F.coalesce(F.col(c), F.lit(False))
    warnings = F.filter(
        F.concat(
            "o.warnings", "m.warnings",
            F.array(
                F.when((F.size("o.tables") > 0) != (F.size("m.tables") > 0), ONE_SIDED_TABLES), F.when(broken("no_pages"), NO_PAGES), F.when(broken("no_meaning"), NO_MEANING),
                F.when(broken("no_formats"), NO_FORMATS), F.when(fits("o.format") != fits("m.format"), ONE_SIDED_FORMATS),
            ),
        ), lambda w: w.isNotNull(),
    )
    error = F.coalesce("error", F.when(F.col("similarity").isNull(), BROKEN))
    out = out.withColumn("error", error)
    failed = F.col("error").isNotNull()
    return out.select(
        "pair_id", F.when(failed, "failed").otherwise("done").alias("status"), "error", "similarity", "stats", "segments", F.when(~failed, warnings).alias("warnings"), "table_diff", "semantic_diff", "formatting_diff", "visual_diff"
    )


def _pages(pairs: DataFrame, good: DataFrame, styled: DataFrame, pages: tuple[DataFrame, DataFrame] | None, images: str | None) -> DataFrame:
    """(pair_id, visual_diff, no_pages) of the pairs whose pages can be drawn."""
    if pages is not None:
        shown = raster.compare_pages(*[p.join(styled, "pair_id", "left_semi") for p in pages]).withColumn("failed", F.lit(False))
    else:
        files = good.join(styled, "pair_id", "left_semi").select("pair_id", F.col("o.format").alias("o_format"), F.col("m.format").alias("m_format"))
        files = files.join(pairs.select("pair_id", F.col("original_content").alias("o_content"), F.col("modified_content").alias("m_content")), "pair_id")
        # A pair's pages take seconds, so few pairs must not share a task.
        files = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair_id")
        shown = raster.compare_documents(files, parsers.PROVIDERS.get("raster", drawing.pages))
    if images is not None:
        shown = written(shown, "pages")
        storage.put_objects(shown.where(~F.col("failed")).select(F.explode("images").alias("key", "content")), images)
    fields = [c for c in shown.columns if c not in ("pair_id", "page", "images", "failed")]
    found = shown.groupBy("pair_id").agg(F.max("failed").alias("no_pages"), F.array_sort(F.collect_list(F.when(~F.col("failed"), F.struct("page", *fields)))).alias("visual_diff"))
    found = styled.join(found, "pair_id", "left")
    return found.select("pair_id", F.when(~F.col("no_pages"), F.col("visual_diff")).alias("visual_diff"), F.coalesce("no_pages", F.lit(True)).alias("no_pages"))


def _meaning(texts: DataFrame) -> DataFrame:
    rows = matching.semantic_matches(texts, errors=True).groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "type", "original", "modified", "similarity", "confidence", "segments"))).alias("matches"),
        F.max(F.col("type").isNull()).alias("no_meaning"),
        F.coalesce(F.max(F.when(F.col("provider") != "n/a", F.col("provider"))), F.lit("n/a")).alias("provider"),
        *[F.count_if(F.col("type") == t).alias(t) for t in matching.MATCH_TYPES],
    )
    return rows.select("pair_id", F.when(~F.col("no_meaning"), F.struct("provider", "matches", F.struct(*matching.MATCH_TYPES).alias("stats"))).alias("semantic_diff"), "no_meaning")


def _tables(docs: DataFrame) -> DataFrame:
    side = lambda s: docs.select("pair_id", F.posexplode(f"{s}.tables").alias("table_pos", "t")).select("pair_id", "table_pos", "t.name", "t.rows")
    o, m = side("o"), side("m")
    paired = tables.row_diff(tables.pair_tables(o, m))
    count = lambda t: F.size(F.filter("rows", lambda r: r["type"] == t)).cast("long").alias(t)
    rows = paired.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("table_pos", "name", "rows", F.struct(*[count(t) for t in tables.STATS]).alias("stats")))).alias("tables"))
    names = lambda df, to: df.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_pos", "name"))), lambda x: x["name"]).alias(to))
    out = docs.select("pair_id").join(rows, "pair_id", "left").join(names(tables.only_on_one_side(m, o), "added_tables"), "pair_id", "left").join(names(tables.only_on_one_side(o, m), "removed_tables"), "pair_id", "left")
    none = F.array().cast("array<string>")
    return out.select("pair_id", F.struct("tables", F.coalesce("added_tables", none).alias("added_tables"), F.coalesce("removed_tables", none).alias("removed_tables")).alias("table_diff"))


def _formats(pairs: DataFrame, styled: DataFrame) -> DataFrame:
    """(pair_id, formatting_diff, no_formats) of the pairs of Word and PDF files."""
    files = None
    for side in ("original", "modified"):
        one = pairs.join(styled, "pair_id", "left_semi").select("pair_id", F.lit(side[0]).alias("side"), F.col(f"{side}_name").alias("filename"), F.col(f"{side}_content").alias("content"))
        files = one if files is None else files.unionByName(one)
    runs = written(parsers.formatting_runs(files, ["pair_id", "side"]), "runs")
    unread = runs.where("failed").select("pair_id", F.lit(True).alias("no_formats")).distinct()
    changes = formatting.compare_formats(formatting.paragraph_formats(runs.where(~F.col("failed")).drop("failed")))
    rows = changes.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("out_idx", "type", "original_text", "modified_text", "changed_properties"))).alias("changes"), *[F.count_if(F.col("type") == t).alias(t) for t in formatting.STATS])
    rows = styled.join(rows, "pair_id", "left").join(unread, "pair_id", "left")
    diff = F.struct("changes", F.struct(*[F.coalesce(t, F.lit(0)).alias(t) for t in formatting.STATS]).alias("stats"))
    return rows.select("pair_id", F.when(F.col("no_formats").isNull(), diff).alias("formatting_diff"), F.coalesce("no_formats", F.lit(False)).alias("no_formats"))


def compare_texts(pairs: DataFrame) -> DataFrame:
    """compare_files for pasted texts (pair_id, original, modified); texts beyond the limit fail their pair."""
    over = F.when(too_long(F.col("original")), "The text given as original is longer than allowed.").when(too_long(F.col("modified")), "The text given as modified is longer than allowed.")
    named = pairs.select("pair_id", *[x for s in ("original", "modified") for x in (F.lit(f"pasted-{s}.txt").alias(f"{s}_name"), F.encode(F.coalesce(s, F.lit("")), "UTF-8").alias(f"{s}_content"))])
    out = compare_files(named, plain=True).join(pairs.select("pair_id", over.alias("__over")), "pair_id")
    fields = [F.when(F.col("__over").isNull(), F.col(c)).alias(c) for c in out.columns if c not in ("pair_id", "status", "error", "__over")]
    return out.select("pair_id", F.when(F.col("__over").isNull(), F.col("status")).otherwise("failed").alias("status"), F.coalesce("__over", "error").alias("error"), *fields)


def summarized(results: DataFrame) -> DataFrame:
    """The summary of each done pair of compare_files, with the regions of all its pages and the matches that the side by side view shows."""
    n = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    counts = results.where("status = 'done'").select(
        "pair_id", "similarity",
        (F.col("stats.added") + F.col("stats.removed") + F.col("stats.replaced")).alias("n_text"),
        n(F.col("formatting_diff.stats.changed")).alias("n_formatting"), F.col("formatting_diff").isNotNull().alias("has_formatting"),
        n(F.aggregate("table_diff.tables", F.lit(0).cast("long"), lambda a, t: a + t["stats"]["added"] + t["stats"]["removed"] + t["stats"]["modified"])).alias("n_tables"), (F.size("table_diff.tables") > 0).alias("has_tables"),
        n(F.size(F.filter("visual_diff", lambda p: p["similarity"] < PAGE_DIFFERS))).alias("n_visual"), (F.size("visual_diff") > 0).alias("has_visual"),
        n(F.size(F.filter("semantic_diff.matches", lambda m: m["type"] != "exact_match"))).alias("n_meaning"), (F.size("semantic_diff.matches") > 0).alias("has_meaning"),
        n(F.aggregate("visual_diff", F.lit(0), lambda a, p: a + F.size(F.coalesce(p["regions"], F.array().cast(raster.REGIONS))))).alias("n_regions"),
        n(F.size(visible_matches(F.col("semantic_diff.matches")))).alias("n_visible_matches"),
    )
    return with_summary(counts)
