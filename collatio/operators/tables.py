"""Row and cell differences of tables that are paired by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import steps

KEY_SEPARATOR = "\x1f"
CELLS = "array<struct<row int, col int, original string, modified string>>"
ROWS = f"array<struct<type string, o_idx int, m_idx int, original array<string>, modified array<string>, cell_changes {CELLS}>>"
STATS = ("added", "removed", "modified", "equal")


def row_key(row: Column) -> Column:
    """Cells joined by a unit separator; null cells count as empty."""
    return F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), KEY_SEPARATOR)


def cell_changes(row_idx: Column, original: Column, modified: Column) -> Column:
    """Unequal cells by position; a short row is padded with empty cells."""
    places = F.sequence(F.lit(0), F.greatest(F.size(original), F.size(modified)) - 1)
    at = lambda row, i: F.coalesce(F.try_element_at(row, i + 1), F.lit(""))
    cell = lambda i: F.struct(row_idx.cast("int").alias("row"), i.cast("int").alias("col"), at(original, i).alias("original"), at(modified, i).alias("modified"))
    found = F.filter(F.transform(places, cell), lambda c: c["original"] != c["modified"])
    return F.when(F.greatest(F.size(original), F.size(modified)) > 0, found).otherwise(F.array().cast(CELLS))


def pair_tables(original: DataFrame, modified: DataFrame) -> DataFrame:
    """(pair_id, table_pos, name, original_rows, modified_rows) of tables (pair_id, table_pos, name, rows) by name.

    Of tables with the same name the last gives the rows; a name that the original side repeats comes out as often.
    """
    last = lambda df, to: df.groupBy("pair_id", "name").agg(F.max_by("rows", "table_pos").alias(to))
    both = last(original, "original_rows").join(last(modified, "modified_rows"), ["pair_id", "name"])
    return original.select("pair_id", "name", "table_pos").join(both, ["pair_id", "name"]).select("pair_id", "table_pos", "name", "original_rows", "modified_rows")


def only_on_one_side(tables: DataFrame, others: DataFrame) -> DataFrame:
    """(pair_id, name, table_pos) of names that others lack, at their first place."""
    return tables.join(others.select("pair_id", "name"), ["pair_id", "name"], "left_anti").groupBy("pair_id", "name").agg(F.min("table_pos").alias("table_pos"))


def diff_rows(original: list[list[str]], modified: list[list[str]]) -> list[dict]:
    """One dict an output row; in a changed block rows go together by place, the rest is removed or added."""
    clean = lambda rows: [[c or "" for c in r] for r in rows]
    original, modified = clean(original if original is not None else []), clean(modified if modified is not None else [])
    out: list[dict] = []

    def put(kind, i, j):
        o, m = None if i is None else original[i], None if j is None else modified[j]
        changes = []
        if kind == "modified":
            width = max(len(o), len(m))
            for c, (x, y) in enumerate(zip(o + [""] * (width - len(o)), m + [""] * (width - len(m)))):
                if x != y:
                    changes.append({"row": i, "col": c, "original": x, "modified": y})
        out.append({"type": kind, "o_idx": i, "m_idx": j, "original": o, "modified": o if kind == "equal" else m, "cell_changes": changes})

    for kind, i1, i2, j1, j2 in steps([KEY_SEPARATOR.join(r) for r in original], [KEY_SEPARATOR.join(r) for r in modified]):
        both = min(i2 - i1, j2 - j1)
        for k in range(both):
            put("equal" if kind == "equal" else "modified", i1 + k, j1 + k)
        for i in range(i1 + both, i2):
            put("removed", i, None)
        for j in range(j1 + both, j2):
            put("added", None, j)
    return out


def _aligned(original: pd.Series, modified: pd.Series) -> pd.Series:
    return pd.Series([diff_rows(list(map(list, a)) if a is not None else [], list(map(list, b)) if b is not None else []) for a, b in zip(original, modified)])


def row_diff(paired: DataFrame) -> DataFrame:
    """paired (with original_rows and modified_rows) with ``rows``, for tables that fit a task."""
    return paired.withColumn("rows", F.pandas_udf(_aligned, ROWS)("original_rows", "modified_rows"))


def fast_row_diff(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(differences, table keys that are not eligible) for exploded rows (keys, side, idx, row), without gathering a table.

    A table is eligible if no row repeats on a side and the common rows keep their order; then the alignment is the common rows, and between
    two of them rows go together by place. Differences have keys, seq (order of output), type, o_idx, m_idx, original, modified, cell_changes.
    """
    keyed = rows.select(*keys, "side", "idx", "row", row_key(F.col("row")).alias("key"))
    repeated = keyed.groupBy(*keys, "side", "key").agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    o = keyed.where("side = 'o'").select(*keys, "key", F.col("idx").alias("o_idx"))
    m = keyed.where("side = 'm'").select(*keys, "key", F.col("idx").alias("m_idx"))
    common = o.join(m, [*keys, "key"])
    before = F.lag("m_idx").over(Window.partitionBy(*keys).orderBy("o_idx"))
    crossed = common.withColumn("__b", before).where("__b > m_idx").select(*keys)
    other = repeated.union(crossed).distinct()
    use = keyed.join(other, keys, "left_anti")
    sides = Window.partitionBy(*keys, "key")
    use = use.withColumn("__both", F.count("*").over(sides) == 2)
    use = use.withColumn("gap", F.count_if("__both").over(Window.partitionBy(*keys, "side").orderBy("idx")))
    place = F.row_number().over(Window.partitionBy(*keys, "side", "gap", "__both").orderBy("idx"))
    use = use.withColumn("k", F.when(F.col("__both"), 0).otherwise(place))
    side = lambda s, idx, name: use.where(F.col("side") == s).select(*keys, "gap", "k", F.col("idx").alias(idx), F.col("row").alias(name))
    out = side("o", "o_idx", "original").join(side("m", "m_idx", "modified"), [*keys, "gap", "k"], "full")
    kind = F.when(F.col("k") == 0, "equal").when(F.col("m_idx").isNull(), "removed").when(F.col("o_idx").isNull(), "added").otherwise("modified")
    out = out.withColumn("type", kind)
    out = out.withColumn("cell_changes", F.when(F.col("type") == "modified", cell_changes(F.col("o_idx"), F.col("original"), F.col("modified"))).otherwise(F.array().cast(CELLS)))
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy("gap", "k")) - 1
    return out.select(*keys, seq.alias("seq"), "type", "o_idx", "m_idx", "original", "modified", "cell_changes"), other


def any_row_diff(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The differences of all tables, as fast_row_diff gives them: by joins where that is exact, and by alignment within a task for the other tables."""
    fast, other = fast_row_diff(rows, keys)
    side = lambda s, name: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("idx", "row")))), lambda x: x["row"]).alias(name)
    gathered = rows.join(other, keys, "left_semi").groupBy(*keys).agg(side("o", "original_rows"), side("m", "modified_rows"))
    slow = row_diff(gathered).select(*keys, F.posexplode("rows").alias("seq", "r")).select(*keys, "seq", "r.*")
    return fast.select([F.col(c).cast(dict(slow.dtypes)[c]).alias(c) for c in slow.columns]).unionByName(slow)


def row_stats(diff: DataFrame, keys: list[str]) -> DataFrame:
    return diff.groupBy(*keys).agg(*[F.count_if(F.col("type") == t).alias(t) for t in STATS])
