"""What the operators of this subpackage share: scratch tables, word positions and hashes of whole texts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the ASCII blanks, in bytes of UTF-8 as in code points.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


#: Most rows of an Arrow batch of whole texts. Spark's default of 10,000 would hold some hundred megabytes of texts in every task, on both sides.
TEXT_BATCH = 1000


def in_text_batches(df: DataFrame) -> DataFrame:
    """df, in a session that sends few texts at a time to Python; a size that the session has set itself stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(TEXT_BATCH))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local master, whose executors are the driver, gets a temporary one where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            found = jdir.get()
        elif spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="collatio-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/collatio-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again. The table goes when the session's JVM ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, n: int, seed: int, *cols: str) -> DataFrame:
    """The n rows of df with the smallest seeded hashes of cols, which should tell rows apart.

    The rows are counted first, so that few beyond n pass the hash's threshold, whatever the number of partitions; a task sends no n rows of its own to the driver.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12) / float(1 << 52)
    few = df.withColumn("__h", h).where(F.col("__h") < min(1.0, (1.3 * n + 50) / max(df.count(), 1)))
    return few.orderBy("__h", *cols).limit(n).drop("__h")


#: The columns that tell rows apart: 128 bits of id and text, so that no two rows of any corpus share them by chance. Only repeated rows do.
ROW = ["rid", "rid2"]


def row_ids() -> list:
    """ROW from doc_id and text."""
    text = F.col("text").cast("string")
    return [F.xxhash64(F.lit(3), F.col("doc_id"), text).alias("rid"), F.xxhash64(F.lit(11), text, F.col("doc_id")).alias("rid2")]


#: A key is hot if it has so many rows, and more than this part of all: there are never more hot keys than parts, so a table of them may be broadcast.
HOT_ROWS, HOT_PARTS, SALTS = 10_000, 50_000, 64


def hot_from(total: int) -> int:
    """The most rows of a key that is not hot among ``total`` rows."""
    return max(HOT_ROWS, total // HOT_PARTS)


def hot_among(sizes: DataFrame, column: str, total: int) -> DataFrame | None:
    """The rows of sizes whose count in ``column`` makes their key a hot one among ``total`` rows; None if no key is hot."""
    most = hot_from(total)
    return sizes.where(F.col(column) > most) if (sizes.agg(F.max(column)).first()[0] or 0) > most else None


def salted(rows: DataFrame, others: DataFrame, keys: list[str], hot: DataFrame | None, by: list[str]) -> DataFrame:
    """The inner join of rows with others, whose keys are unique. Rows of the keys in ``hot`` (see hot_among), if any, are dealt over SALTS tasks by the hash of columns ``by``.

    Hot keys are known by a 64-bit hash, as a broadcast of single numbers takes a small part of the memory of one of whole keys; another key with that hash is dealt over tasks too.
    """
    if hot is None:
        return rows.join(others, keys)
    mark = F.broadcast(hot.select(F.xxhash64(*keys).alias("__hot")).distinct())
    spread = lambda df: df.withColumn("__key", F.xxhash64(*keys)).join(mark, F.col("__key") == F.col("__hot"), "left").withColumn("__salts", F.when(F.col("__hot").isNotNull(), SALTS).otherwise(1)).drop("__hot", "__key")
    left = spread(rows).withColumn("__salt", F.pmod(F.xxhash64(*by), F.col("__salts"))).drop("__salts")
    right = spread(others).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts").cast("long") - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# ---- whole texts as arrays ------------------------------------------------------------------------


def _powers(n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    filled = 1
    while filled < n:
        step = np.uint64(pow(_BASE, filled, 1 << 64))
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        filled += more
    return out


class _PowerTable:
    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up = _powers(n)
            inverse = pow(_BASE, -1, 1 << 64)
            last = np.uint64(pow(inverse, n - 1, 1 << 64))
            self.down = (self.up * last)[::-1].copy()  # base**-(i)
        return self.up, self.down


_POWERS = _PowerTable()


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in UTF-8 bytes."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    inside &= 1
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, alike for like bytes."""
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mixed(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes; empty if there are fewer."""
    if len(words) < k:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    for i in range(k):
        out = out * step + words[i : len(words) - k + 1 + i]
    return mixed(out)


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the text, and for each word its start, end and hash."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = word_spans(data)
    return data, starts, ends, span_hashes(data, starts, ends)
