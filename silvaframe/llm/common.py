"""What the operators share: shared scratch tables, hierarchical running sums, connected components, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: they are whole texts here.
BATCH = 1024


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH rows, where the session has Spark's default of 10,000; any other choice stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the setting is absent and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='silvaframe-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Tables written to the shared folder and read again.

    A written table cuts the lineage, survives lost executors, gives the planner true sizes and is
    readable by column. `save` returns the reread table; `drop` deletes one that is no longer read;
    what is left goes when Python exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        short_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def save(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.root)
            except Exception:  # the JVM is gone: nothing to ask any more
                pass


def frugal(run):
    """A function over Arrow batches or frames that hands free memory back when its task ends: Python workers live on
    from stage to stage, and what one stage freed would count against the next."""

    def tidy(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
        if trim:
            trim(0)

    return tidy


def md5_long(*cols: Column | str) -> Column:
    """A 60-bit hash that any SQL engine with md5 can repeat; nulls count as the empty string."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def offsets_before(blocks: DataFrame, keys: list[str], first: str, then: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` within `keys` in the order (first, *then).

    Two levels: `first` numbers runs of bounded length; sums of runs are added up over the few runs,
    rows only within their run. No window holds more than one run or the list of runs.
    """
    runs = blocks.groupBy(*keys, first).agg(F.sum(value).alias("_run"))
    over = Window.partitionBy(*keys).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, first, F.coalesce(F.sum("_run").over(over), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, first).orderBy(*then).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(runs, [*keys, first])
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_base", "_in")
    )


def _forest(batches):
    """A spanning forest of the edges of each batch, each node pointing at the least node of its tree."""
    import pandas as pd

    for batch in batches:
        nodes, ends = np.unique(batch[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        child = label != np.arange(len(nodes))
        yield pd.DataFrame({"a": nodes[child], "b": nodes[label[child]]})


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every node of `edges` (a long, b long); component is the least id reachable.

    Each partition first shrinks its edges to a forest, then alternating large-star and small-star
    rounds (Kiveris et al. 2014) run until the edges are stars. Only two-column tables move; each
    round is written to the shared folder.
    """
    long = lambda x: F.col(x).cast("long").alias(x)
    now = scratch.save(edges.where("a <> b").select(long("a"), long("b")).mapInPandas(frugal(_forest), "a long, b long").distinct())
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        # stars: nobody's parent has a parent, and nobody has two
        deep = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        again = deep or new.count() != new.select("a").distinct().count()
        scratch.drop(now)
        now = new
        if not again:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


# --- word hashes over raw UTF-8 bytes, for whole Arrow batches at once ---

PIECE = 1 << 18
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(n, PIECE + 1)
        _powers["up"] = np.cumprod(np.full(m, _BASE, np.uint64))
        _powers["down"] = np.cumprod(np.full(m, pow(_BASE, -1, 1 << 64), np.uint64))
    return _powers["up"], _powers["down"]


def _hash_piece(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a stretch that no word leaves."""
    space = np.ones(len(buf) + 2, np.int8)
    space[1:-1] = _SPACE[buf]
    step = np.diff(space)
    start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    up, down = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes, in order, and where each begins.

    Works through the bytes in pieces cut at white space, so temporary memory does not follow the text.
    """
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(at + PIECE, len(buf))
        if end < len(buf):
            gaps = np.flatnonzero(_SPACE[buf[at:end]])
            while not len(gaps) and end < len(buf):  # one word longer than a piece
                more = min(end + PIECE, len(buf))
                gaps = np.flatnonzero(_SPACE[buf[end:more]]) + (end - at)
                end = more
            if len(gaps) and end < len(buf):
                end = at + int(gaps[-1]) + 1
        h, s = _hash_piece(buf[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def batch_words(column):
    """For each text of an Arrow string column: the hashes of its words (none for null)."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    i = 0
    while i < len(column):
        # as many whole texts as make a piece; the byte after each text is not read, so cut words at its end
        j = i + 1
        while j < len(column) and ends[j + 1] - ends[i] <= PIECE:
            j += 1
        if j == i + 1:
            yield word_hashes(raw[ends[i] : ends[j]])[0] if valid[i] else np.zeros(0, np.uint64)
        else:
            lengths = np.diff(ends[i : j + 1])
            joined = np.full(int(lengths.sum()) + (j - i), 32, np.uint8)
            at = np.concatenate([[0], np.cumsum(lengths + 1)])
            keep = np.ones(len(joined), bool)
            keep[at[1:] - 1] = False
            joined[keep] = raw[ends[i] : ends[j]]
            h, s = word_hashes(joined)
            cut = np.searchsorted(s, at)
            for k in range(j - i):
                yield h[cut[k] : cut[k + 1]] if valid[i + k] else np.zeros(0, np.uint64)
        i = j
