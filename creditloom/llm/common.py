"""Helpers that the corpus operators share: words of an Arrow column, ragged gathers, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from creditloom.session import fresh_path

#: Links that one task joins by itself.
CHUNK = 1 << 20


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later reads neither recompute it nor depend on one executor.

    Copies of whole texts and token ids are written with ``zstd``, about a quarter smaller than the session's default.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> Iterator[None]:
    """Python workers get at most so many rows or bytes at once while the block runs; for writes that carry whole rows past a worker."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def partitions_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@dataclass
class Words:
    """Words of a batch of texts. ``codes[ends[i-1]:ends[i]]`` are the words of text i as rows of ``vocabulary``."""

    codes: np.ndarray
    counts: np.ndarray
    vocabulary: pa.Array

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.counts)

    @property
    def starts(self) -> np.ndarray:
        return self.ends - self.counts

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words_of(texts: pa.Array) -> Words:
    """Maximal runs of characters other than space and \\x09-\\x0D, coded over the batch. Null texts have no words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = parts.offsets.to_numpy()
    flat = parts.values
    full = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), np.diff(seen[ends]).astype(np.int64), coded.dictionary)


def slices(texts: pa.Array, limit: int = 6 << 20) -> Iterator[slice]:
    """Consecutive row ranges with at most ``limit`` bytes of text each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    done = 0
    while done < len(texts):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + limit, side="right")))
        yield slice(done, upto)
        done = upto


def trim() -> None:
    """Hand memory that is free again back to the system: workers live as long as their executor, and allocators keep what one slice needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_slices(texts: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``work`` over the slices of a batch, put together again."""
    out = []
    for part in slices(texts):
        out.append(work(texts[part]))
        trim()
    return pa.concat_arrays(out) if out else work(texts)


def per_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over consecutive runs of ``counts`` entries; 0 for an empty run."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)]) if values.dtype.kind != "f" else None
    ends = np.cumsum(counts)
    if total is not None:
        return total[ends] - total[ends - counts]
    out = np.zeros(len(counts))
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (ends - counts)[full])
    return out


def gather(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions into a flat array for the ragged rows ``codes``, one after the other."""
    n = lengths[codes]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - n), n)


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: str, salts: int = 32) -> DataFrame:
    """Left join of ``rows`` with a ``table`` that has one row for each ``key``. Rows of one key are spread over ``salts`` parts by ``spread``."""
    held = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(held, [key, "_salt"], "left").drop("_salt")


def with_minimum(pairs: DataFrame, key: str, value: str, low: str = "low", least_rows: int = 1) -> DataFrame:
    """``pairs`` with the smallest ``value`` of each ``key`` as column ``low``; keys of fewer than ``least_rows`` rows go.

    Minima are combined before the shuffle. The join that hands them back has one row for each key on one side, so the adaptive
    skew join splits a key that has many pairs.
    """
    least = pairs.groupBy(key).agg(F.min(value).alias(low), F.count("*").alias("_n")).where(F.col("_n") >= least_rows).drop("_n")
    return pairs.join(least, key)


def running_start(rows: DataFrame, order: list[str], weight: str, start: str = "start") -> DataFrame:
    """``rows`` with the sum of ``weight`` over all rows before, in the order of the columns ``order`` (together unique; nulls last).

    Rows are dealt out by range and summed within each part; only one total for each part goes to the driver.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in order]
    dealt = stored(rows.repartitionByRange(partitions_of(spark), *keys).withColumn("_part", F.spark_partition_id()), "dealt")
    before, total = [], 0
    for part, own in sorted(tuple(r) for r in dealt.groupBy("_part").agg(F.sum(weight)).collect()):
        before.append((part, total))
        total += own
    window = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # an Arrow table, unlike a list of rows, needs no Python workers of its own on the executors
    starts = spark.createDataFrame(pa.table({"_part": pa.array([p for p, _ in before], pa.int32()), "_before": pa.array([n for _, n in before], pa.int64())}))
    summed = dealt.withColumn("_own", F.coalesce(F.sum(weight).over(window), F.lit(0)))
    return summed.join(F.broadcast(starts), "_part").withColumn(start, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def components(vertices: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each vertex. ``vertices(id)``, ``links(a, b)`` of one ordered type -> ``(id, component_id)``.

    Each task joins up to ``CHUNK`` links by itself and puts stars in their place; large-star and small-star steps, each an aggregate and a join on ids, join what
    lies in different tasks. In turn, until every id has one link at most and hangs on an id that has none. Links are rewritten to the shared folder after every step.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        links = stored(_contracted(links), "links")
        if _settled(links):
            break
        links = stored(_small_star(_large_star(links)), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.groupBy("a").agg(F.min("b").alias("root"))
    return vertices.join(roots, vertices["id"] == roots["a"], "left").select("id", F.coalesce("root", "id").alias("component_id"))


def _contracted(links: DataFrame) -> DataFrame:
    """Links that join the same ids: within each task's share of them, every id hangs on the smallest one that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while (above := up.get(x, x)) != x:
                up[x] = up.get(above, above)
                x = above
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        ids = list(up)
        for k in range(0, len(ids), 1 << 16):
            part = ids[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([top(x) for x in part], kind)], names=["a", "b"])

    kind = to_arrow_type(links.schema["a"].dataType)
    return links.coalesce(max(1, -(-links.count() // CHUNK))).mapInArrow(run, links.schema)


def _settled(links: DataFrame) -> bool:
    """True if the links are stars: no id with two links, none that has a link and is linked to."""
    ends = links.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR up = 1 AND down = 1").limit(1).isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = with_minimum(both, "u", "v").select("u", "v", F.least("low", "u").alias("low"))
    return low.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = with_minimum(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "u", "v")
    return low.select("low", F.explode(F.array("u", "v")).alias("a")).where("a <> low").select("a", F.col("low").alias("b")).distinct()
