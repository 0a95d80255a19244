"""What several operators need: shared staging tables and reading of the input tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylattice.operators.staging import Scratch, fresh_path, lookup, shared_dir, staged  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add; the operator's own columns win over a clashing extra one."""
    return df.drop(*[c for c in df.columns if c in names])


def free_name(df: DataFrame, name: str) -> str:
    """name, or as many underscores before it as keep it apart from df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_text(column: str = "text") -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(F.col(column), F.lit(""))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it holds, Arrow batches have so many rows at most: long texts and sets else make batches of many megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of an Arrow batch where whole texts go to Python.
TEXT_ROWS = 500


def short_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches, unless they are shorter already, to TEXT_ROWS rows: plans that send whole texts to Python
    run after their operator has returned, and 10,000 long texts at once would fill an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


#: Bits of a sieve, 16 MB, at any size of the input.
SIEVE_BITS = 27


def sieve(keys: DataFrame) -> Callable[..., Column]:
    """A Bloom filter of the rows of keys: a function of columns that is true for all these rows and for few others.

    It keeps rows that have no partner from being shuffled to a join. Its size is fixed; the fuller it is, the more rows pass
    in vain, from one in a thousand at two million keys to all at billions: the join's result never depends on it."""
    spark = keys.sparkSession
    low = (1 << SIEVE_BITS) - 1
    places = lambda h: F.array(h.bitwiseAND(F.lit(low)), F.shiftrightunsigned(h, SIEVE_BITS).bitwiseAND(F.lit(low)))
    bits = keys.select(F.explode(places(F.xxhash64(*keys.columns))).alias("p"))
    words = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        x, held = h.to_numpy().view(np.uint64), shared.value.view(np.uint64)
        found = np.ones(len(x), bool)
        for shift in (0, SIEVE_BITS):
            p = (x >> np.uint64(shift)) & np.uint64(low)
            found &= (held[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(found)

    return lambda *columns: maybe(F.xxhash64(*columns))


def positions(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """A written table of df's rows with their place (from 0) in the order of the columns `by`.

    Rows are dealt to ranges and sorted there; only one count for each range is put in order. `by` must tell rows apart, or
    rows that it does not may stand in any order; many rows that it does not tell apart share one range."""
    row = free_name(df, "row")
    cut = staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(row, F.monotonically_increasing_id()), "positions")
    part, low = F.shiftright(row, 33), F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    counts = cut.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as there are ranges.
    starts = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return cut.join(F.broadcast(starts.withColumnRenamed("part", "_part")), part == F.col("_part")).withColumn(column, F.col("start") + low).drop(row, "_part", "start")
