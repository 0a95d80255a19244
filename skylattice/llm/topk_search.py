"""Exact top-k search by inner product over tiles.

Components x become floor(1024 * x), integers, so scores are exact. Queries are dealt to tiles, candidates to shards. Each
shard streams through one task, its candidates first and then every tile of queries: one matrix product for each tile, of
which the k best of each query stay (partial selection). The lists are merged as a tree: first within groups of shards,
then over all.

Candidates are shuffled once, each query once for each shard, nothing is broadcast; a task holds one shard, one tile and
their product, and there are as many tasks as shards, however few the queries. Candidates are dealt by row, not by id, so
repeated ids and vectors spread. Queries and candidates only meet where their vectors have the same length.

Vectors that are null, empty, or hold null or non-finite components take no part, as query or candidate. Ties go to
the smaller id. Rows with equal ids are each their own candidate, but never one of the query with that id; query rows with one id
and different vectors share one list, in which a candidate stands once for each of them. Vectors may have any length, one row of
them is one value; other columns are ignored, whatever their names. A score must
fit a 64-bit integer; products whose exact sum could pass 2^53 are computed with Python's integers and clipped to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, staged

SCALE = 1024


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles where every partial sum stays below 2^53."""
    if not len(a) or not len(b) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], dtype=object) @ np.array([[int(x) for x in row] for row in b], dtype=object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best of one query: highest score, then smallest id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """A row for each group: ids and vectors, sorted by id so that reruns agree."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("rows")).select(*by, F.col("rows.id").alias("ids"), F.flatten("rows.vec").alias("vecs"))


def search(stream: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, dim, tile, ids, vecs) in this order; tile -1 stands for candidates, which come before the queries that meet them."""
    at, held, ids, vecs = None, [], np.empty(0, np.int64), np.empty((0, 0))
    for batch in stream:
        out = [[np.empty(0, np.int64)] for _ in range(4)]
        for i in range(batch.num_rows):
            shard, dim, tile = (batch.column(c)[i].as_py() for c in range(3))
            some, flat = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4))
            matrix = flat.reshape(len(some), dim)
            if tile < 0:
                held = [*held, (some, matrix)] if at == (shard, dim) else [(some, matrix)]
                at, ids = (shard, dim), None
                continue
            if at != (shard, dim):
                continue
            if ids is None:
                ids, vecs = np.concatenate([x for x, _ in held]), np.concatenate([m for _, m in held])
            for q, row in zip(some.tolist(), product(matrix, vecs)):
                others = ids != q
                own_ids, own = ids[others], row[others]
                top = best_of(own_ids, own, k)
                for column, values in zip(out, (np.full(len(top), q), np.full(len(top), shard), own_ids[top], own[top])):
                    column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["query_id", "shard", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, tile: int = 512, shard: int = 8192, fan_in: int = 32) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows other than itself."""
    spark = vectors.sparkSession
    x = F.col("vec")
    usable = F.coalesce(F.size(x) > 0, F.lit(False)) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (
        vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), is_query.alias("is_query"))
        .where(F.col("id").isNotNull() & usable)
        .select("id", F.size("vec").alias("dim"), F.transform("vec", lambda c: F.floor(c * SCALE).cast("double")).alias("vec"), "is_query")
    )
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1))).first()
    n_tiles, n_shards, n_blocks = max(1, -(-n_queries // tile)), max(1, -(-n // shard)), max(1, -(-shard // tile))
    row = F.monotonically_increasing_id()
    placed = rows.withColumn("row", row).withColumns({"shard": F.pmod(F.xxhash64("row"), F.lit(n_shards)), "block": F.pmod(F.xxhash64("row", F.lit("block")), F.lit(n_blocks))})
    candidates = packed(placed, ["shard", "dim", "block"]).withColumn("tile", F.lit(-1).cast("long"))
    queries = rows.where("is_query").dropDuplicates(["id", "dim", "vec"]).withColumn("tile", F.pmod(F.xxhash64("id", "vec"), F.lit(n_tiles)))
    queries = packed(queries, ["dim", "tile"]).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    columns = ["shard", "dim", "tile", "ids", "vecs"]
    stream = candidates.select(columns).unionByName(queries.select(columns)).repartition(n_shards, "shard").sortWithinPartitions("shard", "dim", "tile")
    # A row is a tile: some to a batch, not thousands.
    with arrow_rows(spark, 16):
        lists = staged(stream.mapInArrow(lambda batches: search(batches, k), "query_id long, shard long, vec_id long, score long"), "top-lists")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    groups = max(1, -(-n_shards // fan_in))
    merged = lists.withColumn("part", F.pmod("shard", F.lit(groups))).withColumn("rank", best("query_id", "part")).where(F.col("rank") <= k)
    return merged.withColumn("rank", best("query_id")).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from scored)
select query_id, rank::int rank, vec_id, score from ranked where rank <= 10
"""
