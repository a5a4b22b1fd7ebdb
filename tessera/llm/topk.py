"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integers floor(1024 * x). Documents are dealt into shards of about SHARD_ROWS; a shard
orders its documents by nearest pivot and cuts them into ranges (blocks) that keep, as block forward
index, their rows and the largest and smallest value of each dimension. For a query a block's bound is
the sum over dimensions of the larger of q * max and q * min. A pair (query block, shard) visits each
query's blocks by falling bound and stops at the first below its kth score.

Queries are dealt into blocks of QUERY_ROWS; each query block meets each shard in a row of its own (both
sides repeated by the other's number and joined on both numbers), so no task holds all of either. A
first round over one shard a query block gives every query a kth score from which the others prune.

Defined cases: vectors that are null, or hold null or non-finite components, or have a null id, take no
part; a missing component (shorter vector) counts as 0; ties go to the smaller vec_id; rows of equal
vec_id are each candidates of one another; fewer than k candidates give all; no queries, no rows; extra
columns are not read. Products beyond 2**53 are summed in 64-bit integers, which wrap.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize

SHARD_ROWS = 2048
QUERY_ROWS = 2048
BLOCK_ROWS = 128
NONE = np.iinfo(np.int64).min


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(blob)))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of integers, padded with 0 to the longest."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.slice(vectors.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


#: Shards whose block extremes travel together.
EDGE_SHARDS = 256


def build_shard(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, block_rows: int = BLOCK_ROWS) -> bytes:
    """The forward index of one shard: documents in pivot order, block by block, with extremes per dimension."""
    order = np.lexsort((rows, ids))
    ids, rows, x = ids[order], rows[order], x[order]
    pivots = x[:: max(1, len(x) // 32)][:32].astype(np.float64)
    near = (x.astype(np.float64) @ pivots.T - (pivots**2).sum(axis=1) / 2).argmax(axis=1) if x.shape[1] else np.zeros(len(x))
    order = np.argsort(near, kind="stable")
    ids, rows, x = ids[order], rows[order], x[order]
    first = np.arange(0, len(x), block_rows)
    return _pack(ids=ids, rows=rows, x=x, first=first, high=np.maximum.reduceat(x, first, axis=0), low=np.minimum.reduceat(x, first, axis=0))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    big = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return a @ b.T if big >= 2**53 else (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def search_pair(query: dict, shard: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ids and scores (NONE: no more) of each query within one shard, from the kth scores in `query`."""
    d = min(query["x"].shape[1], shard["x"].shape[1])
    q = query["x"][:, :d]
    first, x = shard["first"], shard["x"][:, :d]
    last = np.append(first[1:], len(x))
    bound = _product(np.maximum(q, 0), shard["high"][:, :d]) + _product(np.minimum(q, 0), shard["low"][:, :d])
    order = np.argsort(-bound, axis=1, kind="stable")
    scores = np.full((len(q), k), NONE, dtype=np.int64)
    ids = np.full((len(q), k), np.iinfo(np.int64).max, dtype=np.int64)
    for place in range(len(first)):
        block = order[:, place]
        kth = np.maximum(scores[:, -1], query["kth"])
        live = np.flatnonzero(bound[np.arange(len(q)), block] >= kth)
        if not len(live):
            break
        for b in np.unique(block[live]):
            some = live[block[live] == b]
            at = slice(first[b], last[b])
            s = _product(q[some], x[at])
            s[shard["rows"][at][None, :] == query["rows"][some][:, None]] = NONE
            s = np.concatenate((scores[some], s), axis=1)
            i = np.concatenate((ids[some], np.broadcast_to(shard["ids"][at], (len(some), last[b] - first[b]))), axis=1)
            i = np.where(s == NONE, np.iinfo(np.int64).max, i)
            best = np.lexsort((i, np.where(s == NONE, np.iinfo(np.int64).max, -s)), axis=-1)[:, :k]
            scores[some], ids[some] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
    scores[scores < query["kth"][:, None]] = NONE
    return ids, scores


def _packed(vectors: DataFrame, number: Column, make) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _matrix(table.column("x").chunk(0))
        blob = make(table.column("vec_id").to_numpy(), table.column("row").to_numpy(), x)
        return pa.table({"part": table.column("part").slice(0, 1), "blob": pa.array([blob], pa.binary())})

    return vectors.withColumn("part", number).groupBy("part").applyInArrow(run, "part int, blob binary")


def _pairs(pairs: DataFrame, k: int) -> DataFrame:
    """query row, query_id, vec_id, score of the best of each pair."""

    def run(batches):
        for batch in batches:
            for q_blob, s_blob in zip(batch.column(0), batch.column(1)):
                query, shard = _unpack(q_blob.as_py()), _unpack(s_blob.as_py())
                ids, scores = search_pair(query, shard, k)
                at = np.nonzero(scores != NONE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query["rows"][at[0]]), pa.array(query["ids"][at[0]]), pa.array(ids[at]), pa.array(scores[at])], names=["row", "query_id", "vec_id", "score"]
                )

    return pairs.select("query", "shard").mapInArrow(run, "row bigint, query_id bigint, vec_id bigint, score bigint")


def _surviving(told: DataFrame, shards: DataFrame, n_queries: int, n_shards: int) -> DataFrame:
    """b, s: the pairs of query blocks and shards (but the home ones) of which some block of rows may reach a query's kth score.

    Only the shards' block extremes travel to all query blocks, EDGE_SHARDS shards a pack; whole shards follow where they survive.
    """

    def edges(batches):
        for batch in batches:
            held = [_unpack(b) for b in batch.column(1).to_pylist()]
            blobs = [_pack(high=h["high"], low=h["low"]) for h in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["s", "edge"])

    edge = shards.select("part", "blob").mapInArrow(edges, "s int, edge binary").withColumn("pack", F.floor(F.col("s") / EDGE_SHARDS).cast("int"))
    packs = materialize(edge.groupBy("pack").agg(F.collect_list(F.struct("s", "edge")).alias("edges")))  # EDGE_SHARDS a row
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = told.select(F.col("part").alias("b"), F.col("blob").alias("query"), every(-(-n_shards // EDGE_SHARDS)).alias("pack"))
    met = left.join(packs.withColumn("b", every(n_queries)), ["b", "pack"])

    def run(batches):
        for batch in batches:
            found = []
            for b, blob, held in zip(*(batch.column(k).to_pylist() for k in range(3))):
                query = _unpack(blob)
                for item in held:
                    if item["s"] != b % n_shards:
                        e = _unpack(item["edge"])
                        d = min(query["x"].shape[1], e["high"].shape[1])
                        q = query["x"][:, :d]
                        bound = _product(np.maximum(q, 0), e["high"][:, :d]) + _product(np.minimum(q, 0), e["low"][:, :d])
                        if (bound >= query["kth"][:, None]).any():
                            found.append((b, item["s"]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)], names=["b", "s"])

    return met.select("b", "query", "edges").mapInArrow(run, "b int, s int")


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other rows. `is_query` is a column of vec_id."""
    spark = embeddings.sparkSession
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vectors = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    vectors = vectors.where(usable).select("vec_id", F.transform("embedding", lambda v: F.floor(v * 1024).cast("bigint")).alias("x"))
    vectors = materialize(vectors.withColumn("row", F.monotonically_increasing_id()))  # numbers the rows once
    queries = vectors.where(is_query)
    n_shards = max(1, -(-vectors.count() // SHARD_ROWS))
    n_queries = max(1, -(-queries.count() // QUERY_ROWS))
    deal = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    shards = materialize(_packed(vectors, deal(n_shards, 1), build_shard))
    blocks = materialize(_packed(queries, deal(n_queries, 2), lambda ids, rows, x: _pack(ids=ids, rows=rows, x=x, kth=np.full(len(ids), NONE, dtype=np.int64))))

    homes = blocks.select((F.col("part") % n_shards).alias("s"), F.col("blob").alias("query"))
    first = materialize(_pairs(homes.join(shards.select(F.col("part").alias("s"), F.col("blob").alias("shard")), "s"), k))  # one shard each: a kth score to beat
    kth = _best(first, k).where(F.col("rank") == k).select("row", F.col("score").alias("kth"))
    kth = kth.withColumn("part", deal(n_queries, 2)).groupBy("part").agg(F.collect_list(F.struct("row", "kth")).alias("known"))

    def informed(batches):
        for batch in batches:
            parts, blobs = [], []
            for part, blob, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                query = _unpack(blob)
                at = {r: j for j, r in enumerate(query["rows"].tolist())}
                for item in known or []:
                    query["kth"][at[item["row"]]] = item["kth"]
                parts.append(part)
                blobs.append(_pack(**query))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    told = materialize(blocks.join(kth, "part", "left").select("part", "blob", "known").mapInArrow(informed, "part int, blob binary"))
    pairs = materialize(_surviving(told, shards, n_queries, n_shards))
    query = told.select(F.col("part").alias("b"), F.col("blob").alias("query"))
    shard = shards.select(F.col("part").alias("s"), F.col("blob").alias("shard"))
    found = first.unionByName(_pairs(pairs.join(query, "b").join(shard, "s"), k))
    return _best(found, k).select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
