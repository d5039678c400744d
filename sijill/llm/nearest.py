"""Approximate nearest neighbours: score-aware (anisotropic) quantisation, four-bit table scans, exact reranking.

Euclidean nearness to a query q ranks like the inner product q.x - |x|^2 / 2, with vectors centred first. Each
vector is quantised in subspaces of a few dimensions with 16 centres, four bits each. The quantisation loss
weighs the residual's part parallel to the vector more than the rest, as that part moves large inner products;
centres and codes are fitted by coordinate descent under it. A scan looks a block's codes up in a query's
tables of 16 products a subspace (two subspaces share a byte, so a table of 256 sums); the best candidates of each
query in the block are reranked by the exact distance of the original vectors, and the block's k nearest go on. So the
number of candidates follows the number of vectors, and a neighbour is lost only to the rows of its own block.

The centres are fitted on the SAMPLE vectors of smallest hash, every vector is indexed, and every query is
scanned against every block. Blocks have a bounded number of rows on both sides.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part; equally near vectors stand by id; a query has fewer neighbours than k only if there
are fewer candidates; rows that share an id are rows: each is a candidate of the others, and each that asks has its own
answers; an empty table gives an empty result; other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, map_arrow, table, written

SAMPLE, CENTRES, SUBSPACE = 8192, 16, 2
BLOCK, QUERY_BLOCK = 8192, 512
#: Share of a vector's length from which on an inner product counts as large; gives the weight of the parallel residual.
SCORE_THRESHOLD = 0.2


@dataclass(frozen=True)
class Quantiser:
    mean: np.ndarray  # (d,)
    centres: np.ndarray  # (subspaces, 16, SUBSPACE); the last subspace is padded with zeros
    weight: float  # of the parallel residual, beyond that of the rest

    def split(self, vectors: np.ndarray) -> np.ndarray:
        """(n, subspaces, SUBSPACE) of vectors."""
        subspaces = len(self.centres)
        out = np.zeros((len(vectors), subspaces * SUBSPACE), np.float32)
        out[:, : vectors.shape[1]] = vectors
        return out.reshape(len(vectors), subspaces, SUBSPACE)

    def encode(self, vectors: np.ndarray, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors (n, subspaces), and half their squared lengths, both after centring."""
        centred = vectors.astype(np.float32) - self.mean
        return assigned(self.split(centred), self.centres, self.weight, passes), (centred.astype(np.float64) ** 2).sum(axis=1).astype(np.float32) / 2


def assigned(x: np.ndarray, centres: np.ndarray, weight: float, passes: int) -> np.ndarray:
    """Codes of least anisotropic loss by coordinate descent, from the nearest centres."""
    length = np.sqrt((x * x).sum(axis=(1, 2)))
    unit = x / np.maximum(length, 1e-12)[:, None, None]
    codes = np.stack([((x[:, m, None] - centres[m]) ** 2).sum(axis=2).argmin(axis=1) for m in range(x.shape[1])], axis=1)
    rows = np.arange(len(x))
    along = np.stack([((x[:, m] - centres[m][codes[:, m]]) * unit[:, m]).sum(axis=1) for m in range(x.shape[1])], axis=1)
    total = along.sum(axis=1)
    for _ in range(passes):
        for m in range(x.shape[1]):
            residual = x[:, m, None] - centres[m]
            own = (residual * unit[:, m, None]).sum(axis=2)
            loss = (residual**2).sum(axis=2) + weight * (total[:, None] - along[:, m, None] + own) ** 2
            codes[:, m] = loss.argmin(axis=1)
            total += own[rows, codes[:, m]] - along[:, m]
            along[:, m] = own[rows, codes[:, m]]
    return codes.astype(np.uint8)


def fit(sample: np.ndarray, rounds: int = 6, seed: int = 11) -> Quantiser:
    """Fits the centres on a bounded sample, on the driver."""
    n, d = sample.shape
    mean = sample.mean(axis=0, dtype=np.float64).astype(np.float32)
    subspaces = math.ceil(d / SUBSPACE)
    subspaces += subspaces % 2  # two share a byte
    weight = max(0.0, (d - 1) * SCORE_THRESHOLD**2 / (1 - SCORE_THRESHOLD**2) - 1)
    made = Quantiser(mean, np.zeros((subspaces, CENTRES, SUBSPACE), np.float32), weight)
    x = made.split(sample.astype(np.float32) - mean)
    rng = np.random.default_rng(seed)
    centres = np.stack([x[rng.choice(n, CENTRES, replace=n < CENTRES), m] for m in range(subspaces)])
    length = np.sqrt((x * x).sum(axis=(1, 2)))
    unit = (x / np.maximum(length, 1e-12)[:, None, None]).astype(np.float64)
    for step in range(rounds + 4):
        w = 0.0 if step < 4 else weight  # plain centres first
        codes = assigned(x, centres, w, 1 if w else 0)
        along = np.stack([((x[:, m] - centres[m][codes[:, m]]) * unit[:, m]).sum(axis=1) for m in range(subspaces)], axis=1)
        for m in range(subspaces):
            others = along.sum(axis=1) - along[:, m]
            for c in range(CENTRES):
                own = codes[:, m] == c
                if not own.any():
                    continue
                u, v = unit[own, m], x[own, m].astype(np.float64)
                # Least squares for the centre: sum (I + w u u') c = sum (v + w u (u.v + others)).
                left = own.sum() * np.eye(SUBSPACE) + w * u.T @ u
                right = v.sum(axis=0) + w * (u * ((u * v).sum(axis=1) + others[own])[:, None]).sum(axis=0)
                centres[m, c] = np.linalg.solve(left, right)
            along[:, m] = ((x[:, m] - centres[m][codes[:, m]]) * unit[:, m]).sum(axis=1)
    return Quantiser(mean, centres.astype(np.float32), weight)


def scan(quantiser: Quantiser, packed: np.ndarray, half: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Estimated q.x - |x|^2 / 2 of each query and each packed row."""
    q = quantiser.split(queries.astype(np.float32) - quantiser.mean)
    tables = np.einsum("qms,mcs->mqc", q, quantiser.centres)  # (subspaces, queries, 16)
    scores = np.repeat(-half[None, :], len(queries), axis=0)
    for byte in range(packed.shape[1]):
        sums = (tables[2 * byte][:, :, None] + tables[2 * byte + 1][:, None, :]).reshape(len(queries), 256)
        scores += sums[:, packed[:, byte]]
    return scores


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _floats(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def block_nearest(ids: np.ndarray, rows: np.ndarray, estimates: np.ndarray, exact: np.ndarray, query_row: int, query: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest of a block's `rerank` best estimates."""
    own = np.where(rows == query_row, -np.inf, estimates)
    most = len(own) - rerank
    near = np.flatnonzero(own >= np.partition(own, most)[most]) if most > 0 else np.arange(len(own))
    near = near[np.lexsort((ids[near], -own[near]))][:rerank]
    near = near[own[near] > -np.inf]
    far = np.sqrt(np.cumsum((exact[near].astype(np.float64) - query) ** 2, axis=1)[:, -1])
    first = np.lexsort((ids[near], far))[:k]
    return ids[near][first], far[first]


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, rerank: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query among all other vectors. rerank: candidates of a query in each block."""
    rerank = max(rerank, k)
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(valid(F.col("v")), F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], result)
    d = usual["d"]
    rows = rows.where(F.size("v") == d)
    sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    quantiser = fit(_floats(sample.column("v").combine_chunks(), d))

    packed_as = np.float32 if vectors.schema[vector].dataType.elementType == T.FloatType() else np.float64

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                exact = _floats(part.column(2), d)
                codes, half = quantiser.encode(exact)
                packed = codes[:, 0::2] * CENTRES + codes[:, 1::2]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (part.column(0).to_numpy(), part.column(1).to_numpy(), packed, half, exact.astype(packed_as))], names=["rows", "ids", "codes", "half", "exact"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = [batch.column(c)[row].as_py() for c in range(5)]
                numbers, ids, half = np.frombuffer(held[0], np.int64), np.frombuffer(held[1], np.int64), np.frombuffer(held[3], np.float32)
                packed = np.frombuffer(held[2], np.uint8).reshape(len(ids), -1)
                exact = np.frombuffer(held[4], packed_as).reshape(len(ids), d)
                asked = batch.column(5)[row].values
                query_rows, query_ids, wanted = asked.field("row").to_numpy(), asked.field("vec_id").to_numpy(), _floats(asked.field("v"), d)
                found = [block_nearest(ids, numbers, own, exact, query_rows[q], wanted[q], k, rerank) for q, own in enumerate(scan(quantiser, packed, half, wanted))]
                times = [len(near) for near, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_rows, times)), pa.array(np.repeat(query_ids, times)), *(pa.array(np.concatenate(x)) for x in zip(*found))], names=["row", "query_id", "vec_id", "score"])

    rows = written(rows, "vectors")
    queries = rows.where("is_query").select("row", "vec_id", "v")
    n_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    # Each block of vectors meets each block of queries. Both are bounded, and so are their copies' numbers.
    blocks = map_arrow(rows.select("row", "vec_id", "v"), index, "rows binary, ids binary, codes binary, half binary, exact binary").withColumn("asked_by", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = queries.groupBy(F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("asked_by")).agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("queries"))
    asked = broadcast_if_small(written(asked, "asked"), F.size("queries") * (8 * d + 16))
    met = blocks.join(asked, "asked_by").select("rows", "ids", "codes", "half", "exact", "queries")
    measured = map_arrow(met, best, "row long, query_id long, vec_id long, score double")
    rank = Window.partitionBy("row").orderBy("score", "vec_id")
    return measured.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)
