"""Exact top-k by inner product over a vector-approximation file.

Vectors are stored twice: exactly, and as a file of cell codes, a byte a dimension. A query scans the codes alone: one
product of small integers bounds every score from below and above. Vectors whose upper bound is under the k-th best lower
bound are out; of the few others the exact vectors are read, in the order of their bounds, until the k-th score is certain.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, materialise, merge_join, table

CELLS = 256
#: Rows of a block of codes and of queries: a task holds one of each, and bounds STEP queries at a time.
VECTOR_BLOCK, QUERY_BLOCK, STEP = 16_384, 4096, 256
#: Vectors on which the cells are fitted. Any cells give right bounds; all vectors are coded.
SAMPLE = 4096
#: Share of the sample that lies below the first cell, and above the last.
TAIL = 0.005
K = 5
QUERY_STEP = 50
SCALE = 256
#: Products of larger integers could leave the range in which 64 bits are exact; they are summed as Python integers.
SAFE = 2**22


def usable(df: DataFrame) -> DataFrame:
    """vec_id, x (array<double>). Null vectors, those that hold null or non-finite components, and null ids take no part."""
    x = F.transform(F.col("embedding"), lambda a: a.cast("double"))
    whole = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    return whole.where(F.forall("x", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) as doubles, which are exact but where they overflow; shorter vectors are padded with zeros."""
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column):
        v = x.values.to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            out[i, : len(v)] = np.floor(SCALE * v)
    return out


def fit_cells(rows: DataFrame, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of the first cell and width of a cell, by dimension, from about SAMPLE vectors; no more reach the driver."""
    steps = 1 << 30
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(steps)) < int(min(1.0, SAMPLE / max(1, n)) * steps)).select("x").limit(2 * SAMPLE).toArrow()
    v = _matrix(some.column("x"), dim) if len(some) else np.zeros((1, dim))
    v = np.nan_to_num(v)
    low, high = np.quantile(v, TAIL, axis=0), np.quantile(v, 1 - TAIL, axis=0)
    room = np.maximum(0.1 * (high - low), 1.0)
    return low - room, (high - low + 2 * room) / CELLS


def coded(rows: DataFrame, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """rid, vec_id, code (a byte a dimension), excess: by how much the vector leaves its cells, summed over dimensions."""
    dim = len(low)

    def run(batches):
        for b in batches:
            v = _matrix(b.column(2), dim)
            with np.errstate(invalid="ignore"):
                codes = np.clip(np.nan_to_num(np.floor((v - low) / width)), 0, CELLS - 1)
                start = low + codes * width
                excess = np.nan_to_num((np.maximum(start - v, 0) + np.maximum(v - start - width, 0)).sum(axis=1), nan=np.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(excess)], ["rid", "vec_id", "code", "excess"])

    return rows.select("rid", "vec_id", "x").mapInArrow(run, "rid bigint, vec_id bigint, code binary, excess double")


def bounds(codes: np.ndarray, excess: np.ndarray, q: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """queries x vectors, below and above: no score lies outside. codes as doubles; one product serves both."""
    with np.errstate(invalid="ignore", over="ignore"):
        middle = (q * width) @ codes.T + (q @ low)[:, None]
        up, down = (np.maximum(q, 0) @ width)[:, None], (np.minimum(q, 0) @ width)[:, None]
        magnitude = np.abs(q) @ (np.abs(low) + CELLS * width)
        free = np.abs(q).max(axis=1, initial=0)[:, None] * np.where(excess > 0, excess, 0)[None, :]
        free = np.where((excess == 0)[None, :], 0.0, free) + 1e-9 * (magnitude[:, None] + free + 1)
        below, above = middle + down - free, middle + up + free
    return np.nan_to_num(below, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(above, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def survivors(t: pa.Table, low: np.ndarray, width: np.ndarray, k: int) -> list[pa.Table]:
    """Of a block of codes and one of queries: query_id, rid, vec_id, below, above of what the bounds leave."""
    asked = t.column("x").is_valid().to_numpy()
    at, of = np.flatnonzero(~asked), np.flatnonzero(asked)
    if not len(at) or not len(of):
        return []
    codes = np.frombuffer(b"".join(t.column("code").take(at).to_pylist()), np.uint8).reshape(len(at), -1).astype(np.float64)
    rid, ids, excess = (t.column(c).take(at).to_numpy() for c in ("rid", "vec_id", "excess"))
    qids, queries = t.column("vec_id").to_numpy()[of], _matrix(t.column("x").take(of), len(low))
    out = []
    for s in range(0, len(of), STEP):
        own = qids[s : s + STEP]
        below, above = bounds(codes, excess, queries[s : s + STEP], low, width)
        itself = own[:, None] == ids[None, :]
        below[itself], above[itself] = -np.inf, -np.inf
        least = np.partition(below, -k, axis=1)[:, -k] if len(at) >= k else np.full(len(own), -np.inf)
        i, j = np.nonzero((above >= least[:, None]) & ~itself)
        out.append(pa.table({"query_id": own[i], "rid": rid[j], "vec_id": ids[j], "below": below[i, j], "above": above[i, j]}))
    return out


def integers(x: list[float]) -> list[int]:
    return [math.floor(SCALE * a) if abs(a) < 1e300 else SCALE * int(a) for a in x]


def read_in_order(rows: list[tuple], q: list[float], k: int) -> list[tuple[int, int]]:
    """rows: above, vec_id, copies, x. (score, vec_id) of the k best, ties to the smaller id: exact vectors are read from the
    highest bound down, until the next bound is below the k-th score."""
    query = integers(q)
    safe = max(map(abs, query), default=0) < SAFE
    best: list[tuple[int, int]] = []
    for above, vec_id, copies, x in sorted(rows, key=lambda r: (-r[0], r[1])):
        if len(best) == k and above < -best[-1][0]:
            break  # certain
        v = integers(x)
        n = min(len(query), len(v))
        score = int(np.dot(query[:n], v[:n])) if n and safe and max(map(abs, v)) < SAFE else sum(a * b for a, b in zip(query, v, strict=False))
        best = sorted(best + [(-score, vec_id)] * min(k, copies))[:k]
    return [(-s, i) for s, i in best]


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by query_step its k best partners among all other
    rows, by integer inner product, ties to the smaller id.

    Vectors of other lengths count as padded with zeros, empty ones as zeros. Repeated ids: rows with the query's own id are
    no candidates; of rows that share another id each is a candidate, and a repeated query is answered once, by its least
    vector. Of equal vectors only the k + 1 smallest ids are searched, of which one may be the query's own: no other can be
    among the k best. Scores are ranked exactly; one beyond 64 bits is shown as the end of the range. Extra columns are not
    carried. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "top-k")
    rows = scratch.write(usable(vectors), "vectors")
    shape = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.count_if(F.pmod("vec_id", F.lit(query_step)) == 0)).first()
    n, dim, nq = shape[0], max(1, shape[1] or 0), shape[2]
    copies = rows.groupBy(F.xxhash64("x").alias("h"), "x", "vec_id").agg(F.count(F.lit(1)).alias("copies"))
    order = F.row_number().over(W.partitionBy("h", "x").orderBy("vec_id"))
    kept = copies.withColumn("order", order).where(F.col("order") <= k + 1)
    exact = scratch.write(kept.select(F.xxhash64("vec_id", "x").alias("rid"), "vec_id", F.least("copies", F.lit(k)).cast("int").alias("copies"), "x"), "exact")
    low, width = fit_cells(rows, n, dim)
    codes = scratch.write(coded(exact, low, width), "codes")
    queries = scratch.write(rows.where(F.pmod("vec_id", F.lit(query_step)) == 0).groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    nb, qb = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    # The stated query set against all rows, in blocks: codes go to each block of queries, never exact vectors.
    null = lambda kind: F.lit(None).cast(kind)
    left = codes.select("rid", "vec_id", "code", "excess", null("array<double>").alias("x"), F.pmod(F.xxhash64("rid"), F.lit(nb)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    right = queries.select(null("bigint").alias("rid"), "vec_id", null("binary").alias("code"), null("double").alias("excess"), "x", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("vb"), F.pmod(F.xxhash64("vec_id"), F.lit(qb)).cast("int").alias("qb"))
    found = pa.schema([("query_id", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("below", pa.float64()), ("above", pa.float64())])

    def scan(t: pa.Table) -> pa.Table:
        return pa.concat_tables([found.empty_table(), *(x.cast(found) for x in survivors(t, low, width, k))])

    left_over = scratch.write(left.unionByName(right).groupBy("vb", "qb").applyInArrow(scan, "query_id bigint, rid bigint, vec_id bigint, below double, above double"), "survivors")
    # The k-th best lower bound of all blocks, of which each task sends k rows a query.
    best = left_over.withColumn("order", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("below")))).where(F.col("order") <= k)
    least = scratch.write(best.groupBy("query_id").agg(F.min("below").alias("least"), F.count(F.lit(1)).alias("m")).where(F.col("m") == k).select("query_id", "least"), "least")
    certain = merge_join(left_over, least, "query_id", "left").where("least is null or above >= least").select("query_id", "rid", "vec_id", "above")
    read = merge_join(certain, exact, ["rid", "vec_id"])
    parts = max(1, -(-nq // STEP))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.lit(None).cast("bigint").alias("vec_id"), F.lit(0).alias("copies"), F.lit(0.0).alias("above"), "x")
    both = read.select("query_id", "vec_id", "copies", "above", "x").unionByName(asked).withColumn("part", part)

    def answer(t: pa.Table) -> pa.Table:
        of: dict[int, list[tuple]] = {}
        q: dict[int, list[float]] = {}
        for query_id, vec_id, copies, above, x in zip(*(t.column(c).to_pylist() for c in ("query_id", "vec_id", "copies", "above", "x")), strict=True):
            if vec_id is None:
                q[query_id] = x
            else:
                of.setdefault(query_id, []).append((above, vec_id, copies, x))
        top = 2**63 - 1
        out = [(query_id, i + 1, vec_id, max(-top - 1, min(top, s))) for query_id, rows in of.items() for i, (s, vec_id) in enumerate(read_in_order(rows, q[query_id], k))]
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64()
        return pa.table({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(zip(("query_id", "rank", "vec_id", "score"), kinds, strict=True))})

    out = materialise(both.groupBy("part").applyInArrow(answer, "query_id bigint, rank int, vec_id bigint, score bigint"), "top-k-answers")
    scratch.clear()
    return out


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with w as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
v as (select vec_id, list_resize(v, (select max(len(v)) from w), 0) v from w),
s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 5
"""
