"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Vectors are scaled to int8, each with its own scale and the exact length of its rounding error. Queries are cut into strips, candidates into
parts, both by bytes (STRIP_BYTES, PART_BYTES; more parts where the cluster has more cores than that). A task has one strip and one part:
it holds the strip and streams the part's blocks by it, so a task's memory is a strip and a block, whatever the tables' size. A candidate travels
once a strip and a query once a part; vectors that are whole in single precision travel so. The int8 products (taken in float32 blocks, which
hold them exactly) give each distance up to the sum of the two error lengths. In a tile, a candidate survives if its lower bound exceeds neither
the k-th least upper bound of distinct ids nor the k-th exact distance of the query's heap nor the least upper bound of its own id; survivors
are recomputed from the original vectors in double precision. Each task keeps a heap of k for each query over all its blocks; the heaps' rows
are merged by rank. Nothing is dropped: the bounds are proven, so the result is exact.

Defined results: vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows with a null
id or a length other than most queries' (the query tile's). Rows that repeat an id are one candidate, at its least distance;
a repeated query id is one query (its first vector in order of the components). Ties go to the smaller id. Fewer than k
candidates give all. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
#: Queries and candidates that are multiplied at a time, and the bytes that a block of candidates may have.
AT_A_TIME, TILE, BLOCK_BYTES = 512, 4096, 4 << 20
#: Bytes (in double precision) of the queries that a task holds, and of the candidates that it streams.
STRIP_BYTES, PART_BYTES = 32 << 20, 256 << 20


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, vec array<double>) of the rows that take part."""
    v = F.col("vec")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine)


class Tile:
    """Vectors in double precision with their int8 form: x = scale * q + error, and the error's length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.scale = np.abs(x).max(axis=1) / 127 if len(x) else np.zeros(0)
        self.scale[self.scale == 0] = 1  # scales under the least double
        self.q = np.rint(x / self.scale[:, None]).clip(-127, 127).astype(np.int8)
        back = self.q * self.scale[:, None]
        self.error = np.sqrt(((x - back) ** 2).sum(axis=1)) * (1 + 1e-9)
        self.norm = (back**2).sum(axis=1)
        self.wide = self.q.astype(np.float32)  # sums of int8 products stay under 2**24 up to 1040 dimensions a block

    def approximate(self, other: Tile) -> np.ndarray:
        """Distances between the int8 forms."""
        d = self.x.shape[1]
        dot = np.zeros((len(self.ids), len(other.ids)))
        for a in range(0, d, 1024):
            dot += self.wide[:, a : a + 1024] @ other.wide[:, a : a + 1024].T
        dot *= self.scale[:, None] * other.scale
        sq = self.norm[:, None] + other.norm - 2 * dot
        return np.sqrt(np.maximum(sq, 0))


def nearest(queries: Tile, tile: Tile, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, exact distance) of a tile's candidates that may be among the k nearest, none of them surely beyond ``within``."""
    far = queries.approximate(tile)
    slack = queries.error[:, None] + tile.error
    # the square root turns rounding near zero into about 1e-8 of the lengths
    slack += 1e-7 * (np.sqrt(queries.norm)[:, None] + np.sqrt(tile.norm))
    own = queries.ids[:, None] == tile.ids
    high = np.where(own | ~(far + slack < np.inf), np.inf, far + slack)  # squares that overflow bound nothing
    low, fits = far - slack, ~own
    if within is not None:
        fits &= ~(low > within[:, None])
    vecs, of = np.unique(tile.ids, return_inverse=True)
    if len(vecs) < len(tile.ids):  # rows that repeat an id are one candidate
        order = np.argsort(of, kind="stable")
        high = np.minimum.reduceat(high[:, order], np.searchsorted(of[order], np.arange(len(vecs))), axis=1)
        fits &= ~(low > high[:, of])
    if len(vecs) > k:
        kth = np.partition(high, k - 1, axis=1)[:, k - 1]
        fits &= ~(low > kth[:, None])
    at, to = np.nonzero(fits)
    exact = np.empty(len(at))
    for a in range(0, len(at), 65536):
        i, j = at[a : a + 65536], to[a : a + 65536]
        gap = queries.x[i] - tile.x[j]
        total = np.zeros(len(i))
        for c in range(gap.shape[1]):  # component by component, so that every plan adds in the same order
            total += gap[:, c] * gap[:, c]
        exact[a : a + 65536] = np.sqrt(total)
    return at, to, exact


def _best(query, vec, score, k):
    """The k nearest of each query, each id once."""
    order = np.lexsort((score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    once = np.concatenate([[True], (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])])[: len(query)]
    query, vec, score = query[once], vec[once], score[once]
    order = np.lexsort((vec, score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = rank < k
    return query[keep], vec[keep], score[keep]


def _dimensions(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _blocks(n_parts: int | None):
    """Rows of (strip, id, vector), or of (id, vector) dealt in turn to the parts, to blocks of ids and vectors as bytes."""
    shape = pa.schema([("at", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(), batch.column("vec")
            strip = np.zeros(len(ids), np.int32) if n_parts else batch.column("strip").to_numpy()
            dims, flat, offs = _dimensions(column), column.values.to_numpy(), column.offsets.to_numpy()
            for n, d in sorted(set(zip(strip.tolist(), dims.tolist(), strict=True))):
                rows = np.flatnonzero((strip == n) & (dims == d))
                step = max(1, min(TILE if n_parts else AT_A_TIME, BLOCK_BYTES // (8 * d)))
                for a in range(0, len(rows), step):
                    some, turn = rows[a : a + step], turn + 1
                    x = flat[offs[some][:, None] + np.arange(d)]
                    with np.errstate(over="ignore"):
                        single = x.astype(np.float32)
                    cell = turn % n_parts if n_parts else n
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([d], pa.int32()), pa.array([ids[some].tobytes()], pa.binary()), pa.array([(single if (single == x).all() else x).tobytes()], pa.binary())], schema=shape)

    return run


def _tile(ids: bytes, vecs: bytes, d: int) -> Tile:
    ids = np.frombuffer(ids, np.int64)
    x = np.frombuffer(vecs, np.float32 if len(vecs) == 4 * d * len(ids) else np.float64)
    return Tile(ids, x.reshape(-1, d).astype(np.float64))


def _reach(queries: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The k-th exact distance of each query so far, infinite where fewer are held; queries ascend, and held rows go by query and rank."""
    found = np.full(len(queries), np.inf)
    n = np.bincount(np.searchsorted(queries, held[0]), minlength=len(queries))
    full = n == k
    found[full] = held[2][np.cumsum(n)[full] - 1]
    return found


def _meet(k: int):
    """A cell's blocks, the queries' first, to the k nearest of each query among the cell's candidates."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip: dict[int, list[Tile]] = {}
        heaps: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                is_query, d, ids, vecs = (batch.column(c)[i].as_py() for c in ("is_query", "dim", "ids", "vecs"))
                tile = _tile(ids, vecs, d)
                if is_query:
                    order = np.argsort(tile.ids)
                    strip.setdefault(d, []).append(Tile(tile.ids[order], tile.x[order]))
                    continue
                for n, some in enumerate(strip.get(d, [])):
                    held = heaps.get((d, n))
                    at, to, score = nearest(some, tile, k, _reach(some.ids, held, k) if held else None)
                    new = [some.ids[at], tile.ids[to], score]
                    if held:
                        new = [np.concatenate(x) for x in zip(held, new, strict=True)]
                    heaps[d, n] = _best(*new, k)
        for q, v, s in heaps.values():
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], schema=schema)

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", strip_bytes: int = STRIP_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest candidates but its own id."""
    spark = candidates.sparkSession
    q = usable(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n_queries, components = q.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    n_strips = max(1, -(-8 * components // strip_bytes))
    candidate_bytes = candidates.count() * 8 * components // max(1, n_queries)
    n_parts = max(1, -(-candidate_bytes // part_bytes), -(-spark.sparkContext.defaultParallelism // n_strips))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shape = "at int, dim int, ids binary, vecs binary"
    strips = q.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_strips)).cast("int").alias("strip"), "vec_id", "vec").repartition("strip").mapInArrow(_blocks(None), shape)
    parts = usable(candidates, id_col, vec_col).mapInArrow(_blocks(n_parts), shape)
    cell = lambda rows, strip, part, is_query: rows.withColumn("other", every(n_parts if is_query else n_strips)).select((strip * n_parts + part).alias("cell"), F.lit(is_query).alias("is_query"), "dim", "ids", "vecs")
    both = cell(strips, F.col("at"), F.col("other"), True).unionAll(cell(parts, F.col("other"), F.col("at"), False))
    met = both.repartitionById(n_strips * n_parts, F.col("cell")).sortWithinPartitions(F.desc("is_query")).select("is_query", "dim", "ids", "vecs")
    found = met.mapInArrow(_meet(k), "query_id long, vec_id long, score double").repartition("query_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's queries (vec_id divisible by 100) against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows.where("vec_id % 100 = 0"), rows)


SQL = """
with v as (select vec_id, cast(embedding as double[]) as x from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])))) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score, vec_id) as rank from p)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10
"""
