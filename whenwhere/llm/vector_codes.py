"""Vector code compression: product codes by Lloyd rounds over resident members.

Components become integers, floor(4096 x); vectors are cut into equal parts, and each part position has a codebook. The parts live where
(position, entry, salt) puts them: a keyed partition holds the members of its entries as integer blocks. In a round each
owner finds its members' nearest entries; those that stay are not moved, those that change entry travel to their new owner in the one
shuffle of the round, under the same salt; then owners sum their members, and only these sums (entries times dimensions, whatever the number of rows)
meet on the driver, which makes the next codebook. Salts are dealt so that an owner has a bounded number of members even if all rows were in one
entry. The last assignment reads the rows again under the final codebooks, so members carry no ids and codes need no shuffle.

Members are a co-partitioned RDD: DataFrames cannot keep rows where they are and add arrivals. It is persisted on memory and
disk; a lost executor's members come back from the rows and the shuffles of at most CHECKPOINT_EVERY rounds, then from a checkpoint. All sums are of integers, so
the result does not depend on order or retries.

Defined results: a row whose vector is null or empty or holds null or non-finite components is dropped, and so is one with another length than most
rows' (ties: the longer). A length that is no multiple of the parts is cut at floor(i * length / parts). Components beyond a bound that keeps
sums of squares in a long (over 500,000 for 64 dimensions) are taken as the bound. Rows that share an id are rows of their own, in the order of their components where the first
entries are chosen; a null id comes after all others. Fewer rows than entries give as many entries as rows. An empty table gives no rows. Extra
columns are ignored, or kept if ``keep`` names them; those that clash with a result's name are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Members that an owner has at most if all rows are in one entry; bytes of members in a partition; rounds between checkpoints.
OWNER_ROWS, PARTITION_BYTES, CHECKPOINT_EVERY = 1 << 18, 64 << 20, 8
#: Labels are summed under this many salts before they meet.
LABEL_SALTS = 16
RESULTS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def usable(rows: DataFrame, vec_col: str) -> tuple[DataFrame, int, int]:
    """The rows that take part, with their vector as ``_vec``, its length, and how many they are."""
    v = F.col("_vec")
    fine = rows.withColumn("_vec", F.col(vec_col).cast("array<double>")).where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    most = fine.groupBy(F.size("_vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d, n = (most["d"], most["count"]) if most else (0, 0)
    return fine.where(F.size(v) == d), d, n


def bound_of(d: int) -> int:
    """The greatest component for which d squares of differences sum to less than 2**62."""
    return int((2**62 // max(d, 1)) ** 0.5) // 2


def integers(x: np.ndarray) -> np.ndarray:
    top = bound_of(x.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -top, top).astype(np.int64)


def bounds(d: int, parts: int) -> list[tuple[int, int]]:
    return [(d * i // parts, d * (i + 1) // parts) for i in range(parts)]


def assign(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member's nearest entry (ties to the lower index) and squared distance, in integers."""
    # exact in double precision where all products stay under 2**52; else integer by integer
    top = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)))
    if top * top * 4 * max(part.shape[1], 1) < 2**52:
        p, b = part.astype(np.float64), book.astype(np.float64)
        dist = (p * p).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (p @ b.T)
        return dist.argmin(axis=1), dist.min(axis=1).astype(np.int64)
    best, least = np.zeros(len(part), np.int64), np.full(len(part), np.iinfo(np.int64).max)
    for n, entry in enumerate(book):
        gap = part - entry
        dist = (gap * gap).sum(axis=1)
        best, least = np.where(dist < least, n, best), np.minimum(dist, least)
    return best, least


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return integers(column.flatten().to_numpy().reshape(-1, d))


def _first_books(rows: DataFrame, d: int, parts: int, entries: int) -> list[np.ndarray]:
    first = rows.select("_id", "_vec").orderBy(F.col("_id").asc_nulls_last(), "_vec").limit(entries).collect()
    whole = integers(np.array([r["_vec"] for r in first], np.float64).reshape(-1, d))
    return [whole[:, a:b] for a, b in bounds(d, parts)]


def _deal(d: int, parts: int, salts: int, books: list[np.ndarray]):
    """Rows to blocks of members at their first owners: ((position, entry, salt), block)."""

    def run(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        dealt = n * 7919
        for batch in batches:
            whole = _matrix(batch.column(0), d)
            salt = (np.arange(len(whole)) + dealt) % salts
            dealt += len(whole)
            small = np.abs(whole).max(initial=0) < 2**31
            for position, (a, b) in enumerate(bounds(d, parts)):
                part = np.ascontiguousarray(whole[:, a:b], np.int32 if small else np.int64)
                yield from _blocks(part, position, assign(part, books[position])[0], salt)

    return run


def _blocks(part: np.ndarray, position: int, entry: np.ndarray, salt: np.ndarray) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    order = np.lexsort((salt, entry))
    cut = np.flatnonzero((np.diff(entry[order], prepend=-1) != 0) | (np.diff(salt[order], prepend=-1) != 0))
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield (position, int(entry[order[a]]), int(salt[order[a]])), part[order[a:b]]


def _gather(members: Iterator[tuple[tuple[int, int, int], np.ndarray]]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """One block for each owner of a partition, from those that stayed and those that arrived."""
    held: dict[tuple[int, int, int], list[np.ndarray]] = {}
    for key, block in members:
        held.setdefault(key, []).append(block)
    for key, blocks in held.items():
        yield key, blocks[0] if len(blocks) == 1 else np.concatenate(blocks)


def _split(books: list[np.ndarray], stay: bool):
    """The members that stay with their owner, or those that leave, by their new owner."""

    def run(members: Iterator[tuple[tuple[int, int, int], np.ndarray]]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        for (position, entry, salt), block in members:
            best, _ = assign(block, books[position])
            if stay and (best == entry).any():
                yield (position, entry, salt), block[best == entry]
            if not stay:
                for new in np.unique(best[best != entry]).tolist():
                    yield (position, new, salt), block[best == new]

    return run


def _sums(members: Iterator[tuple[tuple[int, int, int], np.ndarray]]) -> Iterator[tuple[tuple[int, int], tuple[int, list[int]]]]:
    """The owners' sums, folded over their salts in the partition, as Python integers that cannot overflow."""
    total: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for (position, entry, _), block in members:
        n, s = total.get((position, entry), (0, 0))
        total[position, entry] = n + len(block), s + block.sum(axis=0, dtype=np.int64).astype(object)
    for key, (n, s) in total.items():
        yield key, (n, s.tolist())


def _add(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]


def _owner(key: tuple[int, int, int]) -> int:
    """Owners dealt evenly: neighbours in (salt, position, entry) fall on different partitions."""
    position, entry, salt = key
    return (salt * PARTS + position) * ENTRIES + entry


def _next_books(books: list[np.ndarray], members: RDD) -> list[np.ndarray]:
    """Each entry becomes the floored mean of its members; one without members stays."""
    found = dict(members.mapPartitions(_sums).reduceByKey(_add, min(members.getNumPartitions(), 64)).collect())
    out = [b.copy() for b in books]
    for (position, entry), (n, total) in found.items():
        out[position][entry] = [x // n for x in total]
    return out


def train(rows: DataFrame, d: int, n: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, owner_rows: int = OWNER_ROWS) -> list[np.ndarray]:
    """The codebooks after the rounds; rows has _id and _vec, n vectors of length d."""
    spark = rows.sparkSession
    if not n:
        return [np.zeros((0, b - a), np.int64) for a, b in bounds(d, parts)]
    books = _first_books(rows, d, parts, entries)
    salts = -(-n // owner_rows)
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * d * 4 // PARTITION_BYTES))
    n_parts = min(wide, parts * entries * salts)
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # Arrow batches leave the JVM as they are; from here on blocks are keyed
    blocks = rows.select("_vec").mapInArrow(_as_bytes(d), "block binary").rdd
    dealt = blocks.mapPartitionsWithIndex(lambda i, it, run=_deal(d, parts, salts, books): run(i, (_batch(r[0], d) for r in it)))
    members = dealt.partitionBy(n_parts, _owner).mapPartitions(_gather, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    last = None
    for n_round in range(1, rounds + 1):
        if n_round % CHECKPOINT_EVERY == 0:
            members.checkpoint()
        books = _next_books(books, members)
        if last:
            last.unpersist()
        stay = members.mapPartitions(_split(books, True), preservesPartitioning=True)
        moved = members.mapPartitions(_split(books, False)).partitionBy(n_parts, _owner)
        last, members = members, stay.union(moved).mapPartitions(_gather, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    last.unpersist()
    return books


def _as_bytes(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 65536):
                yield pa.RecordBatch.from_pydict({"block": pa.array([batch.column(0)[a : a + 65536].flatten().to_numpy().tobytes()], pa.binary())})

    return run


def _batch(block: bytes, d: int) -> pa.RecordBatch:
    flat = pa.array(np.frombuffer(block, np.float64))
    return pa.RecordBatch.from_pydict({"v": pa.FixedSizeListArray.from_arrays(flat, d)})


def _encode(books: list[np.ndarray], d: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch.column("_vec"), d)
            code, error = np.empty((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
            for position, (a, b) in enumerate(bounds(d, parts)):
                code[:, position], dist = assign(whole[:, a:b], books[position])
                error += dist
            digits = code.tobytes().hex()
            out = batch.drop_columns(["_vec"]).append_column("code", pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()))
            yield out.append_column("error", pa.array(error))

    return run


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each vector: vec_id, code, error, label_error, codebooks_sha256."""
    keep = [c for c in keep if c not in RESULTS]
    found = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v"), F.col(label_col).alias("_label"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    found, d, n = usable(found, "_v")
    found = found.drop("_v")
    books = train(found, d, n, parts, entries, rounds)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "_vec")
    coded = found.mapInArrow(_encode(books, d, parts), schema + ", code string, error long")
    # a label may have any share of the rows: it is summed by salt, and its total meets the rows by salt
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("_id", "code"), F.lit(LABEL_SALTS)).cast("int"))
    totals = salted.groupBy("_label", "_salt").agg(F.sum("error").alias("e")).groupBy(F.col("_label").alias("_of")).agg(F.sum("e").alias("label_error"))
    totals = totals.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))))
    met = salted.join(totals, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_part")))
    return met.select(F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), *(F.col(f"_keep_{c}").alias(c) for c in keep))


def op12(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every vector that takes part."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds one after the other, each as an assignment and an update; vectors of one length that the parts divide."""
    nearest = """a{r} as materialized (select rid, pos, arg_min(entry, (dist, entry)) as entry, min(dist) as dist from (
  select p.rid, p.pos, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::bigint as dist
  from p join b{r} b on p.pos = b.pos) group by rid, pos)"""
    update = """m{r} as (select pos, entry, list(mean order by k) as x from (
  select a.pos, a.entry, k, {mean} as mean from a{o} a join p on a.rid = p.rid and a.pos = p.pos, (select unnest(range(1, (select max(len(x)) from p) + 1)) as k)
  group by a.pos, a.entry, k) group by pos, entry),
b{r} as materialized (select b.pos, b.entry, coalesce(m.x, b.x) as x from b{o} b left join m{r} m on b.pos = m.pos and b.entry = m.entry)"""
    mean = "cast((sum(p.x[k]) - ((sum(p.x[k]) % count(*)) + count(*)) % count(*)) // count(*) as bigint)"
    steps = [nearest.format(r=0)]
    for r in range(1, ROUNDS + 1):
        steps += [update.format(r=r, o=r - 1, mean=mean), nearest.format(r=r)]
    chain = ",\n".join(steps)
    return f"""
with v as materialized (select row_number() over (order by vec_id nulls last, embedding) as rid, vec_id, label, list_transform(embedding, lambda e: cast(floor({SCALE} * cast(e as double)) as bigint)) as x from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
p as materialized (select rid, pos, x[(pos * len(x)) // {PARTS} + 1:((pos + 1) * len(x)) // {PARTS}] as x from (select *, unnest(range({PARTS})) as pos from v)),
b0 as materialized (select pos, rid - 1 as entry, x from p where rid <= {ENTRIES}),
{chain},
c as (select rid, string_agg(printf('%02x', entry), '' order by pos) as code, cast(sum(dist) as bigint) as error from a{ROUNDS} group by rid),
s as (select sha256(string_agg(cast(y as varchar), ',' order by pos, entry, k)) as codebooks_sha256 from (select pos, entry, unnest(x) as y, unnest(range(len(x))) as k from b{ROUNDS}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from v join c using (rid), s
"""


SQL = _sql()
