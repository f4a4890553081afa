"""Exact top-k inner-product search: Fagin's threshold algorithm over sorted lists, one list for each dimension.

Vectors are dealt to shards of bounded size by a hash of their row; a shard holds, for each dimension, its vectors in
order of that component. A query walks all lists of a shard at once, from the end that its own component favours, and
scores each vector when it first meets it. What no list has shown yet scores at most the sum of the products at the
places reached; once the kth score is above that bound, the walk ends. Queries come in blocks of bounded size, and each
block meets each shard in a task of its own, so neither the queries nor the vectors have to fit anywhere. The k best of
each shard then compete for the k best of all.

Components become floor(scale * x). Scores are whole numbers, worked out exactly; beyond a long they are clipped to one, and rank so.
Vectors that are null, or hold null or non-finite components, take no part. Only vectors of the same length are compared;
those of length 0 score 0. Ties go to the smaller id, null ids last. Repeated rows each count: a query meets its copies,
never its own row. A query without any other vector gives no row, nor does an empty table. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import read, stored

#: Components in a shard or block of queries, about: 16,384 vectors of 64 dimensions. Bounds a task's memory.
CELLS = 1 << 20
#: How far the first step of a walk goes; each later step doubles it.
FIRST_STEP = 32
LONGS = (-(1 << 63), (1 << 63) - 1)

SHARD = "dim long, part long, n long, places binary, ids binary, nulls binary, kind string, x binary, lists binary"
FOUND = "place long, query_id long, vec_id long, score long, scored long"


def whole_vectors(rows: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(place, vec_id, is_query, dim, x): a number for each row, and its components as whole numbers."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(F.lit(scale) * c))
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    taken = rows.where(F.col(vector_col).isNotNull() & finite)
    place = F.monotonically_increasing_id().alias("place")
    return taken.select(place, F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.size(vector_col).cast("long").alias("dim"), x.alias("x"))


def packed(rows: DataFrame, lists: bool) -> DataFrame:
    """SHARD: a row for each (dim, part), with the vectors in order of id and, if wanted, the sorted lists."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("place", "ascending")])  # nulls last
        n, dim = table.num_rows, table["dim"][0].as_py()
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(n, dim)
        most = int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0
        x = x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")
        order = np.argsort(x, axis=0, kind="stable").T.astype("<i4").tobytes() if lists else b""
        ids = table["vec_id"].combine_chunks()
        row = [dim, table["part"][0].as_py(), n, table["place"].to_numpy().astype("<i8").tobytes(), ids.fill_null(0).to_numpy().astype("<i8").tobytes()]
        row += [ids.is_null().to_numpy(zero_copy_only=False).tobytes(), x.dtype.str, x.tobytes(), order]
        names = [c.split(" ")[0] for c in SHARD.split(", ")]
        types = [pa.int64()] * 3 + [pa.binary()] * 3 + [pa.string()] + [pa.binary()] * 2
        return pa.table({k: pa.array([v], t) for k, v, t in zip(names, row, types, strict=True)})

    return rows.groupBy("dim", "part").applyInArrow(pack, SHARD)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, ids, which ids are null, components, and lists of a packed row."""
    n, dim = row["n"], row["dim"]
    lists = np.frombuffer(row["lists"], "<i4").reshape(dim, n) if row["lists"] else np.zeros((dim, 0 if dim else n), "<i4")
    x = np.frombuffer(row["x"], row["kind"]).reshape(n, dim) if row["x"] else np.zeros((n, dim), np.int64)
    return np.frombuffer(row["places"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], bool), x, lists


def threshold_best(x: np.ndarray, lists: np.ndarray, q: np.ndarray, k: int, own: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, index) of the rows of x against q, smaller indices first among equals, and how many were scored.

    x and q hold whole numbers, as floats where all sums are exact in them. lists[j] has the indices in ascending order
    of component j. own: an index that takes no part.
    """
    n, dim = x.shape
    up, down = np.flatnonzero(q < 0), np.flatnonzero(q >= 0)
    seen = np.zeros(n, bool)
    if own is not None:
        seen[own] = True
    best, index, scored, depth = np.empty(0, x.dtype), np.empty(0, np.int64), 0, 0
    while depth < n and not seen.all():
        to = min(n, max(FIRST_STEP, 2 * depth))
        met = np.zeros(n, bool)
        met[lists[up, depth:to]] = True
        met[lists[down, n - to : n - depth]] = True
        fresh = np.flatnonzero(met & ~seen) if dim else np.flatnonzero(~seen)
        seen[fresh] = True
        scored += len(fresh)
        score = np.clip(x[fresh] @ q, *LONGS) if x.dtype == object else x[fresh] @ q
        if len(score) > k and x.dtype != object:  # rows below the kth are out; those equal to it stay
            keep = score >= np.partition(score, -k)[-k]
            score, fresh = score[keep], fresh[keep]
        best, index = np.concatenate((best, score)), np.concatenate((index, fresh))
        first = np.lexsort((index, -best))[:k]
        best, index, depth = best[first], index[first], to
        bound = (q[up] * x[lists[up, to - 1], up]).sum() + (q[down] * x[lists[down, n - to], down]).sum()
        if len(best) == k and best[-1] > bound:  # an unseen vector could still equal the bound, and have a smaller id
            break
    return [(int(s), int(i)) for s, i in zip(best, index, strict=True)], scored


def searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each row is a shard and, in columns q_*, a block of queries: the k best of the shard for each query."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            places, ids, nulls, x, lists = unpacked(row)
            q_places, q_ids, _, q, _ = unpacked({c[2:]: v for c, v in row.items() if c.startswith("q_")} | {"dim": row["dim"]})
            most = [max((abs(int(a.max())), abs(int(a.min())))) if a.size else 0 for a in (x, q)]
            kind = np.float64 if most[0] * most[1] * max(1, row["dim"]) < 1 << 53 else object  # sums exact in doubles, or Python's integers
            x, q = (x.astype(np.int64).astype(kind) for x in (x, q))
            at = {int(p): i for i, p in enumerate(places)}
            out: list[list] = [[], [], [], [], []]
            for j in range(len(q)):
                best, scored = threshold_best(x, lists, q[j], k, at.get(int(q_places[j])))
                for nth, (score, index) in enumerate(best):
                    for column, v in zip(out, (int(q_places[j]), int(q_ids[j]), None if nulls[index] else int(ids[index]), score, 0 if nth else scored), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [c.split(" ")[0] for c in FOUND.split(", ")])


def top_k(rows: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score, scored) of the k best other rows for each row where is_query holds.

    scored: how many vectors the walks of that query scored, in all shards.
    """
    spark = rows.sparkSession
    vectors = stored(whole_vectors(rows, is_query, id_col, vector_col, scale), "vectors")  # places stay as they are from here on
    size = F.greatest(F.lit(1), F.ceil(F.count("*") * F.greatest(F.col("dim"), F.lit(1)) / CELLS))
    shards, blocks = vectors.groupBy("dim").agg(size.alias("shards")), vectors.where("is_query").groupBy("dim").agg(size.alias("blocks"))
    sizes = shards.join(blocks, "dim")
    pairs = sizes.agg(F.sum(F.col("shards") * F.col("blocks"))).first()[0] or 1
    part = lambda n: F.pmod(F.xxhash64("place"), F.col(n)).alias("part")
    index = stored(packed(vectors.join(sizes, "dim").select("dim", part("shards"), "place", "vec_id", "x"), True), "sorted-lists")
    asked = packed(vectors.where("is_query").join(sizes, "dim").select("dim", part("blocks"), "place", "vec_id", "x"), False).drop("lists")
    # A block of queries against every shard: each pair is a row of some megabytes, in a task of its own or nearly so.
    against = index.join(sizes, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("shards", "blocks")
    asks = asked.join(sizes, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards", "blocks")
    asks = asks.select(F.col("shard").alias("part"), F.col("part").alias("block"), "dim", *(F.col(c).alias("q_" + c) for c in ("n", "places", "ids", "nulls", "kind", "x")), F.lit(b"").alias("q_lists"))
    met = against.repartition(task_count(spark, pairs), "dim", "part", "block").join(asks, ["dim", "part", "block"])
    found = met.mapInArrow(lambda batches: searched(batches, k), FOUND)
    own = Window.partitionBy("place")
    order = own.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("scored", F.sum("scored").over(own))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored")


def task_count(spark: SparkSession, pairs: int) -> int:
    """As many tasks as pairs of a shard and a block, up to some for each core of the cluster."""
    return int(min(pairs, max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every row whose vec_id is divisible by 50, among all other rows."""
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows, F.col("vec_id") % 50 == 0, 5).drop("scored")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
