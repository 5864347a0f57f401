"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots. It is posted in the inverted files of its first
few pivots, together with its truncated order; a query probes the files of its own nearest pivots, ranks what it
finds in each by footrule distance between the orders, and only the best of these are multiplied with it.

Pivots are vectors of a bounded sample (those of the smallest id hashes), and there are SPREAD * sqrt(rows) of them, MOST_PIVOTS
at most; probes grow with the logarithm of the rows. So a file has about sqrt(rows) vectors whatever the size of
the table, every vector is sent POSTS times, and the pairs looked at are a share of about
POSTS * probes / pivots of all, which falls with the square root of the rows.

Equal vectors are one: of each, only the k + 1 smallest ids can be in an answer, so only these are kept as candidates (exactly,
no answer changes), and equal queries are searched for once. A file of more than ``block`` vectors or queries is
cut in blocks, so that no crowded pivot makes one large task.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, and neither do
rows of null id; shorter vectors are continued with zeros, so all take part in one index; a vector's own id is never
its answer; rows that repeat an id are candidates of their own (a query id is answered once, for the first of
its vectors in their order); ties go to the smaller id; with fewer candidates than k all are returned; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.common import materialize, partitions, table

SPREAD = 16
MOST_PIVOTS = 1 << 15
DEPTH = 64
POSTS = 8
PROBES = 12  # times the logarithm of the rows
BLOCK = 4096
RERANK = 0.4
FLUSH = 1 << 20


def sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.filter(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def pivots(rows: DataFrame, count: int, dim: int) -> np.ndarray:
    """Unit vectors: the vectors of the smallest id hashes, without repeats."""
    found = rows.orderBy(F.xxhash64("id"), "id", "v").limit(count).collect()
    x = np.zeros((len(found), dim))
    for i, r in enumerate(found):
        x[i, : len(r.v)] = r.v
    x = np.unique(x, axis=0)
    return (x / np.abs(x).max(axis=1, keepdims=True) / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True)).astype(np.float32)


def orders(x: np.ndarray, p: np.ndarray, depth: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    depth = min(depth, len(p))
    out = np.empty((len(x), depth), np.uint16)
    step = max(1, (1 << 22) // len(p))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        like = (part / np.abs(part).max(axis=1, keepdims=True)).astype(np.float32) @ p.T
        top = np.argpartition(-like, depth - 1, axis=1)[:, :depth]
        out[a : a + step] = np.take_along_axis(top, np.argsort(-np.take_along_axis(like, top, 1), axis=1, kind="stable"), 1)
    return out


def footrule(queries: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Footrule distance (queries x rows) of truncated orders; a pivot that is missing stands at depth."""
    depth = rows.shape[1]
    place = np.full((len(queries), count), depth, np.int16)
    np.put_along_axis(place, queries.astype(np.int64), np.arange(depth, dtype=np.int16)[None, :], 1)
    at = np.take(place, rows.ravel().astype(np.int64), axis=1).reshape(len(queries), len(rows), depth)
    far = np.abs(at - np.arange(depth, dtype=np.int16)).sum(2, dtype=np.int32)
    # The query's pivots that the row lacks are depth - place away: all of them, less those that are shared.
    return far + depth * (depth + 1) // 2 - (depth - at).sum(2, dtype=np.int32)


def plan(count: int) -> tuple[int, int]:
    """(pivots, probes) for a number of vectors."""
    return max(1, min(MOST_PIVOTS, int(SPREAD * math.sqrt(count)))), max(1, math.ceil(PROBES * math.log(max(2, count))))


def _best(ids: np.ndarray, v: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query's found vectors; a vector found in several files counts once."""
    order = np.lexsort((v, -score, ids))
    ids, v, score = ids[order], v[order], score[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (v[1:] != v[:-1]) | (score[1:] != score[:-1])
    ids, v, score = ids[new], v[new], score[new]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return ids[rank < k], v[rank < k], score[rank < k]


def postings(vectors: DataFrame, is_query, k: int, key: str, vector: str, posts: int = POSTS) -> tuple[DataFrame, DataFrame, DataFrame, int, int, np.dtype] | None:
    """(posted, probing, queries by their vector's first id, pivots, length of vectors, kind of their bytes); None without any vector."""
    rows = sound(vectors, key, vector)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size.n:
        return None
    kind, dim = (np.dtype("<f4") if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else np.dtype("<f8")), size.dim
    count, probes = plan(size.n)
    p = pivots(rows, count, dim)
    sent = vectors.sparkSession.sparkContext.broadcast(p)

    def post(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    part = batch.slice(a, 4096)
                    x = np.zeros((part.num_rows, dim), kind)
                    lengths = np.array([len(v) for v in part.column("v")], np.int64)
                    x[np.arange(dim)[None, :] < lengths[:, None]] = np.asarray(part.column("v").flatten())
                    o = orders(x.astype(np.float64), sent.value, max(DEPTH, width))
                    wide = min(width, o.shape[1])
                    at = pa.array(np.repeat(np.arange(len(x)), wide))
                    perm = pa.array([r.tobytes() for r in np.ascontiguousarray(o[:, :DEPTH])], pa.binary())
                    raw = pa.array([r.tobytes() for r in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(o[:, :wide].ravel().astype(np.int32)), part.column("id").take(at), perm.take(at), raw.take(at)], ["pivot", "id", "perm", "x"])

        return run

    schema = "pivot int, id long, perm binary, x binary"
    same = Window.partitionBy("h", "v").orderBy("id")
    least = rows.withColumn("h", F.xxhash64("v")).withColumn("at", F.row_number().over(same)).filter(F.col("at") <= k + 1)
    asked = rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v"))
    asked = materialize(asked.withColumn("of", F.min("id").over(Window.partitionBy("h", "v"))), "queries")
    posted = materialize(least.select("id", "v").mapInArrow(post(posts), schema), "postings")
    probing = materialize(asked.filter("id = of").select("id", "v").mapInArrow(post(probes), schema), "probes")
    return posted, probing, asked.select("id", "of"), len(p), dim, kind


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", rerank: float = RERANK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by inner product. is_query: a condition on ``id``."""
    spark = vectors.sparkSession
    built = postings(vectors, is_query, k, key, vector)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posted, probing, asked, total, dim, kind = built
    n = partitions(spark)
    # Only crowded files are cut in blocks; there are POSTS * rows / block of them at most, and no more than pivots.
    crowd = [posted.groupBy("pivot").count(), probing.groupBy("pivot").count()]
    crowd = {x: {r.pivot: -(-r["count"] // block) for r in f.filter(F.col("count") > block).collect()} for x, f in zip("vq", crowd, strict=True)}
    cut = [(c, crowd["v"].get(c, 1), crowd["q"].get(c, 1)) for c in sorted({*crowd["v"], *crowd["q"]})]
    cut = F.broadcast(spark.createDataFrame(cut, "pivot int, vs int, qs int"))  # at most MOST_PIVOTS rows
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 30))

    def side(rows: DataFrame, query: bool) -> DataFrame:
        mine, others = ("j", "i") if query else ("i", "j")
        parts, blocks = (F.coalesce(c, F.lit(1)) for c in ((F.col("qs"), F.col("vs")) if query else (F.col("vs"), F.col("qs"))))
        placed = rows.join(cut, "pivot", "left").withColumn(mine, (own % parts).cast("int")).withColumn(others, F.explode(F.sequence(F.lit(0), blocks - 1)))
        return placed.select("pivot", "i", "j", F.lit(query).alias("q"), "id", "perm", "x")

    both = side(posted, False).unionByName(side(probing, True))
    both = both.repartition(n, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "q")

    def compare(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        t = pa.Table.from_batches(held).combine_chunks()
        q, ids = t.column("q").to_numpy(), t.column("id").to_numpy()
        if not q.any() or q.all():
            return None
        perms = np.frombuffer(b"".join(t.column("perm").to_pylist()), np.uint16).reshape(len(q), -1)
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), kind).reshape(len(q), dim).astype(np.float64)
        order = np.argsort(ids[~q], kind="stable")  # ties then fall to the smaller id
        vid, vp, vx, qid, qp, qx = ids[~q][order], perms[~q][order], x[~q][order], ids[q], perms[q], x[q]
        keep = min(len(vid), k + 1 + math.ceil(rerank * len(vid)))
        out = []
        step = max(1, (1 << 21) // (len(vid) * perms.shape[1]), (1 << 18) // (keep * dim) if keep == len(vid) else 1)
        for a in range(0, len(qid), step):
            far = footrule(qp[a : a + step], vp, total).astype(np.int64) * len(vid) + np.arange(len(vid))
            near = np.argpartition(far, keep - 1, axis=1)[:, :keep] if keep < len(vid) else np.broadcast_to(np.arange(len(vid)), far.shape)
            for b in range(0, len(near), max(1, (1 << 19) // (keep * dim))):  # the products of the survivors only
                some = near[b : b + max(1, (1 << 19) // (keep * dim))]
                score = (vx[some] * qx[a + b : a + b + len(some), None, :]).sum(2)
                out.append(_best(np.repeat(qid[a + b : a + b + len(some)], keep), vid[some].ravel(), score.ravel(), k + 1))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found, size = None, [], [], 0

        def emit() -> pa.RecordBatch:
            best = _best(*(np.concatenate(c) for c in zip(*found, strict=True)), k + 1)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["of", "vec_id", "score"])

        def close() -> None:
            nonlocal size
            if held and (got := compare(held)) is not None:
                found.append(got)
                size += len(got[0])

        for batch in batches:
            if not batch.num_rows:
                continue
            name = [batch.column(c).to_numpy().astype(np.int64) for c in ("pivot", "i", "j")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in name], axis=0)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                mine = tuple(c[a] for c in name)
                if mine != now:
                    close()
                    held = []
                    if size > FLUSH:
                        yield emit()
                        found, size = [], 0
                now = mine
                held.append(batch.slice(a, b - a))
        close()
        if found:
            yield emit()

    found = both.mapInArrow(run, "of long, vec_id long, score double").distinct()
    best = Window.partitionBy("of").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    # Every query of a vector has its answers, less its own id.
    answers = asked.withColumnRenamed("id", "query_id").join(found, "of").filter("vec_id != query_id")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "at")
    return answers.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
