"""Exact top-k search by a three-phase uniform threshold.

Vectors are cut into `lists` runs of dimensions; a query's inner product with a candidate is the sum of its scores in these
lists.  Phase 1: every task ranks its candidates in each list by their score there alone, and gathers the best k of each list with
their total scores; the k-th best of all of them is a safe cutoff, as k candidates reach it.  Phase 2: the cutoffs are broadcast; a total of
at least the cutoff needs a score of at least cutoff / lists in some list, so only such entries are collected, and of their candidates only those go on
whose scores known so far can still reach the cutoff, a score not known being under cutoff / lists and within the product of both
runs' norms.  Phase 3: the scores not known of these candidates alone are computed, and totals are exact.  Each task hands on its k best, which are
ranked for good by score, ties to the smaller id.  `phase_counts` tells how many entries each phase handles.

Components are floor(scale * x), x as double; scores are integers, computed in floating point of as many bits as hold them
exactly, or else as integers of any size; a total beyond 64 bits counts as the nearest number that they hold.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, as query or candidate; shorter
vectors count as ending in zeros; rows with the query's id are its own rows, never its candidates; a null id is never
a query and comes last among ties; repeated query rows are repeated queries; fewer than k candidates give them all; an empty
table or no query gives no rows.

Scale: queries are taken in blocks of about `query_block`, each broadcast, against all rows, without a shuffle of candidates; a task
keeps k entries per query and list.  Work is queries times rows, as it must be where every score counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticore.llm import common as C

LAST = (1 << 63) - 1
FLOOR = -(1 << 63)  # stands for no cutoff


def _matrix(lists: pa.Array, scale: float, dims: int | None = None) -> np.ndarray:
    """Vectors as rows of integers, held as doubles; zeros after the end of shorter ones."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    n, lengths = len(lists), np.diff(offsets)
    dims = int(lengths.max(initial=0)) if dims is None else dims
    out = np.zeros((n, dims))
    inside = np.arange(dims)[None, :] < lengths[:, None]
    out[inside] = flat[(offsets[:-1, None] + np.arange(dims)[None, :])[inside]]
    return np.floor(scale * out)


def _numbers(queries: np.ndarray, rows: np.ndarray) -> type:
    """The fastest kind of number that holds all their scores exactly."""
    top = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(queries.shape[1], 1)
    return np.float32 if top < 2**23 else np.float64 if top < 2**52 else object


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _long(x: np.ndarray) -> np.ndarray:
    """Exact scores as 64-bit integers, the nearest where they have no place."""
    return np.array([max(FLOOR + 1, min(LAST, v)) for v in x.tolist()], np.int64) if x.dtype == object else x.astype(np.int64)


def _merge(best: tuple, found: tuple, k: int) -> tuple:
    """The k best (score, then smaller id) of each query among two sets of (query, score, id, ...)."""
    all_ = [np.concatenate(x) for x in zip(best, found)]
    q, s, i = all_[:3]
    order = np.lexsort((i, -s, q))
    q = q[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return tuple(x[order][keep] for x in all_)


def _none(n: int) -> tuple:
    return tuple(np.zeros(0, np.int64) for _ in range(n))


#: What a task reports beside its entries, as negative q: entries gathered, entries collected, candidates left, scores resolved, all scores.
GATHERED, COLLECTED, CANDIDATES, RESOLVED, ALL = -1, -2, -3, -4, -5


class _Batch:
    """A batch of rows before the queries: scores of a list for all pairs, or for given ones."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, lists: int):
        dims = min(rows.shape[1], queries.shape[1])
        q, r = queries[:, :dims], rows[:, :dims]
        kind = _numbers(q, r)
        self.q, self.r = (_integers(q), _integers(r)) if kind is object else (q.astype(kind), r.astype(kind))
        edges = np.linspace(0, queries.shape[1], lists + 1).astype(int)
        self.runs = [slice(min(a, dims), min(b, dims)) for a, b in zip(edges, edges[1:])]

    def every(self, run: slice) -> np.ndarray:
        return self.q[:, run] @ self.r[:, run].T if run.start < run.stop else np.zeros((len(self.q), len(self.r)))

    def of(self, q: np.ndarray, x: np.ndarray, run: slice) -> np.ndarray:
        out = [(self.q[q[a : a + 65536], run] * self.r[x[a : a + 65536], run]).sum(axis=1) for a in range(0, len(q), 65536)]
        out = np.concatenate([np.zeros(0, self.q.dtype), *out])
        return out if out.dtype == object else out.astype(np.int64)

    def totals(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return _long(self.of(q, x, slice(0, self.q.shape[1])))

    def norms(self, run: slice) -> np.ndarray:
        """Upper bounds of the scores in a run, a factor for each query and one for each row."""
        return [np.sqrt((m[:, run].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9) for m in (self.q, self.r)]


def _gather(shared, k: int, lists: int, scale: float):
    """Phase 1: the best k of each of the task's lists, with their totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = [_none(5) for _ in range(lists)]  # query, score in the list, id, row of the task, total
        line = [np.full(len(ids), -np.inf) for _ in range(lists)]
        row = seen = resolved = 0
        for b in batches:
            own = C.column(b, "_id").to_numpy(zero_copy_only=False)
            if not len(own):
                continue
            batch = _Batch(queries, _matrix(C.column(b, "_vector"), scale), lists)
            other = ids[:, None] != own[None, :]
            for j, part in enumerate(batch.runs):
                p = np.where(other, batch.every(part).astype(np.float64), -np.inf)
                top = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
                score = np.take_along_axis(p, top, 1)
                q, at = np.nonzero((score > -np.inf) & (score >= line[j][:, None]))
                x = top[q, at]
                best[j] = _merge(best[j], (q, score[q, at], own[x], row + x, batch.totals(q, x)), k)
                resolved += len(q)
                full = np.flatnonzero(np.bincount(best[j][0], minlength=len(ids)) == k)
                line[j][full] = best[j][1][np.searchsorted(best[j][0], full, "right") - 1]
            row += len(own)
            seen += p.size * lists
        q, _, i, r, total = (np.concatenate(x) for x in zip(*best))
        _, once = np.unique(np.stack([q, r]), axis=1, return_index=True)
        q, i, total = q[once], i[once], total[once]
        counts = {GATHERED: sum(len(x[0]) for x in best), RESOLVED: resolved * lists, ALL: seen}
        yield _entries((q, total, i), counts)

    return run


def _collect(shared, cutoffs, k: int, lists: int, scale: float):
    """Phases 2 and 3: entries that reach the uniform threshold in a list, and the exact totals of their candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, queries), cutoff = shared.value, cutoffs.value
        best = _none(3)
        counts = dict.fromkeys((COLLECTED, CANDIDATES, RESOLVED), 0)
        line = np.where(cutoff == FLOOR, -np.inf, cutoff.astype(np.float64) * (1 - 1e-12 * np.sign(cutoff)))  # never above the cutoff
        for b in batches:
            own = C.column(b, "_id").to_numpy(zero_copy_only=False)
            if not len(own):
                continue
            batch = _Batch(queries, _matrix(C.column(b, "_vector"), scale), lists)
            other = ids[:, None] != own[None, :]
            known, sums = [], np.zeros(other.shape, object if batch.q.dtype == object else np.int64)
            for part in batch.runs:  # phase 2
                p = batch.every(part)
                hit = other & (p.astype(np.float64) >= line[:, None] / lists)
                sums[hit] += p[hit] if p.dtype == object else p[hit].astype(np.int64)
                known.append(hit)
                counts[COLLECTED] += int(hit.sum())
            q, x = np.nonzero(np.logical_or.reduce(known))
            total, most = sums[q, x], sums[q, x].astype(np.float64)
            for part, hit in zip(batch.runs, known):
                a, c = batch.norms(part)
                most += np.where(hit[q, x], 0.0, np.minimum(a[q] * c[x] + 1, line[q] / lists + 1))
            can = most >= line[q]
            q, x, total = q[can], x[can], total[can]
            counts[CANDIDATES] += len(q)
            for part, hit in zip(batch.runs, known):  # phase 3
                lacking = np.flatnonzero(~hit[q, x])
                total[lacking] += batch.of(q[lacking], x[lacking], part)
                counts[RESOLVED] += len(lacking)
            total = _long(total)
            reach = total >= cutoff[q]
            best = _merge(best, (q[reach], total[reach], own[x[reach]]), k)
        yield _entries(best, counts)

    return run


def _entries(found: tuple, counts: dict[int, int]) -> pa.RecordBatch:
    q, score, i = (np.concatenate([x, y]).astype(np.int64) for x, y in zip(found, (list(counts), list(counts.values()), [0] * len(counts))))
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(score)], ["q", "_id", "score"])


def _phases(vectors: DataFrame, queries: Column, *, k: int, vec_id: str, embedding: str, scale: float, lists: int, query_block: int) -> Iterator[tuple[DataFrame, DataFrame, pa.Array]]:
    """For each block of queries: what phase 1 gathers (written), what phases 2 and 3 find, and the queries' ids by q."""
    C.need(vectors, vec_id, embedding)
    spark = vectors.sparkSession
    C.short_batches(spark)
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col(embedding).isNotNull() & finite)
    rows = usable.select(F.coalesce(F.col(vec_id).cast("bigint"), F.lit(LAST)).alias("_id"), F.col(embedding).alias("_vector"))
    asked = usable.where(F.col(vec_id).isNotNull() & queries).select(F.col(vec_id).cast("bigint").alias("_id"), F.col(embedding).alias("_vector"))
    blocks = -(-asked.count() // query_block)
    schema = "q bigint, _id bigint, score bigint"
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == block).toArrow().combine_chunks().sort_by("_id")
        if not own.num_rows:
            continue
        ids = own["_id"].combine_chunks()
        shared = spark.sparkContext.broadcast((ids.to_numpy(), _matrix(own["_vector"].combine_chunks(), scale)))
        gathered = C.cut(rows.mapInArrow(_gather(shared, k, lists, scale), schema), "gathered")
        cutoff = np.full(len(ids), FLOOR, np.int64)
        for r in _ranked(gathered, k).where(F.col("rank") == k).select("q", "score").collect():  # a row per query of the block
            cutoff[r.q] = r.score
        yield gathered, rows.mapInArrow(_collect(shared, spark.sparkContext.broadcast(cutoff), k, lists, scale), schema), ids


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "_id"))
    return entries.where("q >= 0").withColumn("rank", rank).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, queries: Column, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0, lists: int = 2, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of every row for which `queries` holds."""
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    for gathered, found, ids in _phases(vectors, queries, k=k, vec_id=vec_id, embedding=embedding, scale=scale, lists=lists, query_block=query_block):
        names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(ids))), "query_id": ids}))
        found = _ranked(found, k).join(names, "q").select("query_id", "rank", F.when(F.col("_id") != LAST, F.col("_id")).alias("vec_id"), "score")
        out = out.unionByName(C.cut(found, "topk"))
        C.drop(gathered)
    return out


def phase_counts(vectors: DataFrame, queries: Column, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0, lists: int = 2, query_block: int = 4096) -> dict[str, int]:
    """How many entries the phases handle: gathered, collected, candidates left, scores resolved for them, and the scores of all pairs and lists."""
    out = dict.fromkeys(("gathered", "collected", "candidates", "resolved", "all"), 0)
    for gathered, found, _ in _phases(vectors, queries, k=k, vec_id=vec_id, embedding=embedding, scale=scale, lists=lists, query_block=query_block):
        for r in gathered.unionByName(found).where("q < 0").groupBy("q").agg(F.sum("score").alias("n")).collect():
            out[list(out)[-1 - r.q]] += r.n
    return out


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row whose id is divisible by 50."""
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP8_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
