"""Mixing sources to target weights: equal-token blocks dealt out by Sainte-Lague apportionment.

Targets: the sources, in code-point order with null last, weigh `weights` in turn, and share the size of the whole table
by weight; a source's target stops at `max_repeats` times its size, and what is over is shared again by weight among the
others until none is above.  The sum of all targets, in blocks of `block` words, is apportioned to the sources by
highest quotients target / (2s + 1), each source's blocks again among groups of its shards by their sizes, and each group's among its
shards (bounded groups of documents).  A shard lays its documents out in a seeded order, end to end, as blocks of `block` words (the last may be
short); with a quota of q blocks out of n it takes every block q div n times, and q mod n of them once more, chosen
systematically from a seeded start.  A document's taken words are those of its words in the blocks taken, counted with
their repeats: in closed form, so no block is ever a row.

`mixed` gives the mix as whole documents: along each shard's order, by powers of two of the size and then seeded, a document stands as often as
brings the words so far nearest to those that the shard's documents so far take, so a shard meets its quota but for half of one of its smallest documents.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last in order; a source without
words has target 0; repeated document rows (same id, text and source) are counted first and laid out one after the other; null ids are told apart by
their texts; an empty table gives an empty result; sizes are exact, and the same rows give the same result on any number of partitions.
Extra columns, whatever their names, are ignored by `mix_sources` and kept by `mixed`.

Scale: texts are read once and reduced to a size; only (id, source, size) is shuffled, combined in each task, to shards of about
`shard_docs` different documents, so a source with a third of all rows is many shards.  The driver sees one row per source (refused over
`max_sources`); shards are apportioned in a task for each `fan` of them, and these groups in a task per source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticore.llm import common as C

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: float) -> np.ndarray:
    """The total shared by weight, each share stopping at max_repeats times its size, the excess shared again."""
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    out, free, left = np.zeros(len(size)), np.ones(len(size), bool), float(size.sum())
    while free.any():
        share = left * weight / weight[free].sum()
        over = free & (share > max_repeats * size)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = max_repeats * size[over]
        left -= out[over].sum()
        free &= ~over
    return out


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2s + 1), ties to the earlier; no party over its cap.

    A common divisor found by bisection gives all but a few seats at once; only those few are dealt one by one.
    """
    v = np.asarray(votes, float)
    cap = np.full(len(v), np.iinfo(np.int64).max // 4) if caps is None else np.asarray(caps, np.int64)
    cap = np.where(v > 0, cap, 0)
    seats = int(min(seats, cap.sum(dtype=float)))
    if seats <= 0 or not len(v):
        return np.zeros(len(v), np.int64)
    rounded = lambda d: np.minimum(np.floor(v / d + 0.5), cap).astype(np.int64)
    low, high = v[v > 0].min() / (4.0 * seats + 4), 2.0 * v.max() + 1
    for _ in range(200):  # low gives at least the seats where caps allow, high gives too few
        d = math.sqrt(low * high)
        low, high = (low, d) if rounded(d).sum(dtype=float) <= seats else (d, high)
        if high / low < 1 + 1e-13:
            break
    out = rounded(high)
    while (left := seats - int(out.sum())) > 0:
        quotient = np.where(out < cap, v / (2.0 * out + 1), -1.0)
        out[np.argsort(-quotient, kind="stable")[:1] if left < 64 else np.argsort(-quotient, kind="stable")[: max(1, left // 8)]] += 1
    return out


def _taken(at, quota, blocks, start, block: int):
    """Words taken among a shard's first `at` words."""
    whole = F.floor(at / block)
    full, more = F.floor(quota / blocks), quota % blocks
    before = lambda j: F.floor((j * more + start) / blocks) - F.floor(start / blocks)  # noqa: E731  blocks before the j-th taken once more
    rest = at - whole * block
    return at * full + before(whole) * block + rest * (before(whole + 1) - before(whole))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, block: int = 8, shard_docs: int = 1024, seed: int = 17, max_sources: int = 1_000_000, fan: int = 1024) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    found = _dealt(docs, doc_id, source, text, weights, max_repeats, block, shard_docs, seed, max_sources, fan)
    each = found.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    start = F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.col("blocks"))
    words = lambda at: _taken(at, F.col("quota"), F.col("blocks"), start, block)
    begin = F.col("end") - F.col("size") * (F.col("n") - F.col("k"))
    return each.select("doc_id", "source", "size", "source_size", "target", (words(begin + F.col("size")) - words(begin)).cast("bigint").alias("taken"))


def _dealt(docs: DataFrame, doc_id: str, source: str, text: str, weights: Sequence[float], max_repeats: int, block: int, shard_docs: int, seed: int, max_sources: int, fan: int) -> DataFrame:
    """Every different document (n rows of it) with its source's size and target, its shard, that one's quota and blocks, and where it ends in it."""
    C.need(docs, doc_id, source, text)
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"))
    sized = C.cut(sized.groupBy("doc_id", "text_hash", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    rows = totals.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.source_size for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], max_repeats)
    quota = sainte_lague(goal, round(float(goal.sum()) / block), [max_repeats * -(-s // block) for s in sizes])
    plan = spark.createDataFrame(
        pd.DataFrame({"source": pd.Series([r.source for r in rows], dtype=object), "source_size": sizes, "target": goal, "source_quota": quota, "shards": [max(1, -(-r.n // shard_docs)) for r in rows]}).astype({"source_size": "int64", "shards": "int64", "target": "float64"}),
        "source string, source_size bigint, target double, source_quota bigint, shards bigint",
    )
    # the plan has one row per source, at most max_sources, and Spark broadcasts it only under its own size threshold
    key = F.xxhash64("doc_id", "text_hash", F.lit(seed))
    dealt = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.doc_id", "d.text_hash", "d.source", "d.size", "d.n", "p.source_size", "p.target", "p.source_quota", "p.shards", key.alias("key"))
    dealt = dealt.withColumn("shard", F.pmod(F.shiftrightunsigned("key", 20), F.col("shards")))
    each = dealt.groupBy("source", "source_quota", F.floor(F.col("shard") / fan).alias("group"), "shard").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    each = C.cut(each.withColumn("blocks", F.ceil(F.col("words") / block)), "shards")

    def deal(of: str, quota: str):
        def run(parts: pd.DataFrame) -> pd.DataFrame:
            parts = parts.sort_values(of)
            q = sainte_lague(parts["words"].to_numpy(), int(parts[quota].iloc[0]), max_repeats * parts["blocks"].to_numpy())
            return parts.assign(quota=q)[["source", of, "quota", "blocks"]]

        return run

    groups = each.groupBy("source", "source_quota", "group").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"))
    groups = groups.groupBy("source").applyInPandas(deal("group", "source_quota"), "source string, group bigint, quota bigint, blocks bigint").select("source", "group", F.col("quota").alias("group_quota"))
    same = F.col("e.source").eqNullSafe(F.col("g.source")) & (F.col("e.group") == F.col("g.group"))
    each = each.alias("e").join(C.cut(groups, "groups").alias("g"), same).select("e.source", "e.group", "e.shard", "e.words", "e.blocks", "g.group_quota")
    quotas = each.groupBy("source", "group").applyInPandas(deal("shard", "group_quota"), "source string, shard bigint, quota bigint, blocks bigint")
    quotas = C.cut(quotas.withColumn("blocks", F.greatest("blocks", F.lit(1))), "quotas")
    order = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("end", F.sum(F.col("size") * F.col("n")).over(order))
    same = F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard"))
    return laid.alias("d").join(quotas.alias("q"), same).select("d.*", "q.quota", "q.blocks")


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, block: int = 8, shard_docs: int = 1024, seed: int = 17, max_sources: int = 1_000_000, fan: int = 1024) -> DataFrame:
    """The mix as documents, with the columns of docs; texts without words go."""
    found = _dealt(docs, doc_id, source, text, weights, max_repeats, block, shard_docs, seed, max_sources, fan).where("size > 0")
    kind = found.schema["doc_id"].dataType.simpleString()

    def choose(shard: pd.DataFrame) -> pd.DataFrame:
        size, n = shard["size"].to_numpy(), shard["n"].to_numpy()
        order = np.lexsort((shard["text_hash"].to_numpy(), shard["key"].to_numpy(), -np.floor(np.log2(size))))
        words = float((size * n).sum())
        rate = min(float(max_repeats), int(shard["quota"].iloc[0]) * block / words)
        times, left = np.zeros(len(size), np.int64), 0.0
        for i in order.tolist():
            left += rate * size[i] * n[i]
            times[i] = min(max(math.floor(left / size[i] + 0.5), 0), max_repeats * n[i])
            left -= times[i] * size[i]
        return pd.DataFrame({"_id": shard["doc_id"], "_hash": shard["text_hash"], "_source": shard["source"], "_times": times, "_rows": n})

    stay = found.select("doc_id", "text_hash", "source", "shard", "key", "size", "n", "quota").groupBy("source", "shard").applyInPandas(choose, f"_id {kind}, _hash bigint, _source string, _times bigint, _rows bigint")
    stay = C.cut(stay.where("_times > 0"), "mix")
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    # a document that stands in n rows gives its copies from the first of them
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())).withColumn("_text_hash", F.xxhash64(own[text]))
    same = F.col(own[doc_id]).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")) & F.col(own[source]).cast("string").eqNullSafe(F.col("_source"))
    once, several = stay.where("_rows = 1"), stay.where("_rows > 1")
    first = rows.join(once, same)
    again = rows.join(several, same).groupBy("_id", "_hash", "_source", "_times").agg(F.min_by(F.struct(*own.values()), F.to_json(F.struct(*own.values()))).alias("row")).select("row.*", "_times")
    kept = first.select(*own.values(), "_times").unionByName(again)
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*(F.col(n).alias(c) for c, n in own.items()))


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words of it that the mix takes."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
