"""N-gram Jaccard join by parity sketches, to the connected components of its links.

A document's set is its distinct 5-word shingles (with fewer words: all of them as one); two documents link where
intersection >= similarity * union.  Sets of a and b shingles that link differ in at most D = (1-s)/(1+s) * (a+b) shingles.

1. Equal sets are one node (two 64-bit hashes and the size), so copies cost nothing further.
2. Size bands: a set of n shingles is in band k, 2^k <= n < 2^(k+1), and in the next one if a partner can be there.  In
   band k a set is XOR-hashed into 2^k blocks: each block holds the parities of its shingles, as the XOR of
   their hashes.  A shingle in which two sets differ changes one block, so linked sets differ in at most D blocks, and of
   any D + 1 blocks of one of them that are not empty, one agrees with the other's (the pigeonholes).  Each set hands on its first D + 1
   blocks in an order that is the same for all sets: those of most shingles first, which chance or a common passage seldom makes
   agree.  A set with too few blocks that are not empty hands on all, and joins again with twice the blocks.  At a similarity of 0.5
   or less, more shingles may differ than there are blocks; sets then hand on the first of their shingles by hash, as many as linked sets must share one of.
3. Star round: a set is compared with the smallest node of each of its blocks, first by parity sketches, whose Hamming
   distance never exceeds the symmetric difference, then, if that leaves a link possible, by the shingles themselves.
4. In blocks that hold several components by then (blocks of the same members count once), sketches are compared within tiles of bounded
   size, and pairs of different components that may link are verified: first the likeliest for each set, and for each set and component, in the set's largest block, at last all in all blocks.  Only connectivity is asked for,
   so pairs within one component need no test; no pair of different components that share a block goes untested.

Defined cases: words are runs of bytes other than space and 0x09-0x0D, with A-Z lowered; a null or empty text has the empty set, which
links with nothing, not even another empty one; rows with the same id are judged one by one; ids of types other than integers are refused; a null id is in no order, so
a component's id is its smallest id that is not null; a similarity of exactly the threshold links; an empty table stays empty; extra columns are ignored.

Scale: what is shuffled is about 0.35 numbers for each shingle, twice, and the texts of documents that may link.  Keys are counted
with map-side combination and joined by splittable joins; a block's members are dealt to tiles of `tile` rows; components are found by
distributed label propagation with pointer jumping.  Nothing of the documents reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.llm import common as C

U = np.uint64
#: Pairs that a task remembers so as not to give them again.
SEEN = 200_000
#: Rows of (node, id, size, two hashes) that may be broadcast: some 50 MB.
MOST_BROADCAST = 300_000
BITS = 8  # bits of the sketch for each block of a set's own band


def shingles(w: C.Words, width: int, h: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    every = C.windows(h, width)
    for i in range(w.n):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        elif b > a:
            yield C.windows(h[a:b], b - a)
        else:
            yield np.zeros(0, U)


def most_apart(total: int, s: Fraction) -> int:
    """The largest symmetric difference of linked sets whose sizes add up to `total`."""
    return int((1 - s) * total // (1 + s))


def block_keys(u: np.ndarray, s: Fraction) -> np.ndarray:
    """The keys that a set with sorted distinct hashes u hands on."""
    n = len(u)
    if 2 * s <= 1:  # more may differ than there are blocks: the first shingles, of which linked sets share one
        return C.mix(u[: n - int(-(-s * n // 1)) + 1])
    own = n.bit_length() - 1
    values = C.mix(u ^ U(0x9E3779B97F4A7C15))
    out = []
    for band in (own, own + 1):
        top = min(int(n / s), (1 << band + 1) - 1)  # the largest partner in this band
        if band > own and int(n / s) < 1 << band:
            break
        need = most_apart(n + top, s) + 1
        level = band
        while True:
            block = u >> U(64 - level) if level else np.zeros(n, U)
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            parity = np.bitwise_xor.reduceat(values, starts)
            held = np.diff(np.concatenate([starts, [n]]))
            key = C.mix(parity + C.mix(block[starts] + U((band * 131 + level) * 0xD1B54A32D192ED03 % 2**64)))
            if len(key) > need:
                out.append(key[np.lexsort((key, -held))[:need]])
            else:
                out.append(key)
            if len(key) >= need:
                break
            level += 1
    return np.concatenate(out)


def sketch(u: np.ndarray) -> np.ndarray:
    """The parity of the shingles of each bit; the number of bits follows the set's band."""
    bits = max(64, BITS << (len(u).bit_length() - 1)) if len(u) else 64
    odd = np.bincount((u & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def folded(s: np.ndarray, words: int) -> np.ndarray:
    """The sketch with fewer bits: halves are added by XOR."""
    while len(s) > words:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def _sets(width: int, s: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two, keys, bits = [], [], [], [], []
            for _, _, w in C.slices(C.column(b, "_text"), lower=True):
                for u in shingles(w, width, w.hashes()):
                    n.append(len(u))
                    one.append(int(u.sum(dtype=U).astype(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(C.mix(u)).astype(np.int64)) if len(u) else 0)
                    keys.append(block_keys(u, s).astype(np.int64) if len(u) else np.zeros(0, np.int64))
                    bits.append(sketch(u).tobytes())
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([C.column(b, "_id"), C.column(b, "_hash"), C.column(b, "_row"), *(pa.array(x, pa.int64()) for x in (n, one, two)), flat, pa.array(bits, pa.binary())], ["id", "text_hash", "row", "n", "one", "two", "keys", "sketch"])

    return run


def _whole_sets(width: int):
    """The sets of the rows that are the nodes asked for (hashes decide among rows with the same id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, one, two = (C.column(b, c).to_pylist() for c in ("node", "n", "one", "two"))
            nodes, sets = [], []
            for a, _, w in C.slices(C.column(b, "_text"), lower=True):
                for i, u in enumerate(shingles(w, width, w.hashes()), a):
                    if len(u) == n[i] and int(u.sum(dtype=U).astype(np.int64)) == one[i] and int(np.bitwise_xor.reduce(C.mix(u)).astype(np.int64)) == two[i]:
                        nodes.append(node[i])
                        sets.append(u.tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    return run


def _near(s: Fraction):
    """Pairs whose sketches leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, x, y in zip(*(C.column(b, c).to_pylist() for c in ("n", "m", "x", "y"))):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                words = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                keep.append(apart <= most_apart(n + m, s))
            yield pa.RecordBatch.from_arrays([C.column(b, "a"), C.column(b, "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(s: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(C.column(b, "x").to_pylist(), C.column(b, "y").to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * s.denominator >= s.numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([C.column(b, "a"), C.column(b, "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tiles(s: Fraction, most: str):
    """In each tile (its rows come together, sorted): pairs of different components that may link.

    `most`: "one" gives the likeliest for each set, "each" the likeliest for each set and other component, "all" all.
    """

    def pairs(rows: list) -> Iterator[tuple[int, int]]:
        words = min(len(r[5]) for r in rows) // 8
        sketches = np.stack([folded(np.frombuffer(r[5], U), words) for r in rows])
        node, comp, n, chunk = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
        across = chunk[0] != chunk[-1] or len(np.unique(chunk)) > 1
        for i in range(len(rows) - 1):
            m, c = n[i + 1 :], comp[i + 1 :]
            ok = (c != comp[i]) & (np.minimum(m, n[i]) * s.denominator >= np.maximum(m, n[i]) * s.numerator)
            if across:
                ok &= chunk[i + 1 :] != chunk[i]
            j = np.flatnonzero(ok) + i + 1
            if not len(j):
                continue
            apart = np.bitwise_count(sketches[j] ^ sketches[i]).sum(axis=1, dtype=np.int64)
            ok = apart * (s.numerator + s.denominator) <= (n[j] + n[i]) * (s.denominator - s.numerator)
            j, apart = j[ok], apart[ok]
            if most == "one" and len(j) > 1:
                j = j[[int(apart.argmin())]]
            elif most == "each" and len(j) > 1:
                order = np.lexsort((apart, comp[j]))
                j = j[order]
                j = j[np.flatnonzero(np.concatenate([[True], comp[j][1:] != comp[j][:-1]]))]
            for k in j.tolist():
                yield (int(min(node[i], node[k])), int(max(node[i], node[k])))

    def out(rows: list, seen: set) -> Iterator[pa.RecordBatch]:
        found = [x for x in dict.fromkeys(pairs(rows)) if x not in seen] if len(rows) > 1 else []
        if len(seen) > SEEN:
            seen.clear()
        seen.update(found)
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, seen = None, [], set()  # pairs that this task has given lately
        for b in batches:
            for tile, r in zip(zip(*(C.column(b, c).to_pylist() for c in ("key", "p", "q"))), zip(*(C.column(b, c).to_pylist() for c in ("key", "node", "comp", "n", "chunk", "sketch")))):
                if tile != now:
                    if rows:
                        yield from out(rows, seen)
                    now, rows = tile, []
                rows.append(r)
        if rows:
            yield from out(rows, seen)

    return run


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps after more links: these connect components, each of which counts as one node."""
    side = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    edges = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    edges = edges.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).where("a <> b").distinct()
    high = components(C.cut(edges, "links")).select(F.col("node").alias("of"), F.col("comp").alias("to"))
    old = comps.join(high, comps["comp"] == F.col("of"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = high.join(comps, F.col("of") == comps["node"], "left_anti").select(F.col("of").alias("node"), F.col("to").alias("comp"))
    return C.cut(old.unionByName(new), "labels")


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node it is connected with) of every node of the edges (a, b)."""
    both = C.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = C.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        hop = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new = labels.join(hop, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("far"))
        after = C.cut(new.join(jump, "to").select("node", F.least("to", "far").alias("comp"), "old"), "labels")
        C.drop(labels)
        labels = after.select("node", "comp")
        if after.where("comp <> old").isEmpty():
            C.drop(both)
            return labels


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: str = "0.75", width: int = 5, tile: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, component (unique; null for an empty set) and text_hash of every row."""
    C.need(docs, doc_id, text)
    C.need_integer(docs, doc_id)
    C.short_batches(docs.sparkSession)
    s = Fraction(similarity)
    if not 0 < s <= 1:
        raise ValueError("a similarity over 0 and up to 1")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    whole = C.cut(numbered.mapInArrow(_sets(width, s), "id bigint, text_hash bigint, row bigint, n bigint, one bigint, two bigint, keys array<bigint>, sketch binary"), "sets")
    found = C.cut(whole.drop("keys", "sketch"), "sizes")
    named = C.cut(found.where("n > 0").groupBy("n", "one", "two").agg(F.min("id").alias("id"), F.min("row").alias("node")), "nodes")
    one_each = whole.drop("n").join(_small(named.select("node", "n")), F.col("row") == F.col("node"))
    sketches = C.cut(one_each.select("node", "n", "sketch"), "sketches")

    keys = one_each.select("node", F.explode("keys").alias("key"))
    shared = C.cut(keys.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    held = C.cut(keys.join(shared, "key").select("key", "node", "low", "m"), "held")
    C.drop(whole, shared)

    star = held.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    near = star.join(sketches.select(F.col("node").alias("a"), "n", F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    ratio = F.least("n", "m") * s.denominator >= F.greatest("n", "m") * s.numerator
    near = C.cut(near.where(ratio).mapInArrow(_near(s), "a bigint, b bigint"), "near")
    comps = components(_verified(rows, named, near, width, s))
    C.drop(near)

    wide = C.cut(held.where("m > 2 and node <> low").select("key", "node"), "wide")
    C.drop(held)
    for most in ("one", "one", "each", "all"):
        now = wide.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # blocks with more than one component; of blocks with the same members, one
        members = (F.bit_xor(F.xxhash64("node")).alias("u"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("v"))
        mixed = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m"), *members).where("x < y")
        mixed = C.cut(mixed.groupBy("m", "u", "v").agg(F.min("key").alias("key")).select("key", "m"), "mixed")
        if mixed.isEmpty():
            break
        dealt = now.join(mixed, "key")
        if most != "all":  # the rounds before the last: each set in its largest block only
            dealt = C.cut(dealt, "blocks")
            largest = dealt.groupBy("node").agg(F.max(F.struct("m", "key")).alias("top")).select("node", "top.key")
            dealt = dealt.join(largest, ["node", "key"])
        chunks = F.ceil(F.col("m") / tile).cast("int")
        dealt = dealt.join(sketches, "node").withColumns({"chunk": F.pmod(F.xxhash64("node"), chunks).cast("int"), "other": F.explode(F.sequence(F.lit(0), chunks - 1))})
        # a tile is the rows of two chunks; those of one chunk alone are the tile (chunk, chunk)
        dealt = dealt.select("key", "node", "comp", "n", "chunk", "sketch", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"))
        tiles = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_tiles(s, most), "a bigint, b bigint")
        more = C.cut(tiles.distinct(), "near")
        if not more.isEmpty():
            comps = merged(comps, _verified(rows, named, more, width, s))
        C.drop(mixed, more)
    C.drop(wide, sketches)

    named = named.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = C.cut(named.select("n", "one", "two", "comp"), "named").join(C.cut(least, "least"), "comp").select("n", "one", "two", "comp", "component_id")
    out = found.select("id", "text_hash", "n", "one", "two").join(C.cut(named, "named"), ["n", "one", "two"], "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("comp").alias("component"), "text_hash")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: str = "0.75", width: int = 5) -> DataFrame:
    """The documents without all but one of each component: the one of smallest id stays (ties: of the smaller text hash).

    Texts without words are in no component and all stay.
    """
    found = jaccard_components(docs, doc_id=doc_id, text=text, similarity=similarity, width=width).where("component is not null")
    best = F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id).alias("_id"), F.col("text_hash"))).alias("best")
    stay = C.cut(found.groupBy("component").agg(best).select("best._id", F.col("best.text_hash").alias("_hash")), "stay")
    wordless = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    keyed = docs.withColumn("_hash", F.xxhash64(text))
    held = keyed.where(~wordless).join(stay, F.col(doc_id).cast("bigint").eqNullSafe(stay["_id"]) & (keyed["_hash"] == stay["_hash"]), "left_semi")
    return held.dropDuplicates([doc_id, "_hash"]).select(docs.columns).unionByName(docs.where(wordless))


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast only where it is counted to be small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, s: Fraction) -> DataFrame:
    """The pairs that link, by their whole sets."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = C.cut(asked.join(nodes.select("node", "id", "n", "one", "two"), "node"), "asked")
    texts = rows.join(_small(asked), rows["_id"].eqNullSafe(asked["id"])).select("_text", "node", "n", "one", "two")
    sets = C.cut(texts.mapInArrow(_whole_sets(width), "node bigint, set binary").dropDuplicates(["node"]), "whole")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    links = C.cut(both.mapInArrow(_linked(s), "a bigint, b bigint"), "links")
    C.drop(asked, sets)
    return links


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with the component of its links at 0.75 of 5-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
