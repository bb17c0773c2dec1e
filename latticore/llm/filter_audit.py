"""What a chain of filters does in every order: failures of each document as a bit mask, counted in 32 cells a part.

Five filters, A to E, are conditions of failure on a whole text; a document's mask has a bit for each that it fails.  A to D are
native expressions of the text; E (a copy of a text that a smaller doc_id holds) compares the doc_id with the minimum that a
group-by on the text supplies.  Documents are counted by part and mask, with those of good quality and toxic ones, and all that
the orders of the filters do follows from these 32 cells: a filter at step k removes the cells with its bit and no bit of
the steps before it.

Defined cases: a null text is the empty text; a null part is the empty string; the order of ids is the column's own, and a null doc_id
comes after all others, so it is a copy where any other document holds the text, and no label belongs to it; rows alike in
doc_id and text are no copies of each other, and each counts; of several labels of a document any that says 1 counts; a label of a null doc_id or
a null label says nothing; a document without words fails A and passes B; a text without characters passes C; extra columns are ignored; an empty table has no parts,
so no rows.

Scale: texts are shuffled once, by the group-by on the text, which keeps one row a distinct text and task, so copies meet as
partial minima; that shuffle and the narrow rows (id, part, digest, mask) are all that moves.  First holders meet their documents
by id and SHA-256 of the text.  Documents without an id are spread over the tasks by their digest.  Orders are built from the cells, at most 32 a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticore.llm import common as C

SPACE = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]


def masked(docs: DataFrame, *, text: str, min_words: int = 100, min_distinct: int = 80, max_capitals: int = 10, marks: str = "#$%&*|") -> DataFrame:
    """docs with `_own`: bits 0 to 3 say that the text has too few words, too small a percentage of distinct words, too great a one of capitals, any of the marks."""
    words = docs.withColumn("_words", F.array_remove(F.split(text, SPACE), ""))
    sizes = words.withColumns({"_n": F.size("_words").cast("bigint"), "_distinct": F.size(F.array_distinct("_words")).cast("bigint")})
    failed = [
        F.col("_n") < min_words,
        100 * F.col("_distinct") < min_distinct * F.col("_n"),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint") > max_capitals * F.length(text).cast("bigint"),
        F.col(text).rlike("[" + "".join("\\" + m for m in marks) + "]"),
    ]
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)]
    return sizes.withColumn("_own", sum(bits[1:], bits[0])).drop("_words", "_n", "_distinct")


def masks(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang", good: str = "quality", toxic: str = "toxic", **limits) -> DataFrame:
    """doc_id, part, mask (bit i: the i-th filter fails), good, toxic and n: rows alike in all of these and in their text are one, counted in n."""
    C.need(docs, doc_id, text, part)
    C.need(labels, doc_id, good, toxic)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    digest = F.coalesce(F.unhex(F.sha2(F.col("_text").cast("binary"), 256)), F.lit(b"")).alias("_digest")  # never null, so that no join looks for nulls
    holders = own.groupBy("_text").agg(F.min("doc_id").alias("_id")).where("_id IS NOT NULL")
    # the first holder's own key, and one that documents without an id find
    first = holders.select(F.explode(F.array("_id", F.lit(None))).alias("_id"), digest, F.lit(True).alias("_held")).withColumnRenamed("_digest", "_of")
    rows = masked(own, text="_text", **limits).groupBy("doc_id", "part", digest, "_own").agg(F.count(F.lit(1)).alias("n"))
    met = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of")), "left")
    copy = F.col("_held").isNotNull() == F.col("doc_id").isNull()
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("string").alias("_key")).agg(says(good).alias("good"), says(toxic).alias("toxic"))
    spread = met.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.hex("_digest"))))  # documents without an id meet no label
    joined = spread.join(known, "_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("doc_id", "part", (F.col("_own") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"), zero("good"), zero("toxic"), "n")


def cells(rows: DataFrame) -> DataFrame:
    """part and three arrays of 32: documents, good and toxic ones by mask."""
    counts = rows.groupBy("part", "mask").agg(*(F.sum(F.col("n") * F.col(w) if w else F.col("n")).alias(k) for k, w in (("n", None), ("good", "good"), ("toxic", "toxic"))))
    at = lambda k, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(k))), F.lit(0).cast("bigint"))
    return counts.groupBy("part").agg(*(F.array(*(at(k, m) for m in range(32))).alias(k) for k in ("n", "good", "toxic")))


def every_order(found: DataFrame) -> DataFrame:
    """The report, from cells(): part, filter_order, step, and what the step's filter does there."""

    def total(counts: str, holds) -> Column:
        return F.aggregate(F.transform(counts, lambda n, m: F.when(holds(m), n).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a + x)

    orders = found.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    bits = F.transform(F.sequence(F.lit(1), F.lit(len(LETTERS))), lambda k: F.pow(F.lit(2), F.instr(F.lit(LETTERS), F.substring("filter_order", k, F.lit(1))) - 1).cast("int"))
    steps = orders.withColumn("_bits", bits).select("*", F.posexplode("_bits").alias("_at", "_bit"))
    placed = steps.select("*", F.aggregate(F.slice("_bits", F.lit(1), F.col("_at")), F.lit(0), lambda a, b: a + b).alias("_before"))
    hit, earlier = (lambda m: m.bitwiseAND(F.col("_bit")) > 0), (lambda m: m.bitwiseAND(F.col("_before")) > 0)
    # of the orders of a cell's failing filters each is first equally often
    first = F.aggregate(
        F.transform("n", lambda n, m: F.when(hit(m), n * (F.lit(len(ORDERS)) / F.bit_count(m)).cast("bigint")).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    return placed.select(
        "part", "filter_order", (F.col("_at") + 1).alias("step"),
        total("n", lambda m: ~hit(m) & ~earlier(m)).alias("kept"),
        total("n", lambda m: hit(m) & ~earlier(m)).alias("removed"),
        total("n", lambda m: hit(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == F.col("_bit")).alias("unique_fails"),
        total("good", lambda m: hit(m) & ~earlier(m)).alias("good_lost"),
        total("toxic", lambda m: hit(m) & ~earlier(m)).alias("toxic_lost"),
        first.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: five rows for each part and order."""
    return every_order(C.cut(cells(masks(docs, labels, **names)), "cells"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The five filters in all 120 orders, by language."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS holder FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN w.doc_id > holder THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l USING (doc_id)
),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
r AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN translate(fails, before || x, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM r
"""
