"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, with a calibrated score.

A text is lower-cased and every run of characters that are no letters becomes one space; its features are the n-grams of 1 to
`longest` characters, hashed to `buckets`, weighed (1 + log count) * idf and scaled to length 1.  Document frequencies are
counted over all training documents.

Weights come from follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a bounded sample of labelled documents: the
`per_label` of each label that come first by a hash of the id.  The sample is dealt into a fixed number of shards; each epoch every
shard runs on from the common state, and the states are averaged for the next one (iterative parameter mixing), so the result
does not depend on the cluster.  A fifth of the sample is left out of training: on it one temperature divides the logits so that the
log-likelihood is greatest.  The score is the calibrated probability of the label predicted.

Defined cases: a text that is null, empty or without a letter is `und` with score 0, as is every text where nothing was learned; a null label is
not learned from; documents with a null id are not held out; a text whose n-grams are all unknown goes by the weights of the constant; ties
go to the label first in order; repeated rows are documents each; texts of any length are taken whole, a piece of `PIECE` characters at a time; extra
columns are ignored; an empty table gives no rows.

Scale: three passes over texts (frequencies, sample, prediction), none of which shuffles a text outside the sample.  The frequencies are at most
`buckets` rows after the aggregation, the model is buckets x labels (`max_labels` is refused beyond), and both are broadcast at that bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticore.llm import common as C

#: Characters that one numpy pass handles.
PIECE = 1 << 20
UNKNOWN = "und"


@dataclass
class Model:
    """Labels in order, idf of each bucket, weights (buckets + 1 rows, the last is the constant's; labels columns), temperature."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    longest: int = 3

    @property
    def buckets(self) -> int:
        return len(self.idf)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of others than letters one space; empty where there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first of each run
    out = np.where(letter, codes, 32)[keep].astype(np.uint64)
    ends = [np.array([32], np.uint64)]
    return np.concatenate([*(ends if out[0] != 32 else []), out, *(ends if out[-1] != 32 else [])])


def counts(text: str, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (a power of 2) of a text's n-grams in order, and how often each occurs."""
    codes = characters(text)
    total: np.ndarray | int = 0
    shift = np.uint64(65 - buckets.bit_length())
    for a in range(0, len(codes), PIECE):
        piece = codes[a : a + PIECE + longest - 1]
        own = min(PIECE, len(codes) - a)
        h, found = np.zeros(len(piece), np.uint64), []
        for n in range(1, longest + 1):
            if len(piece) < n:
                break
            h = (h[: len(piece) - n + 1] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + piece[n - 1 :]
            found.append((h[:own] * np.uint64(0xD6E8FEB86659FD93)) >> shift)
        total = total + np.bincount(np.concatenate(found).astype(np.int64), minlength=buckets)
    at = np.flatnonzero(total)
    return at, total[at] if len(at) else at


def features(text: str | None, idf: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets (the constant's last) and TF-IDF values; None where the text has no letter."""
    at, n = counts(text or "", len(idf), longest)
    if not len(at):
        return None
    x = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(x @ x)
    return np.append(at, len(idf)), np.append(x / norm if norm > 0 else x, 1.0)


# ---------------------------------------------------------------- training


def document_frequencies(docs: DataFrame, *, text: str, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """The number of documents with a letter, and in how many of them each bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(buckets + 1, np.int64), 0
        for b in batches:
            for value in b.column(0):
                at, _ = counts(value.as_py() or "", buckets, longest)
                found[at] += 1
                n += len(at) > 0
        found[buckets] = n
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["bucket", "n"])

    got = docs.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets + 1, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return int(out[buckets]), out[:buckets]


def sample(docs: DataFrame, *, doc_id: str, text: str, label: str, per_label: int, shards: int) -> DataFrame:
    """text, label, order, shard and calibrate (a fifth) of at most `per_label` documents of each label: the first by a hash of id and text."""
    order = F.xxhash64(F.col(doc_id).cast("string"), text)
    rows = docs.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), order.alias("order"))
    share = docs.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("_of"))
    # a line on the hash that about 1.5 * per_label + 50 documents stay under leaves few to rank; `share` has a row a label, and there are at most max_labels
    few = rows.join(F.broadcast(share), "label").where(F.col("order") / 2.0**63 < 2 * (1.5 * per_label + 50) / F.col("_of") - 1)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("order", "text"))
    ranked = few.withColumn("_rank", rank).where(F.col("_rank") <= per_label)
    return ranked.select("text", "label", "order", (F.col("_rank") % shards).cast("int").alias("shard"), (F.floor(F.col("_rank") / shards) % 5 == 4).alias("calibrate"))


def _featured(rows: DataFrame, labels: list[str], idf, longest: int) -> DataFrame:
    """y, shard, order, calibrate, buckets and values of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {v: i for i, v in enumerate(labels)}
        for b in batches:
            found = [features(v.as_py(), idf.value, longest) for v in C.column(b, "text")]
            keep = pa.array([f is not None for f in found])
            some = [f for f in found if f is not None]
            y = pa.array([place[v] for v in C.column(b, "label").filter(keep).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [y, *(C.column(b, c).filter(keep) for c in ("shard", "order", "calibrate")), pa.array([f[0] for f in some], pa.list_(pa.int32())), pa.array([f[1] for f in some], pa.list_(pa.float32()))],
                ["y", "shard", "order", "calibrate", "buckets", "values"],
            )

    return rows.mapInArrow(run, "y int, shard int, order bigint, calibrate boolean, buckets array<int>, values array<float>")


def weights_of(z: np.ndarray, n: np.ndarray, rate: float, l1: float, l2: float) -> np.ndarray:
    """FTRL-proximal weights of a state: sums of shifted gradients z and of squared gradients n."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
    return -shrunk / ((1 + np.sqrt(n)) / rate + l2)


def learn(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, y: int, rate: float, l1: float, l2: float) -> None:
    """One document's step of multinomial logistic regression, in place."""
    own_z, own_n = z[at], n[at]
    w = weights_of(own_z, own_n, rate, l1, l2)
    p = x @ w
    p = np.exp(p - p.max())
    p /= p.sum()
    p[y] -= 1
    g = np.outer(x, p)
    more = own_n + g * g
    z[at] = own_z + g - (np.sqrt(more) - np.sqrt(own_n)) / rate * w
    n[at] = more


def _epoch(rows: DataFrame, state, k: int, rate: float, l1: float, l2: float) -> DataFrame:
    """label, z and n (bytes of doubles) after every shard has run on from the common state, averaged over shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, z, n = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), *(pa.array([np.ascontiguousarray(v[:, j]).tobytes() for j in range(k)], pa.binary()) for v in (z, n))], ["label", "z", "n"])

        for b in batches:
            at, x = C.column(b, "buckets"), C.column(b, "values")
            for i, (s, y) in enumerate(zip(C.column(b, "shard").to_pylist(), C.column(b, "y").to_pylist())):
                if s != shard:
                    if shard is not None:
                        yield out()
                    shard, (z, n) = s, (v.copy() for v in state.value)
                learn(z, n, at[i].values.to_numpy(), x[i].values.to_numpy().astype(float), y, rate, l1, l2)
        if shard is not None:
            yield out()

    def mean(pdf):
        pdf = pdf.sort_values("z")  # the same sum whatever order the shards come in
        return pdf[["label"]].head(1).assign(**{c: [(sum(np.frombuffer(v) for v in pdf[c]) / len(pdf)).tobytes()] for c in ("z", "n")})

    return rows.mapInArrow(run, "label int, z binary, n binary").groupBy("label").applyInPandas(mean, "label int, z binary, n binary")


def _logits(rows: DataFrame, weights) -> DataFrame:
    """y and logits of the rows of _featured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            at, x = C.column(b, "buckets"), C.column(b, "values")
            found = [x[i].values.to_numpy().astype(float) @ w[at[i].values.to_numpy()] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([C.column(b, "y"), pa.array(found, pa.list_(pa.float64()))], ["y", "logits"])

    return rows.mapInArrow(run, "y int, logits array<double>")


def temperature_of(rows: DataFrame, *, rounds: int = 4, grid: int = 17) -> float:
    """The temperature with the least mean negative log-likelihood of y under softmax(logits / temperature): grids, each between the neighbours of the best."""
    low, high, best = -4.0, 4.0, 0.0
    for _ in range(rounds):
        at = np.linspace(low, high, grid)
        top = F.array_max("logits")
        each = rows.select("y", "logits", top.alias("top"), F.posexplode(F.array(*(F.lit(float(np.exp(v))) for v in at))).alias("k", "t"))
        mass = F.aggregate("logits", F.lit(0.0), lambda a, v: a + F.exp((v - F.col("top")) / F.col("t")))
        loss = F.log(mass) - (F.element_at("logits", F.col("y") + 1) - F.col("top")) / F.col("t")
        found = {r["k"]: r["loss"] for r in each.groupBy("k").agg(F.avg(loss).alias("loss")).collect()}
        if not found:
            return 1.0
        k = min(found, key=lambda i: (found[i], abs(at[i])))
        best, low, high = at[k], at[max(k - 1, 0)], at[min(k + 1, grid - 1)]
    return float(np.exp(best))


def fit(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", buckets: int = 1 << 16, longest: int = 3, per_label: int = 1000, shards: int = 4,
    epochs: int = 3, rate: float = 0.5, l1: float = 0.02, l2: float = 0.02, max_labels: int = 200,
) -> Model:
    """A model of the labels of docs.  At most `per_label` documents of each label train and calibrate it; all of docs give the document frequencies."""
    C.need(docs, doc_id, text, label)
    if buckets < 2 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of 2")
    spark = docs.sparkSession
    C.short_batches(spark)
    labels = sorted(r[0] for r in docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().limit(max_labels + 1).collect())
    if len(labels) > max_labels:
        raise ValueError(f"more than max_labels={max_labels} labels")
    of, df = document_frequencies(docs, text=text, buckets=buckets, longest=longest)
    idf = np.log((1 + of) / (1 + df)) + 1
    k, sent = len(labels), spark.sparkContext.broadcast(idf)
    taken = sample(docs, doc_id=doc_id, text=text, label=label, per_label=per_label, shards=shards)
    rows = C.cut(_featured(taken, labels, sent, longest), "language")
    z, n = np.zeros((buckets + 1, k)), np.zeros((buckets + 1, k))
    dealt = rows.where("NOT calibrate").repartition(shards, "shard").sortWithinPartitions("shard", "order", "y")
    for _ in range(epochs if k else 0):
        state = spark.sparkContext.broadcast((z, n))
        for r in _epoch(dealt, state, k, rate, l1, l2).collect():
            z[:, r["label"]], n[:, r["label"]] = np.frombuffer(r["z"]), np.frombuffer(r["n"])
    weights = weights_of(z, n, rate, l1, l2)
    temperature = temperature_of(C.cut(_logits(rows.where("calibrate"), spark.sparkContext.broadcast(weights)), "language")) if k else 1.0
    return Model(labels, idf, weights.astype(np.float32), temperature, longest)


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), label: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns of `keep`, the label predicted from the text alone, and its calibrated probability."""
    C.need(docs, text, *keep)
    C.short_batches(docs.sparkSession)
    keep = tuple(c for c in dict.fromkeys(keep) if c not in (label, score))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(f"`{c}`" for c in keep)).schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            best, sure = [], []
            for v in C.column(b, text):
                f = features(v.as_py(), m.idf, m.longest) if m.labels else None
                if f is None:
                    best.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                logits = f[1] @ m.weights[f[0]].astype(float)
                i = int(np.argmax(logits))
                best.append(m.labels[i])
                sure.append(float(1 / np.exp((logits - logits[i]) / m.temperature).sum()))
            yield pa.RecordBatch.from_arrays([*(C.column(b, c) for c in keep), pa.array(best, pa.string()), pa.array(sure, pa.float64())], [*keep, label, score])

    return docs.select(*(f"`{c}`" for c in dict.fromkeys((*keep, text)))).mapInArrow(run, ", ".join([*fields, f"`{label}` string", f"`{score}` double"]))


def held_out(doc_id: str = "doc_id", of: int = 4, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == remainder, F.lit(False))


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
