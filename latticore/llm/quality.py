"""Quality rules whose cutoffs are certified on labelled documents: limited false rejection in every stratum.

Each rule is a ratio of a text, in whole percent; a document is rejected where a rule's value is over the cutoff of its
stratum.  A stratum's cutoffs are certified together, as one vector, on its labelled documents: good ones serve as the holdout,
all of them.  Vectors are tried in a fixed order from the loosest on, each a percent point lower in one rule than the one
before it.  The order never looks at the good documents that test it: it comes from the bad ones and the documents without a
label, the rule and range next that take most bad documents for each unlabelled one (where all are labelled: for each percent
point).  A vector is certified while the exact (Clopper-Pearson) upper bound on the share of good documents that any rule
rejects stays within `max_false_rejection`.  Testing in a fixed order needs no correction for the number of vectors or rules;
the error probability `error` is divided evenly over strata (Bonferroni), so with probability 1 - error no stratum loses
more than `max_false_rejection` of its good documents to all rules together.  Of the certified vectors, the one with the
greatest difference between the shares of bad and of good labelled documents rejected is taken (ties: the loosest).  A rule
that this vector leaves at 100 is off, and all are where nothing is separated or labels are too few to certify any vector.

Defined cases: a null text has no words and fails the base rules; labels that are null are ignored, and a document with
several labels counts as good if one says so, and one with several rows is one labelled case, of the row that goes first; a null stratum is a stratum of its own; without labels, or with an empty
table of documents, no rule is certified and only the base rules reject; repeated document rows are judged alike.

Scale: one pass over the texts writes a narrow table of counts per document (no text is shuffled); it meets the labels by
document id, and is counted twice with map-side combination: the rules' values one by one (strata x rules x 101 x 2), which give
the order, and the step that first rejects each labelled document (strata x 601 x 2), which certifies.  Cutoffs are one row
per stratum, and Spark broadcasts them only under its own size threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.llm import common as C

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits"]
#: Rule: percent of the first count in the second, at most 100.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_upper", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "digits": ("n_digits", "word_chars"),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text."""
    out: dict[str, list] = {c: [] for c in COUNTS}
    for _, _, w in C.slices(texts):
        data, per = w.data, lambda mask, w=w: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
        space = C._SPACE[data]
        out["n_words"].append(w.counts())
        out["word_chars"].append(per(~space & ((data & 0xC0) != 0x80)))
        out["n_symbols"].append(per(_SYMBOL[data]))
        out["n_upper"].append(per((data >= 65) & (data <= 90)))
        out["n_marks"].append(per(_MARK[data]))
        out["n_digits"].append(per((data >= 48) & (data <= 57)))
        lines, dup = _lines(w)
        out["n_lines"].append(lines)
        out["n_dup_lines"].append(dup)
        out["n_repeat_words"].append(_repeats(w))
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()}


def _lines(w: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier one."""
    lines, dup = np.zeros(w.n, np.int64), np.zeros(w.n, np.int64)
    for i in range(w.n):
        text = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
        if w.first[i] < w.first[i + 1]:
            own = [x for x in text.split(b"\n") if x and not x.isspace()]
            lines[i] = len(own)
            dup[i] = len(own) - len(set(own))
    return lines, dup


def _repeats(w: C.Words) -> np.ndarray:
    """Words in a 3-word window that the same text has twice or more."""
    h, doc = w.hashes(), w.doc()
    n = len(h) - 2
    if n < 1:
        return np.zeros(w.n, np.int64)
    key = C.windows(h, 3) + C.mix(doc[:n].astype(C.U) + C.U(1))
    key[doc[:n] != doc[2:]] = 0  # windows over a text's end
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    covered = np.zeros(len(h), bool)
    at = np.concatenate([order[same], order[same + 1]])
    at = at[key[at] != 0]
    for k in range(3):
        covered[at + k] = True
    return np.bincount(doc[covered], minlength=w.n)


def counted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep` and the counts of each text."""
    C.need(docs, doc_id, text, *keep)
    keep = tuple(c for c in dict.fromkeys(keep) if c != doc_id)
    C.short_batches(docs.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(f"`{c}`" for c in (doc_id, *keep))).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([C.column(b, c) for c in (doc_id, *keep)] + [pa.array(v) for v in text_counts(C.column(b, text)).values()], [doc_id, *keep, *COUNTS])

    return docs.select(*(f"`{c}`" for c in dict.fromkeys((doc_id, *keep, text)))).mapInArrow(run, ", ".join([*fields, *(f"{c} bigint" for c in COUNTS)]))


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact upper confidence bound (Clopper-Pearson) on a share of which k of n were seen."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):  # P(at most k) falls in p
        p = (low + high) / 2
        terms = [a + i * math.log(p) + (n - i) * math.log1p(-p) for i, a in enumerate(logs)] if 0 < p < 1 else [-math.inf]
        top = max(terms)
        tail = math.exp(top) * sum(math.exp(t - top) for t in terms) if top > -math.inf else 0.0
        low, high = (p, high) if tail > error else (low, p)
    return high


def certified_cutoff(good: np.ndarray, bad: np.ndarray, max_false: float, error: float) -> int | None:
    """The cutoff taken from histograms of good and bad documents over values from 0; None where none helps."""
    n, m = int(good.sum()), int(bad.sum())
    best, gain = None, 0.0
    over_good = over_bad = 0
    for cutoff in range(len(good) - 2, -1, -1):  # documents over the cutoff go
        over_good += int(good[cutoff + 1])
        over_bad += int(bad[cutoff + 1])
        if upper_bound(over_good, n, error) > max_false:
            break
        if m and (g := over_bad / m - over_good / n) > gain + 1e-12:
            best, gain = cutoff, g
    return best


def levels(bad: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The order of the vectors, from histograms (rules x 101) of bad documents and of those without a label.

    A vector is a level: a rule rejects a value where the value's level is over it.  Value 0 has level 0; the others have
    1 to 100 x rules, the greatest first to go, and within a rule greater values have greater levels.
    """
    out = np.zeros(bad.shape, np.int64)
    at, left = [100] * len(bad), 100 * len(bad)  # the next value of each rule to go
    while left:
        best, taken = (-1.0, 0), 0
        for r, v in enumerate(at):
            if v:
                more = np.cumsum(others[r, v:0:-1]) + np.arange(1, v + 1) / 100  # the last: where there are none
                ratio = np.cumsum(bad[r, v:0:-1]) / more
                n = int(np.argmax(ratio))
                if ratio[n] > best[0]:
                    best, taken = (ratio[n], r), n + 1
        for _ in range(taken):
            out[best[1], at[best[1]]] = left
            at[best[1]] -= 1
            left -= 1
    return out


def _percent(a: str, b: str):
    return F.when(F.col(b) > 0, F.least(F.lit(100), F.floor(100 * F.col(a) / F.col(b)))).otherwise(0).cast("int")


def certified_cutoffs(features: DataFrame, labels: DataFrame, *, stratum: str, doc_id: str = "doc_id", label: str = "quality", max_false_rejection: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per stratum with labels: _stratum (null as the empty string, others after '='), and each rule's cutoff or null."""
    C.need(features, doc_id, stratum)
    C.need(labels, doc_id, label)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max((F.col(label) > 0).cast("int")).alias("_good"))
    rows = features.join(known, doc_id, "left").select(F.col(doc_id).alias("_doc"), _stratum(stratum), "_good", F.array(*(_percent(*r) for r in RULES.values())).alias("_values"))
    rows = C.cut(rows, "quality")
    hist = rows.where("_good IS NULL OR _good = 0").select("_stratum", "_good", F.posexplode("_values").alias("_rule", "_bin"))

    def order(h: pd.DataFrame) -> pd.DataFrame:
        both = np.zeros((2, len(RULES), 101), np.int64)
        both[h["_good"].isna().to_numpy().astype(int), h["_rule"].to_numpy(), h["_bin"].to_numpy()] = h["count"].to_numpy()
        return pd.DataFrame([{"_stratum": h["_stratum"].iloc[0], "_levels": levels(both[0], both[1]).ravel().tolist()}])

    paths = hist.groupBy("_stratum", "_good", "_rule", "_bin").count().groupBy("_stratum").applyInPandas(order, "_stratum string, _levels array<int>")
    paths = C.cut(paths, "quality")
    first = F.array_max(F.transform("_values", lambda v, k: F.element_at("_levels", (k * 101 + v + 1).cast("int"))))
    # a labelled document is one case, however many rows it has: the one that goes first
    cases = rows.where("_good IS NOT NULL").join(paths, "_stratum").groupBy("_stratum", "_good", "_doc").agg(F.max(first).alias("_level"))
    steps = cases.groupBy("_stratum", "_good", "_level").count()
    steps = C.cut(steps, "quality")
    share = error / max(1, rows.where("_good IS NOT NULL").select("_stratum").distinct().count())

    def fit(h: pd.DataFrame) -> pd.DataFrame:
        both = np.zeros((2, 100 * len(RULES) + 1), np.int64)
        both[h["_good"].to_numpy(), h["_level"].to_numpy()] = h["count"].to_numpy()
        c = certified_cutoff(both[1], both[0], max_false_rejection, share)
        own = np.array(h["_levels"].iloc[0]).reshape(len(RULES), 101)
        cutoffs = np.full(len(RULES), 100) if c is None else (own <= c).sum(axis=1) - 1
        return pd.DataFrame([{"_stratum": h["_stratum"].iloc[0], **dict(zip(RULES, cutoffs.tolist()))}])

    found = steps.join(paths, "_stratum").groupBy("_stratum").applyInPandas(fit, "_stratum string, " + ", ".join(f"`{r}` int" for r in RULES))
    return C.cut(found.select("_stratum", *(F.when(F.col(r) < 100, F.col(r)).alias(r) for r in RULES)), "quality")


def _stratum(name: str):
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")).alias("_stratum")


def judged(features: DataFrame, cutoffs: DataFrame, *, stratum: str) -> DataFrame:
    """features with base_failed, kept and failed_rules."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.filter(F.array(*(F.when(_percent(*r) > F.col(f"_c.{name}"), F.lit(name)) for name, r in RULES.items())), lambda x: x.isNotNull())
    joined = features.withColumn("_stratum", _stratum(stratum)).alias("_f").join(cutoffs.alias("_c"), "_stratum", "left")
    out = joined.select("_f.*", base.alias("base_failed"), failed.alias("failed_rules")).drop("_stratum")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_false_rejection: float = 0.02, error: float = 0.05) -> DataFrame:
    """doc_id, stratum, counts, base_failed, failed_rules and kept of every document."""
    features = C.cut(counted(docs, doc_id=doc_id, text=text, keep=(stratum,)), "counts")
    cutoffs = certified_cutoffs(features, labels, stratum=stratum, doc_id=doc_id, label=label, max_false_rejection=max_false_rejection, error=error)
    return judged(features, cutoffs, stratum=stratum)


def keep_quality(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_false_rejection: float = 0.02, error: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with the columns of docs; texts are not shuffled."""
    features = C.cut(counted(docs, doc_id=doc_id, text=text, keep=(stratum,)), "counts")
    cutoffs = certified_cutoffs(features, labels, stratum=stratum, doc_id=doc_id, label=label, max_false_rejection=max_false_rejection, error=error)
    clash = set(docs.columns) & {*COUNTS, "_stratum", "base_failed", "failed_rules", "kept"}
    hidden = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    names = {f"_own_{c}" if c in clash else c: c for c in docs.columns}
    every = counted(hidden, doc_id=doc_id, text=text, keep=tuple(n for n in names if n != doc_id))
    return judged(every, cutoffs, stratum=stratum).where("kept").select(*(F.col(f"`{n}`").alias(c) for n, c in names.items()))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document judged by the base rules and the certified ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
