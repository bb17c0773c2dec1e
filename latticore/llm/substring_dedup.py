"""Substring deduplication: documents streamed through suffix automata of the texts that held a passage first.

A window is `width` consecutive words.  A word goes if a window over it also starts in a document with a smaller id.

1. Every window has an anchor, the least hash of its 6-word runs, so equal windows have equal anchors.  Anchors are
   counted with map-side combination; one that several documents have is shared, and its first holder is its smallest document.
2. The first holders' text around shared anchors makes the reference shards, one suffix automaton for each holder.  The
   runs of windows in later documents whose anchors have that holder are streamed through its automaton; matching
   statistics of at least `width` give the maximal spans that it holds, and they go.
3. A window that its anchor's first holder lacks may still be in another smaller document; then it is left over there
   as well, as all holders of an anchor are compared with the same shard.  Left-over windows are compared with one another by their very words.

Hashes only decide what is compared; the automaton or the words themselves decide what goes.  An automaton is not
broadcast to all executors, as the shards grow with the data; it is sent to as many tasks as its share of the stream needs.

Defined cases: words are runs of bytes other than space and 0x09-0x0D, compared unchanged; a null text has none; texts
below `width` words lose nothing; a null document id is after all others; ids of types other than integers are refused; rows with the same id are never smaller than one
another; ties cannot arise, as only a smaller id counts; an empty table stays empty; extra columns are kept (result columns replace theirs).

Scale: what is shuffled is one row of three numbers for each 4 to 5 words, the text twice (by document id), and repeated
text once.  Anchors on a third of the documents are pre-aggregated and joined by a splittable join; a first holder that
much of the stream matches is sent to many tasks, by `stream_words`.  No group is held in memory but one first holder's repeated text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.llm import common as C

GRAM = 6
LAST = (1 << 63) - 1


class SuffixAutomaton:
    """All runs of the texts added, whole texts apart."""

    __slots__ = ("next", "link", "length")

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words: list) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for c in words:
            q = nexts[last].get(c)
            if q is not None:  # already a run of an earlier text
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def _clone(self, p: int, c, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        k = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = k
        while p != -1 and nexts[p].get(c) == q:
            nexts[p][c] = k
            p = link[p]
        return k

    def statistics(self, words: list) -> list[int]:
        """For each position, how many words up to it the texts hold in one run."""
        nexts, link, length = self.next, self.link, self.length
        v = n = 0
        out = []
        for c in words:
            to = nexts[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nexts[v].get(c)
            if to is not None:
                v = to
                n += 1
            out.append(n)
        return out


def _anchors(w: C.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of the window at each word, whether a window of one text starts there)."""
    h = w.hashes()
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    least, span = C.windows(h, GRAM), 1
    runs = width - GRAM + 1
    while span < runs:
        step = min(span, runs - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    doc = w.doc()
    return least.astype(np.int64), doc[:n] == doc[width - 1 :]


def _anchor_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, salts = (C.column(b, c).to_numpy(zero_copy_only=False) for c in ("_doc", "_salt"))
            for a, _, w in C.slices(C.column(b, "_text")):
                anchor, starts = _anchors(w, width)
                if not len(anchor):
                    continue
                doc = w.doc()[: len(anchor)]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~starts[:-1]
                at = np.flatnonzero(starts & new)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(ids[a + doc[at]]), pa.array(salts[a + doc[at]])], ["anchor", "doc", "salt"])

    return run


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal keys at consecutive windows, as (first, last)."""
    if len(keys):
        edge = np.flatnonzero(np.diff(keys) != 0)
        yield from zip(np.concatenate([[0], edge + 1]).tolist(), np.concatenate([edge, [len(keys) - 1]]).tolist())


def _passages(width: int):
    """From documents with their shared anchors: the passages that make shards (kind 0) or are streamed through one (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, salts, anchors, firsts = (C.column(b, c) for c in ("_doc", "_salt", "anchors", "firsts"))
            rows: list[tuple] = []
            for a, z, w in C.slices(C.column(b, "_text")):
                anchor, starts = _anchors(w, width)
                for i in range(a, z):
                    doc, salt = ids[i].as_py(), salts[i].as_py()
                    lo, hi = int(w.first[i - a]), int(w.first[i - a + 1]) - width + 1
                    if hi <= lo:
                        continue
                    known, first = (np.asarray(x[i].values) for x in (anchors, firsts))
                    order = np.argsort(known)
                    known, first = known[order], first[order]
                    at = np.minimum(np.searchsorted(known, anchor[lo:hi]), len(known) - 1)
                    holder = np.where(known[at] == anchor[lo:hi], first[at], -LAST)
                    for x, y in _runs(holder):
                        r = int(holder[x])
                        if r == -LAST:
                            continue
                        text = b" ".join([w.word(k) for k in range(lo + x, lo + y + width)])
                        rows.append((r, int(r != doc), doc, salt, x, y - x + width, text))
            if rows:
                r, k, d, s, x, n, t = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(k, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(x, pa.int64()), pa.array(n, pa.int64()), pa.array(t, pa.binary())], ["holder", "kind", "doc", "salt", "start", "n", "words"])

    return run


def _streamed(width: int):
    """Shards and streams, sorted: spans found (words null) and windows left over (with their words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, SuffixAutomaton()
        for b in batches:
            rows: list[tuple] = []
            cols = [C.column(b, c).to_pylist() for c in ("holder", "part", "kind", "doc", "salt", "start", "words")]
            for holder, part, kind, doc, salt, start, text in zip(*cols):
                if (holder, part) != now:
                    now, automaton = (holder, part), SuffixAutomaton()
                words = text.split(b" ")
                if not kind:
                    automaton.add(words)
                    continue
                end = 0
                spans: list[list[int]] = []
                for i, n in enumerate(automaton.statistics(words)):
                    if n >= width:
                        if spans and i - n + 1 <= spans[-1][1]:
                            spans[-1][1] = i + 1
                        else:
                            spans.append([i - n + 1, i + 1])
                    elif i >= width - 1:
                        rows.append((doc, salt, start + i - width + 1, start + i + 1, b" ".join(words[i - width + 1 : i + 1])))
                rows += [(doc, salt, start + x, start + end, None) for x, end in spans]
            if rows:
                d, s, x, e, t = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (d, s, x, e)), pa.array(t, pa.binary())], ["doc", "salt", "start", "end", "words"])

    return run


def _finish(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept, merged = [], [], [], []
            for text, spans in zip(C.binary(C.column(b, "_text")), C.column(b, "spans")):
                words = text.as_py().split()
                flat = spans.as_py() or []
                flat = sorted(zip(flat[::2], flat[1::2]))
                whole: list[list[int]] = []
                for x, y in flat:
                    if whole and x <= whole[-1][1]:
                        whole[-1][1] = max(whole[-1][1], y)
                    else:
                        whole.append([x, y])
                n_words.append(len(words))
                n_removed.append(sum(y - x for x, y in whole))
                for x, y in reversed(whole):
                    del words[x:y]
                kept.append(b" ".join(words))
                merged.append([v for s in whole for v in s])
            yield pa.RecordBatch.from_arrays([*(C.column(b, n) for n in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(merged, pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "spans", "kept"])

    return run


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 13, stream_words: int = 10_000) -> DataFrame:
    """docs with n_words, n_removed, spans (begin, end, begin, end ... of the words removed) and kept (the other words, joined by a space)."""
    C.need(docs, doc_id, text)
    C.need_integer(docs, doc_id)
    if width < GRAM:
        raise ValueError(f"windows of at least {GRAM} words")
    C.short_batches(docs.sparkSession)
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("_doc")
    salt = F.xxhash64(F.col(text)).alias("_salt")
    keyed = docs.select(key, salt, F.col(text).alias("_text"))

    anchors = keyed.mapInArrow(_anchor_rows(width), "anchor bigint, doc bigint, salt bigint")
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("final"))
    shared = C.cut(shared.where("first < final").select("anchor", "first"), "anchors")
    held = C.cut(anchors.join(shared, "anchor").groupBy("doc", "salt").agg(F.collect_set(F.struct("anchor", "first")).alias("x")).select("doc", "salt", F.col("x.anchor").alias("anchors"), F.col("x.first").alias("firsts")), "held")

    found = keyed.join(held, (F.col("_doc") == F.col("doc")) & (F.col("_salt") == F.col("salt"))).select("_doc", "_salt", "_text", "anchors", "firsts")
    passages = C.cut(found.mapInArrow(_passages(width), "holder bigint, kind int, doc bigint, salt bigint, start bigint, n bigint, words binary"), "passages")
    C.drop(held, shared)
    own, stream = F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.sum(F.when(F.col("kind") == 1, F.col("n")))
    # a part streams many times the words that its automaton is made of
    parts = F.ceil(stream / F.greatest(F.lit(stream_words), 10 * own)).cast("int")
    hot = C.cut(passages.groupBy("holder").agg(parts.alias("parts")).where("parts > 1"), "hot")
    dealt = passages.join(hot, "holder", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # a shard goes to every part of its stream
    part = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc", "start"), F.col("parts")).cast("int")))
    dealt = dealt.withColumn("part", F.explode(part)).select("holder", "part", "kind", "doc", "salt", "start", "words")
    dealt = dealt.repartition("holder", "part").sortWithinPartitions("holder", "part", "kind")
    spans = C.cut(dealt.mapInArrow(_streamed(width), "doc bigint, salt bigint, start bigint, end bigint, words binary"), "spans")

    C.drop(passages, hot)

    left = spans.where("words is not null")
    firsts = left.groupBy("words").agg(F.min("doc").alias("first"), F.max("doc").alias("final")).where("first < final").select("words", "first")
    late = left.join(C.cut(firsts, "left"), "words").where("doc > first").select("doc", "salt", "start", "end")
    gone = spans.where("words is null").select("doc", "salt", "start", "end").unionByName(late)
    gone = gone.groupBy("doc", "salt").agg(F.flatten(F.collect_set(F.array("start", "end"))).alias("spans"))

    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "spans", "kept")]
    own = {f.name: f"_own{i}" for i, f in enumerate(kept)}  # names that clash with none of ours
    names = list(own.values())
    joined = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), key, salt, F.col(f"`{text}`").alias("_text")).join(gone, (F.col("_doc") == F.col("doc")) & (F.col("_salt") == F.col("salt")), "left")
    fields = [f"{own[f.name]} {f.dataType.simpleString()}" for f in kept]
    done = joined.select(*names, "_text", "spans").mapInArrow(_finish(names), ", ".join([*fields, "n_words bigint, n_removed bigint, spans array<bigint>, kept string"]))
    return done.withColumnsRenamed({n: c for c, n in own.items()})


def drop_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", width: int = 13) -> DataFrame:
    """The documents with the columns of docs; texts that lost words are their other words, joined by a space."""
    clash = {c: f"_own_{c}" for c in docs.columns if c in ("n_words", "n_removed", "spans", "kept")}
    done = dedup_substrings(docs.withColumnsRenamed(clash), doc_id=doc_id, text=text, width=width)
    changed = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text))
    new = {text: changed} | ({n_chars: F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col(n_chars))} if n_chars in docs.columns else {})
    return done.select(*(new.get(c, F.col(f"`{clash.get(c, c)}`")).alias(c) for c in docs.columns))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that an earlier one has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
wins AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS win FROM words, unnest(range(1, len(w) - 11)) AS t(i)),
first AS (SELECT md5(array_to_string(win, ' ')) AS h, min(doc_id) AS lo FROM wins GROUP BY 1),
hit AS (SELECT wins.doc_id, wins.i FROM wins JOIN first ON h = md5(array_to_string(win, ' ')) WHERE lo < wins.doc_id),
gone AS (SELECT DISTINCT doc_id, j FROM hit, unnest(range(i, i + 13)) AS t(j)),
pos AS (SELECT doc_id, j, w[j] AS x FROM words, unnest(range(1, len(w) + 1)) AS t(j)),
kept AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.j) FILTER (g.j IS NULL) AS t, count(g.j) AS n_removed
  FROM pos p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.j = g.j GROUP BY p.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
