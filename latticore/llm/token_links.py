"""Two tokenizations of the same texts, cut into groups at the byte offsets where tokens of both end, and linked.

One Arrow pass tokenizes the texts.  Where no token of either side can reach over a space (checked on the model and the pattern), a text
is cut at its spaces and each kind of chunk is encoded once, while a bounded memo holds it; other tokenizers get texts whole.  The same pass finds
the common ends, of a slice of texts at once in numpy: it gives the bounds of the groups of several tokens, and all groups as text.  The rest is
DataFrame functions: groups of one token a side come in runs, so a run is one slice of each side, and so is a wider group.  The links of a group
are all pairs of its tokens; a pair is one number, a * width + b.

The document count of a pair is one aggregation of each text's distinct pairs.  To bring counts back to the texts, the most
frequent pairs (at most `max_broadcast`, by a threshold on the count) are broadcast; links of rarer pairs are joined by
shuffle.  A pair that is not broadcast has a count under the threshold, so it can't be a hot key.

Defined cases: texts that are null or empty, or of which either tokenizer's bytes differ from a space and the text, have no tokens: counts are 0,
groups and links are empty.  Texts of any length are taken whole.  Repeated rows are documents each: they give a row each
and count each.  Tied counts are all best.  A null doc_id is kept.  Extra columns are ignored; an empty table gives no rows.

Scale: one Arrow pass over the texts, whose links are written to the shared folder; shuffles carry partial counts of pairs
(bounded by the kinds of pairs in a task), links of rare pairs, and a narrow row per document.  Broadcast are the
vocabularies (fixed size), one row for each token of A, and the bounded table of frequent pairs.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticore.llm import common as C

#: The pattern of the rank files.  None of its matches holds a space that follows another character than white space.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A text with a space before it, cut at the spaces that follow another character than white space (but a single space at its end).
_CHUNKS = re.compile(r" \S++(?= .)| .*?\S(?= .)|.+", re.S)
#: Bytes of text that are cut and linked at a time.
_SLICE_BYTES = C.SLICE_BYTES // 2


class ByteRanks:
    """Byte-level BPE given by lines "base64-token rank" and a pattern; texts are read with a space before them.

    `apart`: no token reaches over a cut of _CHUNKS, so chunks have the tokens that they have within the text.
    """

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        own = {base64.b64decode(t): int(i) for t, i in map(bytes.split, ranks.splitlines())}
        self.codec = tiktoken.Encoding("links", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        self.apart = pattern == GPT2_PATTERN
        self.width = max(own.values()) + 1
        self.lengths = np.zeros(self.width, np.int32)
        for t, i in own.items():
            self.lengths[i] = len(t)

    def encode(self, text: str) -> np.ndarray | None:
        """The ids of a space and the text, or None where their bytes differ from it."""
        ids = self.codec.encode_ordinary(" " + text)
        return np.array(ids, np.int32) if self.codec.decode_bytes(ids) == b" " + text.encode() else None


class Pieces:
    """A sentencepiece model, which itself adds the space.  `apart` as in ByteRanks."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.width = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(self.width)]
        self.apart = _plain_bpe(model) and not any("\u2581" in p.lstrip("\u2581") or " " in p for p in pieces)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int32)

    def encode(self, text: str) -> np.ndarray | None:
        """The ids of a text, or None where their bytes differ from a space and the text."""
        ids = self.model.encode(text, num_threads=1)
        return np.array(ids, np.int32) if b"".join(map(self.bytes_of.__getitem__, ids)) == b" " + text.encode() else None


def _plain_bpe(model: bytes) -> bool:
    """Whether a model merges pairs, and reads texts as they are but for a space before them."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # without protobuf the model can't be read, and texts are taken whole
        return False
    m = sentencepiece_model_pb2.ModelProto.FromString(model)
    n = m.normalizer_spec
    reads = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap
    return bool(reads and m.trainer_spec.model_type == m.trainer_spec.BPE and not m.trainer_spec.treat_whitespace_as_suffix and not any(p.type in (p.USER_DEFINED, p.UNUSED) for p in m.pieces))


class _Known(dict):
    """The number of each chunk; those asked for the first time are numbered and noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Memo:
    """The ids that two tokenizers give texts, chunk by chunk; the first `most` kinds of chunks are encoded once.

    New chunks are encoded JOINED at a time: laid end to end they are a text with the same cuts.  Where the chunks remembered have
    more than CHARS times `most` characters (long ones, or whole texts), all are forgotten.
    """

    JOINED = 2000
    CHARS = 16

    def __init__(self, left: ByteRanks, right: Pieces, most: int = 1 << 18):
        self.sides, self.most, self.apart = (left, right), most, left.apart and right.apart
        self.known = _Known()
        self.held = 0
        self.bad = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32) for _ in self.sides]
        self.first = [np.zeros(1, np.int64) for _ in self.sides]  # where the ids of each chunk begin, and the end

    def texts(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts, and where those of each text begin, and the end."""
        cut = _CHUNKS.findall if self.apart else lambda t: [t]
        chunks: list[str] = []
        count = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                more = cut(" " + t)
                chunks += more
                count[i] = len(more)
        code = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        self._learn()
        row = np.repeat(np.arange(len(texts)), count)
        differs = np.bincount(row, self.bad[code], len(texts)) > 0
        code, count = code[~differs[row]], np.where(differs, 0, count)
        begins = _firsts(count)
        out = []
        for ids, first in zip(self.ids, self.first):
            size = np.diff(first)[code]
            at = _firsts(size)
            out.append((ids[_ranges(first[code], size)], at[begins]))
        self._forget()
        return out

    def _learn(self) -> None:
        new, self.known.new = self.known.new, []
        self.held += sum(map(len, new))
        own = np.array([not self.apart or c[-1].isspace() or "\u2581" in c for c in new], bool)  # these are encoded by themselves
        joint = np.flatnonzero(~own)
        groups = [*np.split(joint, range(self.JOINED, len(joint), self.JOINED)), *np.flatnonzero(own)[:, None]]
        found: list = [(np.zeros(0, np.int64),) * 5]  # chunks of a group, ids and their numbers a chunk, on either side
        bad = np.zeros(len(new), bool)
        while groups:
            group = groups.pop()
            chunks = [new[i] for i in group]
            text = "".join(chunks)[1:]
            x = self.sides[0].encode(text)
            y = self.sides[1].encode(text) if x is not None else None
            if y is not None:
                stops = np.cumsum([len(c.encode()) for c in chunks])
                sizes = [np.diff(np.searchsorted(np.cumsum(s.lengths[i]), stops, "right"), prepend=0) for s, i in zip(self.sides, (x, y))]
                found.append((group, x, sizes[0], y, sizes[1]))
            elif len(group) > 1:
                groups += list(group[:, None])
            else:
                bad[group] = True
        self.bad = np.concatenate([self.bad, bad])
        group, *parts = map(np.concatenate, zip(*found))
        for k in (0, 1):
            size = np.zeros(len(new), np.int64)
            size[group] = parts[2 * k + 1]
            at = _firsts(parts[2 * k + 1])[:-1]
            begin = np.zeros(len(new), np.int64)
            begin[group] = at
            ids = parts[2 * k][_ranges(begin, size)]
            self.ids[k] = np.concatenate([self.ids[k], ids.astype(np.int32)])
            self.first[k] = np.concatenate([self.first[k], self.first[k][-1] + np.cumsum(size)])

    def _forget(self) -> None:
        while len(self.known) > self.most:
            self.held -= len(self.known.popitem()[0])  # the last that came
        if self.held > self.CHARS * self.most:
            self.known, self.held = _Known(), 0
        n = len(self.known)
        self.bad, self.first = self.bad[:n], [f[: n + 1] for f in self.first]
        self.ids = [x[: f[-1]] for x, f in zip(self.ids, self.first)]


def _firsts(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes from each begin on, as many as its size, one range after another."""
    at = _firsts(size)
    return np.repeat(begin - at[:-1], size) + np.arange(at[-1])


@lru_cache(maxsize=1)
def _memo(a: tuple, b: tuple) -> Memo:
    return Memo(ByteRanks(*a), Pieces(*b))


def public_tokenizers(a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model") -> tuple[tuple, tuple]:
    """The arguments of ByteRanks and Pieces for two files of the public tokenizers (the rank file is the vocabulary of byte_bpe_50k.json)."""
    import public_tokenizers as P

    with open(P.path(a), "rb") as f, open(P.path(b), "rb") as g:
        return (f.read(), P.PATTERN), (g.read(),)


def tokenized(docs: DataFrame, a: tuple, b: tuple, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, n_groups, wide (the groups of several tokens on a side: where their tokens begin and end) and text (all groups, as `written`)."""
    C.need(docs, doc_id, text)
    spark = docs.sparkSession
    C.short_batches(spark)
    shared = spark.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(*shared.value)
        names = _suffixed(max(s.width for s in memo.sides))
        for batch in batches:
            of = C.column(batch, text)
            stops = np.cumsum(pc.fill_null(pc.binary_length(of), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // _SLICE_BYTES
            for at in np.split(np.arange(len(of)), np.flatnonzero(np.diff(stops)) + 1):
                at = pa.array(at)
                sides = memo.texts(of.take(at).to_pylist())
                ids = [pa.ListArray.from_arrays(first.astype(np.int32), i) for i, first in sides]
                begin, last = _borders([np.cumsum(s.lengths[i], dtype=np.int64) for (i, _), s in zip(sides, memo.sides)])
                n_groups = np.diff(np.searchsorted(last[0], sides[0][1]))
                columns = [C.column(batch, doc_id).take(at), *ids, pa.array(n_groups), _wide(sides, begin, last), _text(sides, begin, last, names)]
                yield pa.RecordBatch.from_arrays(columns, [doc_id, "a_ids", "b_ids", "n_groups", "wide", "text"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, a_ids array<int>, b_ids array<int>, n_groups bigint, wide array<struct<a0: int, a1: int, b0: int, b1: int>>, text string")


def _borders(ends: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each side the first and the last token of every group, of texts laid end to end: both sides end where a text does."""
    last = []
    for mine, other in (ends, ends[::-1]):
        common = np.zeros(int(mine[-1]) + 1 if len(mine) else 1, bool)
        common[other] = True
        last.append(np.flatnonzero(common[mine]))
    return [np.concatenate([[0], x + 1])[:-1] for x in last], last


def _wide(sides: list[tuple[np.ndarray, np.ndarray]], begin: list[np.ndarray], last: list[np.ndarray]) -> pa.ListArray:
    wide = np.flatnonzero((last[0] > begin[0]) | (last[1] > begin[1]))
    first_a, first_b = (f for _, f in sides)
    row = np.searchsorted(first_a, begin[0][wide], "right") - 1
    fields = {"a0": begin[0][wide] - first_a[row], "a1": last[0][wide] + 1 - first_a[row], "b0": begin[1][wide] - first_b[row], "b1": last[1][wide] + 1 - first_b[row]}
    offsets = np.searchsorted(row, np.arange(len(first_a))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([x.astype(np.int32) for x in fields.values()], list(fields)))


@lru_cache(maxsize=1)
def _suffixed(width: int) -> pa.StringArray:
    """Each id four times: followed by a comma, by a bar, by a semicolon, by nothing."""
    return pa.array([f"{i}{mark}" for i in range(width) for mark in (",", "|", ";", "")])


def _text(sides: list[tuple[np.ndarray, np.ndarray]], begin: list[np.ndarray], last: list[np.ndarray], names: pa.StringArray) -> pa.StringArray:
    """Groups written as `a1,a2|b1;a3|b2,b3`: the tokens of both sides in order, each with the mark after it, laid end to end."""
    (a, first_a), (b, first_b) = sides
    n_a, n_b = (y + 1 - x for x, y in zip(begin, last))
    name = np.empty(len(a) + len(b), np.int64)
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[last[0]], mark_b[last[1]] = 1, 2
    mark_b[first_b[1:][np.diff(first_b) > 0] - 1] = 3
    name[np.arange(len(a)) + np.repeat(begin[1], n_a)] = 4 * a.astype(np.int64) + mark_a
    name[np.arange(len(b)) + np.repeat(last[0] + 1, n_b)] = 4 * b.astype(np.int64) + mark_b
    parts = names.take(pa.array(name))
    ends = np.frombuffer(parts.buffers()[1], np.int32)[: len(parts) + 1]
    return pa.StringArray.from_buffers(len(first_a) - 1, pa.py_buffer(ends[first_a + first_b].copy()), parts.buffers()[2])


# ---------------------------------------------------------------- native from here on


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def layout() -> Column:
    """A row's groups: a struct of text (the groups written) and parts, an array of structs (a, b, x, y) that alternate between runs and wide groups.

    a and b are the tokens of a run of groups of one token a side; x and y those of the wider group that follows it (empty after the
    last run).
    """
    a, b, wide = F.col("a_ids"), F.col("b_ids"), F.col("wide")
    end = F.struct(F.size(a).alias("a0"), F.size(a).alias("a1"), F.size(b).alias("b0"), F.size(b).alias("b1"))
    start = F.struct(*(F.lit(0).alias(n) for n in ("a0", "a1", "b0", "b1")))
    part = lambda ids, i, j: F.slice(ids, i + 1, j - i)
    parts = lambda w, v: F.struct(part(a, w["a1"], v["a0"]).alias("a"), part(b, w["b1"], v["b0"]).alias("b"), part(a, v["a0"], v["a1"]).alias("x"), part(b, v["b0"], v["b1"]).alias("y"))
    return F.struct(F.col("text").alias("text"), F.zip_with(F.concat(F.array(start), wide), F.concat(wide, F.array(end)), parts).alias("parts"))


def groups(of: Column) -> Column:
    """The groups of a layout in order: an array of structs (a, b) of the ids of each side."""
    single = lambda r: F.zip_with(r["a"], r["b"], lambda x, y: F.struct(F.array(x).alias("a"), F.array(y).alias("b")))
    wide = lambda r: F.filter(F.array(F.struct(r["x"].alias("a"), r["y"].alias("b"))), lambda g: F.size(g["a"]) > 0)
    return F.flatten(F.transform(of["parts"], lambda r: F.concat(single(r), wide(r))))


def links(of: Column, width: int) -> Column:
    """All pairs of the groups' tokens, as a * width + b."""
    pair = lambda i, j: i.cast("bigint") * width + j
    wide = F.flatten(F.transform(of["parts"], lambda r: F.flatten(F.transform(r["x"], lambda i: F.transform(r["y"], lambda j: pair(i, j))))))
    return F.concat(F.zip_with(F.flatten(of["parts"]["a"]), F.flatten(of["parts"]["b"]), pair), wide)


def written(of: Column) -> Column:
    """A layout as text: `a1,a2|b1;a3|b2,b3`."""
    return of["text"]


def linked(tokens: DataFrame, width: int, *, doc_id: str = "doc_id", more: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, links, and columns of `more`, functions of the layout."""
    made = {"links": lambda g: links(g, width), **(more or {})}
    row = let(layout(), lambda g: F.struct(*(f(g).alias(k) for k, f in made.items())))
    counts = {"n_a": F.size("a_ids"), "n_b": F.size("b_ids"), "n_groups": F.col("n_groups")}
    wide = tokens.select(doc_id, *(v.cast("bigint").alias(k) for k, v in counts.items()), F.explode(F.array(row)).alias("_g"))
    return wide.select(doc_id, *counts, F.size("_g.links").cast("bigint").alias("n_links"), *(F.col(f"_g.{k}") for k in made))


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """For each pair of ids linked anywhere: pair, n (documents that hold it), best (1 where n is the highest of its A id)."""
    counts = C.cut(rows.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    left = F.floor(F.col("pair") / width).cast("int").alias("_a")
    top = counts.groupBy(left).agg(F.max("n").alias("_top"))  # a row for each token of A: bounded by its vocabulary
    joined = counts.select("pair", "n", left).join(F.broadcast(top), "_a")
    out = C.cut(joined.select("pair", "n", (F.col("n") == F.col("_top")).cast("int").alias("best")), "pairs")
    C.drop(counts)
    return out


def frequent(counts: DataFrame, most: int) -> int:
    """The lowest count of which at most `most` pairs reach or exceed it, on a grid of powers of 2 ** (1/8)."""
    grid = [int(2 ** (k / 8)) + (k > 0) for k in range(8 * 63)]
    step = F.floor(F.log2("n") * 8 - 1e-9)
    found = dict(counts.groupBy(F.greatest(step, F.lit(-1)).alias("step")).count().collect())
    total, least = 0, max(found, default=0) + 2
    for s in sorted(found, reverse=True):
        total += found[s]
        if total > most:
            break
        least = s
    return 1 if least <= 0 else grid[least]


def scored(rows: DataFrame, counts: DataFrame, *, max_broadcast: int = 500_000) -> DataFrame:
    """rows, which need a `_row` of their own, with n_best and count_sum instead of links."""
    least = frequent(counts, max_broadcast)
    often, rare = counts.where(F.col("n") >= least), counts.where(F.col("n") < least)
    each = rows.select("_row", F.explode("links").alias("pair"))
    sums = [F.sum("best").alias("n_best"), F.sum("n").alias("count_sum")]
    found = each.join(F.broadcast(often), "pair").groupBy("_row").agg(*sums)
    if least > 1:  # the others meet their counts by shuffle; none of these keys has `least` documents
        left = each.join(F.broadcast(often.select("pair")), "pair", "left_anti").groupBy("_row", "pair").agg(F.count(F.lit(1)).alias("_times"))
        joined = left.join(rare, "pair").groupBy("_row").agg(F.sum(F.col("best") * F.col("_times")).alias("n_best"), F.sum(F.col("n") * F.col("_times")).alias("count_sum"))
        found = found.unionByName(joined).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    names = [c for c in rows.columns if c not in ("_row", "links")]
    zero = F.lit(0).cast("bigint")
    return rows.select("_row", *names).join(found, "_row", "left").select(*names, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def align(docs: DataFrame, a: tuple, b: tuple, *, doc_id: str = "doc_id", text: str = "text", more: dict[str, Callable[[Column], Column]] | None = None, max_broadcast: int = 500_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, the columns of `more`, n_best and count_sum of every row.

    `more` maps names to functions of the layout: {"groups": groups} keeps the groups themselves.
    """
    width = Pieces(*b).width
    rows = linked(tokenized(docs, a, b, doc_id=doc_id, text=text), width, doc_id=doc_id, more=more)
    rows = C.cut(rows.withColumn("_row", F.monotonically_increasing_id()), "links", "zstd")
    counts = pair_counts(rows, width)
    return scored(rows, counts, max_broadcast=max_broadcast)


def op11_token_links(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens of two vocabularies, aligned and linked, with a digest of its groups."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = {"groups_sha256": lambda g: let(written(g), lambda t: F.when(t != "", F.sha2(t.cast("binary"), 256)).otherwise(""))}
    return align(docs, *public_tokenizers(), more=digest).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
