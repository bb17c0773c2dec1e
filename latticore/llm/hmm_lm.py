"""A hidden Markov language model of a corpus: trained by Baum-Welch over all training documents, scoring by scaled forward recursion.

Tokens are words (runs of bytes other than space and 0x09-0x0D, with A-Z lowered), then one end token.  The latent states emit word classes: each
token that stands `min_count` times in the training tokens is a class, however many there are; all others share the class *rare*, in which a token that
the training tokens have c times weighs c + 1, and one that they lack weighs 1.  So a text's probability is that of its classes
under the chain, times those of its rare tokens within their class, and sums to one over texts.

1. Texts become blocks of about `block_tokens` tokens, written once: a block has its own vocabulary, and its texts are places in it, packed by
about `group_tokens` tokens.  2. The vocabularies' counts are summed by token.  3. A mixture over a bounded sample of training documents
gives starting values only.  4. In each round of Baum-Welch the emissions, a table with a row for each class, are joined to the
blocks' vocabularies, and a task takes a block with just the emissions that its words need; it runs forward and backward over every training document, whole,
and the expected counts, summed by token, make the next table.  5. The forward recursion, scaled at each step, gives each text's exact likelihood.

Base score: every token on its own, log10((c + 1) / (N + V + 1)), N training tokens of V kinds.

Defined cases: a null text is empty, and consists of the end token; a null id counts as the empty string for the split; without
training documents nothing is known (N = V = 0, base score 0) and the model knows one class; repeated rows are scored alike; an empty
table stays empty; tokens are told apart by 64-bit hashes; the starting sample is drawn by hashes of id and text, so it does not depend on
partitions; extra columns are ignored.

Scale: nothing that grows with the vocabulary is broadcast or sent to the driver, which holds the moves between states, their starts and
the class of rare tokens.  A block's vocabulary and texts are the unit of work; a token stands once in a block, so the commonest token has as
many rows in a join as there are blocks.  A task works through `group_tokens` tokens at a time, texts of like lengths side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.llm import common as C

U = np.uint64
END = np.int64(-0x61C8864680B583EB)  # the end token's hash
HELD_OUT = (7, 2)


def _tokens(w: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of consecutive texts, each with its end token, and where each text's begin."""
    first = w.first + np.arange(w.n + 1)
    out = np.full(first[-1] + 0, END)
    at = np.ones(len(out), bool)
    at[first[1:] - 1] = False
    out[at] = w.hashes().astype(np.int64)
    return out, first


def packed(places: np.ndarray, lengths: np.ndarray) -> bytes:
    """Texts as places one after the other, and their lengths: byte by byte, the first bytes of all numbers first, compressed."""
    numbers = np.concatenate([lengths, places]).astype("<i4")
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, texts: int, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """What packed() was given."""
    planes = pa.decompress(data, decompressed_size=4 * (texts + tokens), codec="zstd", asbytes=True)
    numbers = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()
    return numbers[texts:], numbers[:texts].astype(np.int64)


def _blocks(most: int, group: int):
    """Texts in blocks of about `most` tokens: rows of about `group` tokens each, packed as places in the block's vocabulary, and a row
    with that vocabulary, the commonest token first, and how often the block's training texts have each token."""
    names = ["block", "top", "held_out", "ids", "m", "n", "packed", "tokens", "seen"]

    def block(number: int, parts: list) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([p[0] for p in parts])
        held = np.concatenate([p[1] for p in parts])
        lengths = np.concatenate([p[3] for p in parts])
        tokens, places, often = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        places = rank[places]
        first = np.concatenate([[0], np.cumsum(lengths)])
        seen = np.bincount(places[np.repeat(~held, lengths)], minlength=len(tokens))
        for side in (False, True):
            rows = np.flatnonzero(held == side)
            rows = rows[np.argsort(-lengths[rows], kind="stable")]  # texts of like lengths side by side
            ends = np.cumsum(lengths[rows])
            a = 0
            while a < len(rows):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + group, "right")))
                own, size = rows[a:b], lengths[rows[a:b]]
                at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                row = [[number], [len(tokens) - 1], [side], None, [len(own)], [len(at)], [packed(places[at], size)]]
                lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids.take(pa.array(own)))
                yield pa.RecordBatch.from_arrays([lists if x is None else pa.array(x) for x in row] + [pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))], names)
                a = b
        nothing = [pa.nulls(1, t) for t in (pa.bool_(), pa.list_(ids.type), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(tokens) - 1]), *nothing, pa.array([tokens[order]], pa.list_(pa.int64())), pa.array([seen], pa.list_(pa.int64()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, total = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            at = 0
            for _, z, w in C.slices(C.column(b, "_text"), lower=True):
                t, first = _tokens(w)
                parts.append((C.column(b, "doc_id").slice(at, z - at), C.column(b, "held_out").slice(at, z - at).to_numpy(zero_copy_only=False), t, np.diff(first)))
                at, total = z, total + len(t)
                if total >= most:
                    yield from block(number, parts)
                    number, parts, total = number + 1, [], 0
        if parts:
            yield from block(number, parts)

    return run


class Model:
    """Starting, moving and emitting probabilities of the states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # K, K x K, classes x K


class Group:
    """Sequences side by side, step by step: the longest first, those at each step a prefix of those at the one before."""

    def __init__(self, classes: np.ndarray, first: np.ndarray):
        lengths = np.diff(first)
        self.first = first
        self.order = np.argsort(-lengths, kind="stable")
        size = lengths[self.order]
        steps = int(size[0]) if len(size) else 0
        self.n = np.searchsorted(-size, -np.arange(steps), "left")  # sequences longer than t
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        rank = np.empty(len(size), np.int64)
        rank[self.order] = np.arange(len(size))
        t = np.arange(len(classes)) - np.repeat(first[:-1], lengths)
        self.classes = np.empty(len(classes), np.int32)
        self.classes[self.at[t] + np.repeat(rank, lengths)] = classes

    def forward(self, m: Model, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities and scales of every token."""
        alpha = m.emit.astype(kind)[self.classes]
        scale = np.empty(len(alpha), kind)
        move, at, n = m.move.astype(kind), self.at.tolist(), self.n.tolist()
        for t in range(len(n)):
            a = alpha[at[t] : at[t + 1]]
            a *= m.start.astype(kind) if not t else alpha[at[t - 1] : at[t - 1] + n[t]] @ move
            s = a.sum(axis=1)
            a /= s[:, None]
            scale[at[t] : at[t + 1]] = s
        return alpha, scale

    def log10(self, m: Model) -> np.ndarray:
        """log10 of each sequence's probability, in the order given."""
        _, scale = self.forward(m)
        rank = np.arange(len(scale)) - np.repeat(self.at[:-1], self.n)
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(rank, weights=np.log10(scale), minlength=len(self.order))
        return out

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions (classes x K)."""
        kind = np.float32
        gamma, scale = self.forward(m, kind)
        emit, move, at, n = m.emit.astype(kind), m.move.astype(kind), self.at.tolist(), self.n.tolist()
        moves, back = np.zeros(move.shape), np.ascontiguousarray(move.T)
        beta = np.ones((n[-1] if n else 0, len(m.start)), kind)
        for t in range(len(n) - 1, -1, -1):
            a, b = at[t], at[t + 1]
            if t:
                ahead = emit[self.classes[a:b]] * beta / scale[a:b, None]
                before = gamma[at[t - 1] : at[t - 1] + n[t]]
                moves += before.T @ ahead
            gamma[a:b] *= beta
            if t:
                beta = np.ones((n[t - 1], len(m.start)), kind)
                beta[: n[t]] = ahead @ back
        k = len(m.start)
        emits = np.stack([np.bincount(self.classes, weights=gamma[:, j], minlength=len(m.emit)) for j in range(k)], axis=1)
        return gamma[: self.n[0]].sum(axis=0, dtype=np.float64) if n else np.zeros(k), moves * m.move, emits


def _groups(texts: pa.Table, classes: np.ndarray) -> Iterator[tuple[np.ndarray, Group]]:
    """(places, sequences of classes) of each packed row; classes are those of the block's places."""
    for m, n, data in zip(texts["m"], texts["n"], texts["packed"]):
        places, lengths = unpacked(data.as_py(), m.as_py(), n.as_py())
        yield places, Group(classes[places], np.concatenate([[0], np.cumsum(lengths)]))


def _floats(column: pa.ChunkedArray, k: int, kind: str = "<f4") -> np.ndarray:
    """A column of k numbers each, as bytes, as an array (rows x k)."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(-1, k) if data else np.zeros((0, k))


def _bytes(rows: np.ndarray, kind: str = "<f4") -> pa.Array:
    """Rows of numbers as bytes."""
    data = np.ascontiguousarray(rows.astype(kind))
    width = data.shape[1] * data.itemsize
    offsets = (np.arange(len(data) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _block_model(start: np.ndarray, move: np.ndarray, rare: np.ndarray, words: pa.Table, size: int) -> tuple[Model, np.ndarray]:
    """The model with the emissions of a block's words, the class of rare tokens last, and the classes of the block's places."""
    emit = _floats(words["e"], len(start)).astype(np.float64)
    classes = np.full(size, len(emit), np.int32)
    classes[words["place"].to_numpy()] = np.arange(len(emit), dtype=np.int32)
    return Model(start, move, np.vstack([emit, rare])), classes


WORD, RARE, MOVES, TOTALS = 0, 1, 2, -1


def _expectation(start: np.ndarray, move: np.ndarray, rare: np.ndarray):
    """Expected counts of a block: a row per class it holds (WORD, RARE), moves out of state j (MOVES + j), starts (MOVES + K)."""
    k = len(start)

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        if not texts.num_rows:  # a block of texts held out only
            return pa.table({"id": pa.array([], pa.int32()), "token": pa.array([], pa.int64()), "e": pa.array([], pa.binary())})
        m, classes = _block_model(start, move, rare, words, 1 + int(texts["top"][0].as_py()))
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape)
        for _, g in _groups(texts, classes):
            for total, part in zip((starts, moves, emits), g.expected(m)):
                total += part
        n = words.num_rows
        ids = np.concatenate([np.full(n, WORD), [RARE], MOVES + np.arange(k + 1)]).astype(np.int32)
        tokens = np.concatenate([words["token"].to_numpy(), np.zeros(k + 2, np.int64)])
        return pa.table([pa.array(ids), pa.array(tokens), _bytes(np.concatenate([emits, moves, starts[None, :]]))], ["id", "token", "e"])

    return run


def _summed(k: int):
    """Sums of rows that come sorted by (id, token), and the totals of all emissions (id TOTALS, as doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals = None, np.zeros(k)

        def rows(ids, tokens, sums) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(tokens, pa.int64()), _bytes(sums)], ["id", "token", "e"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, tokens, e = C.column(b, "id").to_numpy(), C.column(b, "token").to_numpy(), _floats(C.column(b, "e"), k).astype(np.float64)
            totals += e[ids <= RARE].sum(axis=0)
            if held is not None:
                ids, tokens, e = np.append(held[0], ids), np.append(held[1], tokens), np.vstack([held[2][None, :], e])
            at = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tokens[1:] != tokens[:-1])]))
            sums = np.add.reduceat(e, at, axis=0)
            held = (ids[-1], tokens[-1], sums[-1])
            yield rows(ids[at[:-1]], tokens[at[:-1]], sums[:-1])
        if held is not None:
            yield rows([held[0]], [held[1]], held[2][None, :])
            yield pa.RecordBatch.from_arrays([pa.array([TOTALS], pa.int32()), pa.array([0], pa.int64()), _bytes(totals[None, :], "<f8")], ["id", "token", "e"])

    return run


def _updated(total: np.ndarray, weight: float, weights: float):
    """Emissions (token, c, e) from summed counts and c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share = (C.column(b, "c").to_numpy() + 1.0) / weights
            e = (_floats(C.column(b, "e"), len(total)).astype(np.float64) + weight * share[:, None]) / (total + weight)
            yield pa.RecordBatch.from_arrays([C.column(b, "token"), C.column(b, "c"), _bytes(e)], ["token", "c", "e"])

    return run


def _joined(names: list[str]):
    """The columns `names` as one column of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = np.stack([C.column(b, n).to_numpy() for n in names], axis=1)
            yield pa.RecordBatch.from_arrays([C.column(b, "token"), C.column(b, "c"), _bytes(e)], ["token", "c", "e"])

    return run


EMISSIONS = "token bigint, c bigint, e binary"


def _scored(start: np.ndarray, move: np.ndarray, rare: np.ndarray, rare_weight: float):
    """Rows with n_tokens, n_known, the sum of log10(c + 1) of their tokens, and the log10 of their probability."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        size = 1 + int(texts["top"][0].as_py())
        c = np.zeros(size)
        c[words["place"].to_numpy()] = words["c"].to_numpy()
        m, classes = _block_model(start, move, rare, words.filter(pc.is_valid(words["e"])), size)
        logs = np.log10(c + 1)
        within = np.where(classes == len(m.emit) - 1, logs - np.log10(rare_weight), 0.0)
        ids, held, out = [], [], [[], [], [], []]
        for own, side, (places, g) in zip(texts["ids"], texts["held_out"], _groups(texts, classes)):
            first = g.first[:-1]
            ids.append(own.values)
            held.append(np.full(len(first), side.as_py()))
            out[0].append(np.diff(g.first))
            out[1].append(np.add.reduceat((c[places] > 0).astype(np.int64), first))
            out[2].append(np.add.reduceat(logs[places], first))
            out[3].append(g.log10(m) + np.add.reduceat(within[places], first))
        return pa.table([pa.concat_arrays(ids), *(pa.array(np.concatenate(x)) for x in (held, *out))], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    return run


def starting_model(classes: np.ndarray, first: np.ndarray, share: np.ndarray, states: int, rounds: int = 12, seed: int = 7) -> Model:
    """A mixture of class distributions over sampled documents, with states that mostly stay."""
    rng = np.random.default_rng(seed)
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    emit = np.repeat(share[:, None], states, axis=1)
    if n:
        pair, back = np.unique(doc * np.int64(len(share)) + classes, return_inverse=True)
        often = np.bincount(back).astype(float)
        doc, word = pair // len(share), pair % len(share)
        # far-apart documents start the components
        logs = np.log(share)
        resp = rng.dirichlet(np.full(states, 0.3), n)
        for _ in range(rounds):
            sums = np.stack([np.bincount(word, weights=often * resp[doc, j], minlength=len(share)) for j in range(states)], axis=1)
            emit = (sums + 200.0 * share[:, None]) / (sums.sum(axis=0) + 200.0)
            prior = np.log(resp.mean(axis=0) + 1e-9)
            gain = (np.log(emit) - logs[:, None])[word] * often[:, None]
            score = prior + np.stack([np.bincount(doc, weights=gain[:, j], minlength=n) for j in range(states)], axis=1)
            score = np.exp(np.clip(score - score.max(axis=1, keepdims=True), -700, 0))
            resp = score / score.sum(axis=1, keepdims=True)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1.0 / states), move, emit)


def _start(rows: DataFrame, counts: DataFrame, weights: float, rare_share: float, *, min_count: int, states: int, sample_docs: int) -> tuple[DataFrame, Model, bool]:
    """Starting emissions (token, c, e) of every class, the model of the sample (rare tokens last), and whether any training document was sampled."""
    spark = rows.sparkSession
    share_of = lambda c: (c + 1.0) / weights
    training = rows.where(~F.col("held_out"))
    # a draw of a few times the sample, so that few rows meet in the sort
    lot = F.xxhash64("doc_id", "_text")
    draw = F.pmod(lot, F.lit(1 << 40)) < int((1 << 40) * min(1.0, (3 * sample_docs + 100) / max(1, training.count())))
    sample = training.where(draw).select("_text", lot.alias("lot")).orderBy("lot").limit(sample_docs).toArrow()
    parts = [_tokens(w) for _, _, w in C.slices(sample["_text"], lower=True)]
    tokens = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in parts)])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(f) for _, f in parts)]))])
    classes = counts.where(F.col("c") >= min_count)
    kinds = spark.createDataFrame(pa.table({"token": np.unique(tokens)}))
    known = classes.join(F.broadcast(kinds), "token").toArrow().sort_by("token")
    top, often = known["token"].to_numpy(), known["c"].to_numpy()
    share = np.append(share_of(often), rare_share)
    at = np.minimum(np.searchsorted(top, tokens), max(len(top) - 1, 0))
    local = np.where(top[at] == tokens, at, len(top)) if len(top) else np.zeros(len(tokens), np.int64)
    model = starting_model(local, first, share, states)
    names = [f"s{j}" for j in range(states)]
    # what the sampled classes leave to the others, in proportion to their shares
    rest = (1 - model.emit.sum(axis=0)) / (1 - share.sum()) if 1 - share.sum() > 1e-9 else np.ones(states)
    own = spark.createDataFrame(pa.table([pa.array(top), *(pa.array(model.emit[:-1, j]) for j in range(states))], ["token", *names]))
    emissions = classes.join(own, "token", "left").select("token", "c", *(F.coalesce(n, share_of(F.col("c")) * float(r)).alias(n) for n, r in zip(names, rest)))
    return C.cut(emissions.mapInArrow(_joined(names), EMISSIONS), "emissions"), model, len(first) > 1


def _expected(texts: DataFrame, words: DataFrame, emissions: DataFrame, model: Model) -> DataFrame:
    """The expected counts of all blocks, summed; their shuffles are free to go on return."""
    side = words.join(emissions.select("token", "e"), "token").select("at", "place", "token", "e")
    run = _expectation(model.start, model.move, model.emit[-1])
    rows = texts.groupBy("block").cogroup(side.groupBy("at")).applyInArrow(run, "id int, token bigint, e binary")
    rows = rows.repartition("id", "token").sortWithinPartitions("id", "token")
    return C.cut(rows.mapInArrow(_summed(len(model.start)), "id int, token bigint, e binary"), "expected")


def train(texts: DataFrame, words: DataFrame, emissions: DataFrame, model: Model, weights: float, rare_share: float, *, rounds: int) -> tuple[DataFrame, Model]:
    """Baum-Welch over all training texts: the emissions, and the model with that of rare tokens only."""
    states = len(model.start)
    for _ in range(rounds):
        sums = _expected(texts, words, emissions, model)
        few = sums.where(F.col("id") != WORD).orderBy("id").toArrow()  # a row per task, and states + 2
        ids = few["id"].to_numpy()
        total = _floats(few["e"].filter(pa.array(ids == TOTALS)), states, "<f8").sum(axis=0)
        few = _floats(few["e"].filter(pa.array(ids != TOTALS)), states).astype(np.float64)
        weight = 50.0  # of the corpus' own distribution in each state's
        move, start = few[1 : 1 + states] + 0.5, few[1 + states] + 0.5
        rare = (few[:1] + weight * rare_share) / (total + weight)
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), rare)
        old = emissions
        emissions = sums.where(F.col("id") == WORD).select("token", "e").join(old.select("token", "c"), "token")
        emissions = C.cut(emissions.mapInArrow(_updated(total, weight, weights), EMISSIONS), "emissions")
        C.drop(sums, old)
    return emissions, model


def score_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", states: int = 8, rounds: int = 2, min_count: int = 8, sample_docs: int = 1500, group_tokens: int = 1_000_000, block_tokens: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    C.need(docs, doc_id, text)
    C.short_batches(docs.sparkSession)
    modulus, held = HELD_OUT
    outside = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == held
    rows = docs.select(F.col(doc_id).alias("doc_id"), outside.alias("held_out"), F.col(text).alias("_text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    coded = rows.mapInArrow(_blocks(block_tokens, group_tokens), f"block bigint, top bigint, held_out boolean, ids array<{kind}>, m bigint, n bigint, packed binary, tokens array<bigint>, seen array<bigint>")
    coded = C.cut(coded, "blocks")
    vocabularies = coded.where("tokens IS NOT NULL")
    counts = vocabularies.select(F.explode(F.arrays_zip("tokens", "seen")).alias("x")).select(F.col("x.tokens").alias("token"), F.col("x.seen").alias("c"))
    counts = C.cut(counts.where("c > 0").groupBy("token").agg(F.sum("c").alias("c")), "counts")
    is_class = F.col("c") >= min_count
    total, kinds, often, n_classes = counts.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("c"), F.count(F.lit(1)), F.sum(F.when(is_class, F.col("c"))), F.count(F.when(is_class, 1))))).first()
    weights = float(total + kinds + 1)
    rare_weight = float(total - often + kinds - n_classes + 1)

    words = vocabularies.select(F.col("block").alias("at"), F.posexplode("tokens").alias("place", "token"))
    texts = coded.where("packed IS NOT NULL").select("block", "top", "held_out", "ids", "m", "n", "packed")
    emissions, model, any_row = _start(rows, counts, weights, rare_weight / weights, min_count=min_count, states=states, sample_docs=sample_docs)
    if any_row:
        training = texts.where(~F.col("held_out")).select("block", "top", "m", "n", "packed")
        emissions, model = train(training, words, emissions, model, weights, rare_weight / weights, rounds=rounds)
    known = counts.join(emissions.select("token", "e"), "token", "left")
    side = words.join(known, "token").select("at", "place", "c", "e")
    run = _scored(model.start, model.move, model.emit[-1], rare_weight)
    fields = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double"
    scored = texts.groupBy("block").cogroup(side.groupBy("at")).applyInArrow(run, fields)
    return scored.select(
        F.col("doc_id").alias(doc_id),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * float(np.log10(weights))).alias("base_score"),
        "score",
    )


def op2_hmm_scores(spark, sf_dir: str) -> DataFrame:
    """Every document's base score and score under the hidden Markov model."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
