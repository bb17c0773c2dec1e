"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding by a UTF-8 state machine.

Encoding.  Ranks fix the merges.  For two tokens a, b the pair is *stable* if merging the bytes of a followed by b leaves
exactly a, b; a token sequence is the BPE of its bytes just when all its neighbours are stable, so every prefix of the bytes
has one last token, the one that is stable after the last token of what is before it.  A state of the transducer is the
token emitted last and the bytes read since.  Reading a byte extends the segmentations of all prefixes of those bytes; those prefixes
are live at which a token could start that reaches beyond what has been read; tokens on which all live segmentations
agree are emitted.  No token is longer than the longest in the vocabulary, which bounds the lookahead.  States and
transitions are made when first taken, until there are `max_states`; where a state lacks a transition then, the live
segmentations are followed without making states.  Each byte is read once; pieces seen before are taken from a bounded table.

Decoding.  Token bytes go through the state machine of UTF-8: it hands out characters as they are complete, keeps an unfinished
one (of 3 bytes at most) for the next call, and replaces what is no UTF-8 by U+FFFD.

Defined cases: a null text is empty (no tokens); texts of any length are encoded whole, piece by piece of the pattern; a
vocabulary entry that its own merges cannot reach is used only where it is a whole piece, as the tiktoken library does; null ids
decode to nothing; ids outside the vocabulary are refused; repeated rows, ties and extra columns make no difference (result columns replace
columns of the same name); an empty table stays empty.

Scale: no shuffle; one Arrow pass.  The vocabulary is read once on the driver and shipped as one broadcast of fixed size.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.llm import common as C


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines "base64-token rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _State:
    """What was emitted last (-1: nothing), the bytes read since, and the live segmentations of their prefixes.

    A live segmentation is (its tokens, the node of the vocabulary's trie that the bytes after it lead to); the longest
    unread part comes first, the segmentation of all bytes, at the root, last.
    """

    __slots__ = ("last", "pending", "live", "next")

    def __init__(self, last: int, pending: bytes, live: list):
        self.last, self.pending, self.live, self.next = last, pending, live, {}


class Transducer:
    """Bytes to token ids, state by state."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 20_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._none = max(ranks.values()) + 1
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError("the vocabulary lacks single bytes")
        self._stable: dict[tuple[int, int], bool] = {}
        self._root: list = [None, {}]  # a node is [token, children by byte]
        for t, i in ranks.items():
            if self.merged(t) == [i]:  # else no merges end in it
                node = self._root
                for byte in t:
                    node = node[1].setdefault(byte, [None, {}])
                node[0] = i
        self._states: dict[tuple[int, bytes], _State] = {}
        self._start = _State(-1, b"", [((), self._root)])

    def merged(self, piece: bytes) -> list[int]:
        """The merges carried out one by one, lowest rank first: what defines the result."""
        rank, none = self.ranks.get, self._none
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) != none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        found = self._stable.get((a, b))
        if found is None:
            if len(self._stable) > 50 * self.max_states:
                self._stable.clear()
            found = self._stable[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        live, whole, last = [], None, state.last
        for path, node in state.live:
            node = node[1].get(byte)
            if node is None:
                continue
            if whole is None and (i := node[0]) is not None:
                before = path[-1] if path else last
                if before < 0 or self.stable(before, i):
                    whole = (*path, i)
            if node[1]:
                live.append((path, node))
        live.append((whole, self._root))
        out: tuple[int, ...] = ()
        first = live[0][0]
        if first:
            n = min(len(p) for p, _ in live)
            while n and any(p[:n] != first[:n] for p, _ in live):
                n -= 1
            if n:
                out, last = first[:n], first[n - 1]
                live = [(p[n:], node) for p, node in live]
        pending = state.pending + bytes((byte,))
        pending = pending[sum(len(self.bytes_of[i]) for i in out) :]
        to = self._states.get((last, pending))
        if to is None:
            to = self._states[last, pending] = _State(last, pending, live)
        found = state.next[byte] = (to, out)
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, out = self._start, []
        for at, byte in enumerate(piece):
            found = state.next.get(byte)
            if found is None:
                if len(self._states) >= self.max_states:
                    return (*out, *self._simulated(state, piece[at:]))
                found = self._step(state, byte)
            state, tokens = found
            if tokens:
                out += tokens
        return (*out, *state.live[-1][0])

    def _simulated(self, state: _State, rest: bytes) -> list[int]:
        """What the states that were not made would emit: the live segmentations followed without making states."""
        live: list = [((path, path[-1] if path else state.last, None), node) for path, node in state.live]
        for byte in rest:
            new, whole = [], None
            for cell, node in live:
                node = node[1].get(byte)
                if node is None:
                    continue
                i = node[0]
                if whole is None and i is not None and (cell[1] < 0 or self.stable(cell[1], i)):
                    whole = (cell, i)
                if node[1]:
                    new.append((cell, node))
            new.append((whole, self._root))
            live = new
        cell, out = live[-1][0], []
        while len(cell) == 2:
            out.append(cell[1])
            cell = cell[0]
        return [*cell[0], *reversed(out)]


class _Pieces(dict):
    """Tokens of pieces seen lately; at `limit` entries it starts anew."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        out = self.encode(piece.encode())
        if len(piece) <= 64:
            self[piece] = out
        return out


def _unfinished(data: bytes) -> int:
    """Where a character begins that may go on after the end; the length, if none does."""
    for k in range(1, min(3, len(data)) + 1):
        b = data[-k]
        if b >= 0xC0:
            return len(data) - k if 2 + (b >= 0xE0) + (b >= 0xF0) > k else len(data)
        if b < 0x80:
            break
    return len(data)


class Utf8Machine:
    """Bytes in, whole characters out; what is unfinished waits in the state."""

    def __init__(self):
        self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        """The characters that are complete now.  Runs of whole characters are taken at once, all else byte by byte."""
        out, at = [], 0
        while self.need and at < len(data):  # what an earlier call left unfinished
            out.append(self._steps(data[at : at + 1]))
            at += 1
        last = max(at, _unfinished(data))
        if at < last:
            try:
                out.append(data[at:last].decode("utf-8"))
            except UnicodeDecodeError:
                out.append(self._steps(data[at:last]))
        out.append(self._steps(data[last:]))
        return "".join(out)

    def _steps(self, data: bytes) -> str:
        out, i, n = [], 0, len(data)
        while i < n:
            b = data[i]
            if self.need:
                if self.low <= b <= self.high:
                    self.held += data[i : i + 1]
                    self.need, self.low, self.high, i = self.need - 1, 0x80, 0xBF, i + 1
                    if not self.need:
                        out.append(self.held.decode("utf-8"))
                        self.held = b""
                else:  # the byte is looked at again as a first one
                    out.append("�")
                    self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF
                continue
            i += 1
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.held = data[i - 1 : i]
                self.need = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.low, self.high = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80), {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        out = "�" if self.need else ""
        self.__init__()
        return out


class Codec:
    """A pattern and a transducer: texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, *, max_pieces: int = 600_000, max_states: int = 20_000):
        import regex

        self.transducer = Transducer(ranks, max_states)
        self.findall = regex.compile(pattern).findall
        self.pieces = _Pieces(self.transducer.encode, max_pieces)
        top = max(ranks.values())
        self.tokens: list = [None] * (top + 1)
        for t, i in ranks.items():
            self.tokens[i] = t

    def encode(self, text: str | None) -> Iterator[int]:
        return chain.from_iterable(map(self.pieces.__getitem__, self.findall(text))) if text else iter(())

    def decode_stream(self, ids: Sequence[int], tokens: int = 4096) -> Iterator[str]:
        """Text as its characters become complete, some tokens at a time."""
        machine, of = Utf8Machine(), self.tokens.__getitem__
        for a in range(0, len(ids), tokens):
            if out := machine.feed(b"".join(map(of, ids[a : a + tokens]))):
                yield out
        if out := machine.close():
            yield out


_CODECS: dict = {}


def _codec(shared) -> Codec:
    """This worker's codec, made from the broadcast ranks when first needed."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        gc.set_threshold(200_000, 50, 50)  # tables of millions of small tuples hold no cycles
        _CODECS[shared.id] = Codec(*shared.value)
    return _CODECS[shared.id]


class _Shared:
    def __init__(self, spark, ranks: dict[bytes, int], pattern: str):
        import uuid

        self.id, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast((ranks, pattern))

    @property
    def value(self):
        return self.broadcast.value


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the token ids of each text, and, where `decoded` names a column, the text that the streaming decoder makes of them."""
    C.need(docs, text)
    C.short_batches(docs.sparkSession)
    shared = _Shared(docs.sparkSession, ranks, pattern)
    kept = [f for f in docs.schema.fields if f.name not in (ids, decoded)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            flat, ends, back = array("i"), [0], []
            for t in C.column(b, text):
                flat.extend(codec.encode(t.as_py()))
                ends.append(len(flat))
            if decoded:
                whole = flat.tolist()
                back = [pa.array(["".join(codec.decode_stream(whole[a:z])) for a, z in zip(ends, ends[1:])], pa.string())]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(C.column(b, n) for n in names), lists, *back], [*names, ids, *([decoded] if decoded else [])])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, ", ".join([*fields, f"`{ids}` array<int>", *([f"`{decoded}` string"] if decoded else [])]))


def decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the text that the ids of each row decode to, by the streaming decoder."""
    C.need(docs, ids)
    C.short_batches(docs.sparkSession)
    shared = _Shared(docs.sparkSession, ranks, pattern)
    kept = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            lists = [x.as_py() or () for x in C.column(b, ids)]
            if any(i is None or not 0 <= i < len(codec.tokens) or codec.tokens[i] is None for x in lists for i in x):
                raise ValueError("an id outside the vocabulary")
            texts = ["".join(codec.decode_stream(x)) for x in lists]
            yield pa.RecordBatch.from_arrays([*(C.column(b, n) for n in names), pa.array(texts, pa.string())], [*names, text])

    return docs.select(*names).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text}` string"]))


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def digests(coded: DataFrame, *, ids: str = "ids", decoded: str = "decoded"):
    """n_tokens, ids_sha256 and decoded_sha256 of encode()'s rows."""
    return {
        "n_tokens": F.size(ids).cast("bigint"),
        "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256),
        "decoded_sha256": F.sha2(F.col(decoded).cast("binary"), 256),
    }


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, *public_vocabulary(), decoded="decoded").select("doc_id", "ids", "decoded")
    return coded.select("doc_id", *(v.alias(k) for k, v in digests(coded).items()))
