"""Cross-tokenizer links, the filter audit and language identification against brute force and held-out labels."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from latticore.llm import filter_audit, language_id, parity_join, substring_dedup, token_links
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


# ---------------------------------------------------------------- cross-tokenizer links


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéñßx") for _ in range(rng.randint(1, 9)))
    out = ["", None, "a", " ", "  two  spaces ", "\n\t x", "▁under▁", "<s> <|endoftext|> </s>", "日本語 テキスト 🙂", "\x00nul", "it's I'll\r\n", "Identical words here", "Identical words here"]
    out += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(30)]
    return out + [" ".join(word() for _ in range(8000))]


@pytest.fixture(scope="module")
def linked(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts())] + [(None, "a null id", None, None, 0), (2, "a", None, None, 0)]
    docs = frame(spark, rows).withColumns({"n_best": F.lit("clash"), "links": F.lit(1), "_row": F.lit(2)})
    digest = {"text": token_links.written, "groups": token_links.groups}
    return rows, token_links.align(docs, *token_links.public_tokenizers(), more=digest).collect(), docs


def brute(rows):
    """(id, n_a, n_b, groups) of each row by the libraries that the vocabularies were made for, one offset after another."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    for key, text, *_ in rows:
        if not text:
            yield key, 0, 0, []
            continue
        x = a.encode(" " + text, add_special_tokens=False)
        y = b.encode(text)
        sides = [
            [(i, bytes(byte_of[c] for c in t)) for i, t in zip(x.ids, x.tokens)],
            [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in y)],
        ]
        if any(b"".join(t for _, t in s) != (" " + text).encode() for s in sides):
            yield key, 0, 0, []
            continue
        ends = [list(itertools.accumulate(len(t) for _, t in s)) for s in sides]
        both, groups, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        for e in both:
            group = []
            for k in (0, 1):
                n = ends[k].index(e) + 1
                group.append([i for i, _ in sides[k][at[k] : n]])
                at[k] = n
            groups.append(tuple(group))
        yield key, len(sides[0]), len(sides[1]), groups


def test_links_against_brute_force(linked):
    rows, got, _ = linked
    want = list(brute(rows))
    count = collections.Counter(p for *_, groups in want for p in {(i, j) for x, y in groups for i in x for j in y})
    top = collections.Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    expected = []
    for key, n_a, n_b, groups in want:
        pairs = [(i, j) for x, y in groups for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        expected.append((key is None, key, n_a, n_b, len(groups), len(pairs), sum(count[p] == top[p[0]] for p in pairs), sum(count[p] for p in pairs), text, groups))
    found = [(r.doc_id is None, r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.text, [(g.a, g.b) for g in r.groups]) for r in got]
    order = lambda r: (r[0], r[1] or 0, r[8])
    assert sorted(found, key=order) == sorted(expected, key=order)
    assert next(r for r in found if r[1] == 6)[2:8] == (0,) * 6  # the underscore piece is no space
    assert sum(r[4] < r[5] for r in found) > 20  # wide groups occur


@pytest.mark.parametrize("most,step", [(1 << 18, 40), (50, 7), (0, 500)])
def test_chunks_have_the_tokens_of_the_whole_text(most, step):
    a, b = token_links.public_tokenizers()
    left, right = token_links.ByteRanks(*a), token_links.Pieces(*b)
    assert left.apart and right.apart and not token_links.ByteRanks(a[0], r"\S+\s?|\s+").apart
    rng = random.Random(5)
    bits = ["a", "foo", "é", "日本", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "▁", "'s", "12", "?!", "<s>", "\x00", "🙂", "\u3000", "\u0308"]
    values = texts() + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    memo = token_links.Memo(left, right, most)
    for i in range(0, len(values), step):
        part = values[i : i + step]
        sides = memo.texts(part)
        for j, text in enumerate(part):
            want = [s.encode(text) if text else None for s in (left, right)]
            want = [[], []] if any(x is None for x in want) else [x.tolist() for x in want]
            assert [ids[f[j] : f[j + 1]].tolist() for ids, f in sides] == want
        assert len(memo.known) <= most


def test_known_chunks_are_not_encoded_again():
    memo = token_links._memo(*token_links.public_tokenizers())
    memo.texts(["one two three", "two"])
    calls = []
    for side in memo.sides:
        side.encode = lambda text, real=side.encode: calls.append(text) or real(text)
    try:
        memo.texts(["three two one", "one two two four"])
    finally:
        for side in memo.sides:
            del side.encode
    assert calls == ["four", "four"]


def test_long_chunks_are_forgotten():
    a, b = token_links.public_tokenizers()
    memo = token_links.Memo(token_links.ByteRanks(*a), token_links.Pieces(*b), 100)
    first = memo.texts(["x" * 5000 + " y", "▁" * 5000, "x y"])
    assert not memo.known and memo.held == 0 and all(len(x) == 0 for x in memo.ids)
    again = memo.texts(["x" * 5000 + " y", "▁" * 5000, "x y"])
    assert all(np.array_equal(x, y) for s, t in zip(first, again) for x, y in zip(s, t))
    memo.texts(["x y", "x z"])
    assert list(memo.known) == [" x", " y", " z"] and memo.held == 6


def test_links_of_rare_pairs_by_shuffle(spark, linked):
    _, got, docs = linked
    again = token_links.align(docs, *token_links.public_tokenizers(), max_broadcast=5).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_a, r.n_links, r.n_best, r.count_sum)
    assert sorted(map(key, again)) == sorted(map(key, got))


@pytest.mark.parametrize("most", [0, 1, 5, 6, 1000])
def test_frequent_keeps_its_bound(spark, most):
    n = [1, 1, 1, 2, 2, 3, 9, 10, 4096, 10**12]
    counts = spark.createDataFrame([(i, v) for i, v in enumerate(n)], "pair long, n long")
    least = token_links.frequent(counts, most)
    assert sum(v >= least for v in n) <= most and (most < 1000 or least == 1)


def test_links_of_nothing(spark):
    empty = frame(spark, [], SCHEMA)
    assert token_links.align(empty, *token_links.public_tokenizers()).count() == 0


def test_op11(spark, sf):
    from pyspark.sql.types import LongType

    got = token_links.op11_token_links(spark, sf)
    assert [f.name for f in got.schema.fields if f.dataType == LongType()] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {key: (n_a, n_b, len(g), hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else "") for key, n_a, n_b, g in brute(docs)}
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.groups_sha256) for r in got.collect()} == want


# ---------------------------------------------------------------- filter audit


def audited(docs, labels):
    """{(part, order, step): counts} by carrying out every order on every row."""
    good = {d for d, q, t in labels if d is not None and q == 1}
    toxic = {d for d, q, t in labels if d is not None and t == 1}
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, lang, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": t in least and (d is None or least[t] < d),
        }
        rows.append((lang or "", d, {k for k, v in fails.items() if v}))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[2]]
                gone = len([r for r in own if f in r[2]]) - len(removed)
                left = [r for r in left if f not in r[2]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), gone, sum(r[2] == {f} for r in own), sum(r[1] in good for r in removed), sum(r[1] in toxic for r in removed)]
        for key, counts in out.items():
            if key[0] == part:
                counts.append(shapley[key[1][key[2] - 1]])
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(5)
    say = lambda n, kinds=10**6: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    pool = [None, "", " \n", "ONE", "A" * 9 + "é" * 81, "A" * 9 + "é" * 80, say(99), say(100), say(120, 30), say(150) + " #", "x|", say(100) + "\x0bLAST", "| $ % & *", say(300).upper()]
    docs = [(i, rng.choice(pool), rng.choice(["en", "de", "", None]), None, 0) for i in range(160)]
    docs += [docs[3], docs[3], (3, "another text of the same id", "en", None, 0), (None, pool[6], "en", None, 0), (None, "held by nobody else", "en", None, 0), (None, "held by nobody else", "de", None, 0)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table = frame(spark, docs).withColumns({"mask": F.lit(1), "n": F.lit("x"), "part": F.lit("y"), "_own": F.lit(0)})
    got = filter_audit.audit(table, known).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got} == audited(docs, labels)
    assert len(got) == 3 * 600


def test_audit_of_nothing(spark):
    empty = frame(spark, [], SCHEMA)
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    none = frame(spark, [(None, None, None, None, None)])
    rows = filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and all(r.removed == (r.filter_order[r.step - 1] == "A") for r in rows)


def test_op12_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(filter_audit.OP12_SQL).df()
    got = filter_audit.op12_filter_audit(spark, sf).toPandas()
    keys = ["part", "filter_order", "step"]
    want, got = (x.sort_values(keys).reset_index(drop=True) for x in (want, got))
    assert len(got) > 0 and got[want.columns].equals(want.astype(got[want.columns].dtypes))


# ---------------------------------------------------------------- language identification


def test_characters_and_counts():
    said = lambda t: "".join(map(chr, language_id.characters(t)))
    assert said("Ab  c1,É!") == " ab c é " and said("12 .") == "" and said("") == "" and said("x") == " x "
    text = "Straße, ñandú über " * 50
    own, codes = collections.Counter(), said(text)
    for n in (1, 2, 3):
        own.update(codes[i : i + n] for i in range(len(codes) - n + 1))
    at, n = language_id.counts(text, 1 << 16, 3)
    assert sorted(n) == sorted(own.values()) and list(at) == sorted(set(at))


def test_long_texts_are_counted_by_pieces(monkeypatch):
    text = "eins zwei drei vier " * 40
    whole = language_id.counts(text, 1 << 10, 3)
    monkeypatch.setattr(language_id, "PIECE", 37)
    pieces = language_id.counts(text, 1 << 10, 3)
    assert all((a == b).all() for a, b in zip(whole, pieces))


def test_ftrl_is_exact_and_sparse():
    """Without penalties the first step is a gradient step scaled by its own size; with them weights under l1 are zero."""
    z, n = np.zeros((3, 2)), np.zeros((3, 2))
    language_id.learn(z, n, np.array([0, 2]), np.array([0.6, 1.0]), 1, 0.5, 0.0, 0.0)
    g = np.outer([0.6, 1.0], [0.5, -0.5])
    assert np.allclose(z[[0, 2]], g) and np.allclose(n[[0, 2]], g * g) and not z[1].any()
    assert np.allclose(language_id.weights_of(z, n, 0.5, 0, 0)[[0, 2]], -g * 0.5 / (1 + np.abs(g)))
    assert (language_id.weights_of(z, n, 0.5, 0.4, 0)[0] == 0).all() and (language_id.weights_of(z, n, 0.5, 0.4, 0)[2] != 0).all()


def test_temperature_is_where_the_likelihood_is_greatest(spark):
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(800, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    y = [int(rng.choice(3, p=v)) for v in p]
    rows = spark.createDataFrame([(k, (3 * v).tolist()) for k, v in zip(y, logits)], "y int, logits array<double>")
    t = language_id.temperature_of(rows)

    def loss(t):
        v = 3 * logits / t
        return np.mean(np.log(np.exp(v).sum(axis=1)) - v[np.arange(800), y])

    assert abs(t - 3) < 0.5 and loss(t) <= min(loss(t * 1.002), loss(t / 1.002))
    assert language_id.temperature_of(rows.limit(0)) == 1.0


def test_op13_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in language_id.op13_language_id(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out and got[r.doc_id].lang_pred != "und"]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    # labels, sources and ids are no inputs of a prediction, and labels of held-out documents none of the training
    other = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = {r.doc_id: r for r in language_id.identify(other, language_id.fit(other.where(~language_id.held_out()))).collect()}
    assert all(again[k].lang_pred == v.lang_pred and again[k].score == pytest.approx(v.score) for k, v in got.items())


def test_language_cases(spark):
    rows = [(i, t, l, None, 0) for i, (t, l) in enumerate([("the house and the tree", "en"), ("das Haus und der Baum", "de")] * 20)]
    rows += [(None, "and the house", "en", None, 0), (90, None, "en", None, 0), (91, "", None, None, 0), (92, "12 !?", "de", None, 0), (93, "der Baum und das Haus " * 30_000, None, None, 0), (94, "Ωμέγα", None, None, 0), (0, "the tree", "en", None, 0)]
    docs = frame(spark, rows).withColumns({"lang_pred": F.lit("clash"), "score": F.lit("clash"), "y": F.lit(1), "label": F.lit("z")})
    model = language_id.fit(docs, per_label=15, buckets=1 << 12)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()]
    assert len(got) == len(rows)
    by = {d: (p, s) for d, p, s in got}
    assert by[90] == by[91] == by[92] == ("und", 0.0) and by[93][0] == "de" and by[94][0] in ("de", "en") and by[None][0] == "en"
    nothing = language_id.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0 and language_id.fit(docs.limit(0)).labels == []
    only = language_id.fit(docs.where("lang = 'en'"))
    assert {r.score for r in language_id.identify(docs.where("doc_id < 40"), only).collect()} == {1.0}
    with pytest.raises(ValueError, match="max_labels"):
        language_id.fit(docs, max_labels=1)


# ---------------------------------------------------------------- ids


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_ids_that_are_no_integers_are_refused(spark, ansi):
    docs = spark.createDataFrame([("a1", "one two three four five six"), ("a2", "one two three four five six")], "doc_id string, text string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for f in (parity_join.jaccard_components, parity_join.keep_one, substring_dedup.dedup_substrings, substring_dedup.drop_repeats):
            with pytest.raises(TypeError, match="integer"):
                f(docs)
        short = docs.select(F.substring("doc_id", 2, 1).cast("short").alias("doc_id"), "text")
        assert {r.component_id for r in parity_join.jaccard_components(short).collect()} == {1}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
