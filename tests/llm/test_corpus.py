"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, copies and clashing names."""

import collections
import hashlib
import math
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from latticore.llm import bpe_fst, chat, common, hmm_lm, mixing, page_diff, parity_join, quality, substring_dedup, topk, url_trie
from pyspark.sql import functions as F

VOCABULARY = [a + b for a in "ba ne ko ti su la mo ré ß".split() for b in "xyz!"]


def words(text):
    return (text or "").encode().split()


def lower(text):
    return (text or "").encode().lower().split()


def corpus(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, nulls, empties, short and long texts."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 40)) for _ in range(k))
    passage, out = say(60), []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            text = say(120)
        elif kind == 1:
            text = out[-1][1]
        elif kind == 2:
            w = out[-1][1].split()
            w[rng.randrange(len(w))] = "Edited"
            text = " ".join(w).upper() if i % 20 == 2 else "\n".join(w)
        elif kind == 3:
            text = say(30) + " " + passage + "\t" + say(40)
        elif kind == 4:
            text = ["", None, "one", "  \n ", "One", "a b c d e"][i // 10 % 6]
        elif kind == 5:
            text = (say(8) + "\n") * 9 + "x"
        elif kind == 6:
            text = "the " * 40
        elif kind == 7:
            text = say(3000 if i == 7 else 70)
        else:
            text = say(rng.randint(1, 90))
        out.append((i, text, ["en", "de", None][i % 3], ["s1", "s10", "é", None, "s1"][i % 5], len(text or "")))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# ---------------------------------------------------------------- common


def test_words_and_hashes():
    texts = ["a b", "", "ab", None, "  x\x0b\x1cy z\u00a0 ", "A\r\nb"]
    (_, _, w), = common.slices(pa.array(texts), lower=True)
    assert w.counts().tolist() == [len(lower(t)) for t in texts]
    assert [w.word(i) for i in range(len(w.starts))] == [x for t in texts for x in lower(t)]
    h = w.hashes()
    assert h[0] != h[1] and h[0] == h[-2] and h[1] == h[-1]
    assert len(set(common.windows(h, 2).tolist())) == len(h) - 2  # "a b" twice


def test_slices_cover_long_texts(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["a b c"] * 5 + ["long " * 50, "", None, "z"]
    got = list(common.slices(pa.chunked_array([texts[:3], texts[3:]])))
    assert [(a, b) for a, b, _ in got][0][0] == 0 and got[-1][1] == len(texts)
    assert sum((w.counts().tolist() for _, _, w in got), []) == [len(words(t)) for t in texts]


# ---------------------------------------------------------------- 1


def kinds(page):
    lines = page_diff.page_lines(page)
    return {k: [t for x, _, t in lines if x == k] for k in (page_diff.CONTENT, page_diff.UNDECIDED, page_diff.PERHAPS)}


def test_page_lines():
    page = '<title>t</title><body class="has-sidebar"><header>H</header><div class="with-sidebar"><article><h1>A &amp;\n B</h1><p>x<b>y</b> z<br>w<section id="comments"><article><p>c</p></article></section><form>f</form><p>&lt;end&#33;</article></div><footer>F</footer><p>tail'
    assert kinds(page) == {page_diff.CONTENT: ["A & B", "xy z", "w", "<end!"], page_diff.UNDECIDED: ["tail"], page_diff.PERHAPS: []}
    assert page_diff.page_lines(None) == page_diff.page_lines("") == []
    assert [x[::2] for x in page_diff.page_lines("<p>cut off <a href='x")] == [(1, "cut off")]
    assert page_diff.page_lines("<script>var a='<p>no</p>'") == page_diff.page_lines("<noframes><p>no</p></noframes>") == []
    assert [x[1][-1] for x in page_diff.page_lines("<li><a href='/'>x <b>y</b></a></li><li>z <a>w</a></li><li><a>v</a>")] == ["a", "-", "a"]


def test_comments_and_names():
    text = lambda page: page_diff.main_text(page_diff.page_lines(page), None)
    assert text('<main><p>Real body.</p></main><section id="comments"><article><p>reader comment</p></article></section>') == "Real body."
    assert text('<article><p>Real.</p><div class="comment-list"><article><p>c</p></article></div></article><div id=disqus><main>d</main></div>') == "Real."
    assert text('<article>Real.</article><article class="comment">c</article><article class="user comment">c</article>') == "Real."
    assert text('<article class="comment">An opinion.</article>') == "An opinion."
    assert text('<article><h2 id="related">A</h2><p class="search">b</p><ul class="notice-of-meeting"><li class="ad">c</li></ul><div class="notice">n</div><div class="ad">x</div></article>') == "A b c"
    assert text('<div class="sidebar-layout"><article><p hidden>no</p>yes</article></div><div class="related"><article>teaser</article></div>') == "yes"


def test_long_pages():
    rng = np.random.default_rng(2)
    a = [str(i) for i in rng.permutation(100_000) // 3]
    b = a[50_000:] + a[:50_000]
    assert len(page_diff.shared_lines(a, b)) >= 50_000
    lines = [(1, "00000000-", t) for t in a]
    assert page_diff.unpacked(page_diff.packed(lines)) == lines and page_diff.unpacked(page_diff.packed([])) == []


@pytest.mark.parametrize("piece", ["<div class=a><p>t ", "<p><b>t ", "<p><div><b><hr>t ", "<li><a>t "])
def test_unclosed_elements_cost_by_length(piece):
    """100,000 elements that never close, some 20 seconds for a twelfth of them where each line looks through all that are open."""
    began = time.process_time()
    lines = page_diff.page_lines(piece * 100_000)
    assert sum(len(t.split()) for _, _, t in lines) == 100_000
    assert time.process_time() - began < 30


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("uvwxy") for _ in range(rng.randint(0, 9))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = page_diff.shared_lines(a, b)
        assert len(got) == best[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in sorted(got))


def test_extract_text(spark):
    page = lambda body: f"<body><div>Site name</div>{body}<div>Contact us</div></body>"
    pages = [
        (1, "http://h.org/a/1", page("<p>first text</p>"), "x"),
        (2, "http://h.org/a/2?q", page("<p>second text</p><p>more</p>"), "x"),
        (3, "http://h.org/a/3", None, None),
        (4, None, page("<p>alone</p>"), "x"),
        (5, "http://k.org/a/1", "<nav>n</nav><main><p>same</p></main>", "x"),
        (6, "http://k.org/a/2", "<nav>n</nav><main><p>same</p></main>", "x"),
        (7, "http://c.org/z", "<p>copy</p>", "x"),
        (7, "http://c.org/z", "<p>copy</p>", "x"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    for n in (128, 1):
        got = page_diff.extract_text(df, segment_pages=n).collect()
        assert {len(r) for r in got} == {3}
        assert sorted((r.page_id, r.text) for r in got) == [(1, "first text"), (2, "second text more"), (3, ""), (4, "Site name alone Contact us"), (5, "same"), (6, "same"), (7, "copy"), (7, "copy")]
    assert page_diff.extract_text(df.limit(0)).collect() == []


def test_pages_meet_their_nearest_url(spark):
    """Whatever the segments and partitions, over folders and lone folders: each page against the nearest of its host, by brute force."""
    rng = random.Random(12)
    pages = []
    for i in range(120):
        host = rng.choice(["a.org", "a.org", "a.org", "b.org", "c.org"]) if i else "lone.org"
        path = "/".join(rng.choice(["en", "de", "x"]) for _ in range(rng.randint(0, 3))) + rng.choice(["", "/", f"/{rng.randint(0, 30)}"])
        body = "".join(f"<{t}>{rng.choice('uvwxyz')}{rng.choice(['', ' t'])}</{t}>" for t in rng.choices(["p", "div", "li"], k=rng.randint(0, 12)))
        pages.append((i % 110, f"http://{host}/{path}", body + ("<ul><li><a>m1</a></li><li><a>m%d</a></li></ul>" % i if i % 2 else ""), "clash"))
    order = sorted(((u.split("/")[2].encode(), "/" + u.split("/", 3)[3], str(i).encode(), k) for k, (i, u, *_) in enumerate(pages)), key=lambda x: (x[0], x[1].encode(), x[2], x[3]))
    want = []
    for n, (host, path, _, k) in enumerate(order):
        sides = [order[m] for m in (n - 1, n + 1) if 0 <= m < len(order) and order[m][0] == host]
        partner = max(sides, key=lambda x: page_diff._common(x[1], path)) if sides else None
        want.append((pages[k][0], page_diff.main_text(page_diff.page_lines(pages[k][2]), partner and page_diff.page_lines(pages[partner[3]][2]))))
    df = spark.createDataFrame(pages, "page_id long, url string, html string, _host string")
    unique = len({x[:3] for x in order}) == len(order)  # pages alike in key would make brute force's order its own
    assert unique
    for n, tasks in ((128, 1), (7, 3), (1, 5)):
        got = page_diff.extract_text(df.repartition(tasks), segment_pages=n)
        assert got.columns == ["page_id", "url", "_host", "text"]
        assert sorted((r.page_id, r.text) for r in got.collect()) == sorted(want)


# ---------------------------------------------------------------- 2


def forward(model, classes):
    a = model.start * model.emit[classes[0]]
    for c in classes[1:]:
        a = (a @ model.move) * model.emit[c]
    return math.log10(a.sum())


def test_group_forward_and_expected_counts():
    rng = np.random.default_rng(5)
    m = hmm_lm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3).T.copy())
    lengths = [3, 1, 7, 3]
    first = np.concatenate([[0], np.cumsum(lengths)])
    classes = rng.integers(0, 4, first[-1])
    seqs = [classes[a:b] for a, b in zip(first, first[1:])]
    assert np.allclose(hmm_lm.Group(classes, first).log10(m), [forward(m, s) for s in seqs])
    starts, moves, emits = hmm_lm.Group(classes, first).expected(m)
    want_starts, want_moves, want_emits = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for s in seqs:
        alpha, beta = np.zeros((len(s), 3)), np.ones((len(s), 3))
        for t, c in enumerate(s):
            alpha[t] = (m.start if not t else alpha[t - 1] @ m.move) * m.emit[c]
        for t in range(len(s) - 2, -1, -1):
            beta[t] = m.move @ (m.emit[s[t + 1]] * beta[t + 1])
        p = alpha[-1].sum()
        want_starts += alpha[0] * beta[0] / p
        for t, c in enumerate(s):
            want_emits[c] += alpha[t] * beta[t] / p
            if t:
                want_moves += np.outer(alpha[t - 1], m.emit[c] * beta[t]) * m.move / p
    assert np.allclose(starts, want_starts, atol=1e-5) and np.allclose(moves, want_moves, atol=1e-5) and np.allclose(emits, want_emits, atol=1e-5)


def check_scores(rows, got):
    texts = [(d, [*lower(t), b"\n"]) for d, t, *_ in rows]
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter(w for d, x in texts if not out(d) for w in x)
    total, kinds = sum(c.values()), len(c)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, x in texts:
        r = by[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(d), len(x), sum(w in c for w in x), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in x))
    return by


def test_hmm_scores(docs, rows, empty):
    by = check_scores(rows, hmm_lm.score_texts(docs, states=3, min_count=2).collect())
    assert sum(r.score for r in by.values()) > sum(r.base_score for r in by.values())
    assert hmm_lm.score_texts(empty).collect() == []


def test_hmm_one_state_is_the_base(docs):
    for r in hmm_lm.score_texts(docs, states=1, sample_docs=0, min_count=2).collect():
        assert r.score == pytest.approx(r.base_score)


def test_hmm_every_frequent_token_is_a_class(spark):
    """70,000 kinds, each twice in texts of one of two halves: every one gets emissions of its own."""
    n = 70_000
    inside = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = [" ".join(f"w{k}" for k in range(a, a + 100)) for a in range(0, n, 100)]
    rows = spark.createDataFrame(list(zip(inside, texts + texts)), "doc_id long, text string").repartition(3)
    seen = []
    plain = hmm_lm.train
    hmm_lm.train = lambda *a, **b: seen.append(plain(*a, **b)) or seen[-1]
    try:
        got = hmm_lm.score_texts(rows, states=2, min_count=2, block_tokens=30_000).collect()
    finally:
        hmm_lm.train = plain
    (emissions, model), = seen
    assert len(got) == 2 * len(texts) and emissions.count() == n + 1  # and the end token
    e = np.array([np.frombuffer(r.e, "<f4") for r in emissions.collect()], float)
    assert np.allclose(e.sum(axis=0) + model.emit[-1], 1)
    assert (abs(e[:, 0] / e[:, 1] - 1) > 0.001).sum() > n // 2


def test_hmm_scores_against_plain_baum_welch(spark, docs, rows, monkeypatch):
    """From the same start, two rounds and the scores in plain Python, token by token; on blocks and rows of any size, repeated rows and clashing names too."""
    starts = []
    plain = hmm_lm._start

    def start(*a, **b):
        found = plain(*a, **b)
        starts.append((found[0].collect(), found[1]))
        return found

    monkeypatch.setattr(hmm_lm, "_start", start)
    again = docs.unionByName(docs.where("doc_id % 3 = 0")).withColumns({"block": F.lit(1), "token": F.lit("x"), "e": F.lit(0)})
    got = hmm_lm.score_texts(again, states=3, min_count=2, block_tokens=900, group_tokens=150).collect()
    texts = [(d, [*lower(t), b"\n"]) for d, t, *_ in rows]
    texts += [(d, x) for d, x in texts if d is not None and d % 3 == 0]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, _ in texts)
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = collections.Counter(w for d, x in texts if not out(d) for w in x)
    weights = sum(c.values()) + len(c) + 1
    classes = {w for w in c if c[w] >= 2}
    rare_weight = weights - sum(c[w] + 1 for w in classes)
    emissions, m = starts[0]
    hashes = lambda words: hmm_lm._tokens(next(common.slices(pa.array([b" ".join(words).decode()])))[2])[0]
    named = sorted(w for w in classes if w != b"\n")
    of = dict(zip(hashes(named).tolist(), [*named, b"\n"]))
    e = {of[r.token]: np.frombuffer(r.e, "<f4").astype(float) for r in emissions}
    assert set(e) == classes
    start, move, rare = m.start, m.move, m.emit[-1]
    for _ in range(2):
        starts_, moves, emits = np.zeros(3), np.zeros((3, 3)), {w: np.zeros(3) for w in [*classes, None]}
        for d, x in texts:
            if out(d):
                continue
            b = [e.get(w, rare) for w in x]
            alpha, beta = [start * b[0]], [np.ones(3)]
            for v in b[1:]:
                alpha.append((alpha[-1] @ move) * v)
                alpha[-1] = alpha[-1] / alpha[-1].sum()
            for v in b[:0:-1]:
                beta.insert(0, move @ (v * beta[0]))
                beta[0] = beta[0] / beta[0].sum()
            for t, w in enumerate(x):
                gamma = alpha[t] * beta[t]
                emits[w if w in classes else None] += gamma / gamma.sum()
                if t:
                    xi = np.outer(alpha[t - 1], b[t] * beta[t]) * move
                    moves += xi / xi.sum()
            gamma = alpha[0] * beta[0]
            starts_ += gamma / gamma.sum()
        total = sum(emits.values())
        rare = (emits[None] + 50 * rare_weight / weights) / (total + 50)
        e = {w: (emits[w] + 50 * (c[w] + 1) / weights) / (total + 50) for w in classes}
        start, move = (starts_ + 0.5) / (starts_ + 0.5).sum(), (moves + 0.5) / (moves + 0.5).sum(axis=1, keepdims=True)
    want = collections.defaultdict(set)
    for d, x in texts:
        logs, alpha = 0.0, start
        for t, w in enumerate(x):
            a = (alpha if not t else alpha @ move) * e.get(w, rare)
            logs += math.log10(a.sum()) + (0 if w in classes else math.log10((c[w] + 1) / rare_weight))
            alpha = a / a.sum()
        want[d].add(round(logs, 3))
    for r in got:
        assert any(abs(r.score - v) <= 1e-3 + 1e-5 * abs(v) for v in want[r.doc_id]), (r.doc_id, r.score, want[r.doc_id])


def test_hmm_without_training_rows(spark):
    d = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r, = hmm_lm.score_texts(spark.createDataFrame([(d, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


# ---------------------------------------------------------------- 3


def test_targets():
    got = mixing.targets([100, 50, 10, 0], [5, 2, 1, 5], 3)
    assert got.tolist() == [100.0, 40.0, 20.0, 0.0]
    capped = mixing.targets([10, 1000, 1000], [5, 2, 1], 3)
    assert capped[0] == 30 and capped.sum() == pytest.approx(2010) and capped[1] == pytest.approx(2 * capped[2])


def test_sainte_lague_is_highest_quotients():
    rng = random.Random(2)
    for _ in range(60):
        votes = [rng.choice([0, rng.random() * 100, rng.randint(1, 9)]) for _ in range(rng.randint(1, 7))]
        caps = [rng.randint(0, 30) for _ in votes]
        seats = rng.randint(0, 80)
        want = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i, v in enumerate(votes) if v and want[i] < caps[i]]
            if not open_:
                break
            best = max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert mixing.sainte_lague(votes, seats, caps).tolist() == want
    assert mixing.sainte_lague([3, 1], 10**12).sum() == 10**12


def test_mix(docs, rows, empty, spark):
    got = mixing.mix_sources(docs, block=4).collect()
    size = {d: len(words(t)) for d, t, *_ in rows}
    of = {d: s for d, _, _, s, _ in rows}
    order = sorted(set(of.values()), key=lambda s: (s is None, s or ""))
    totals = [sum(size[d] for d in of if of[d] == s) for s in order]
    goal = dict(zip(order, mixing.targets(totals, [[5, 2, 1][i % 3] for i in range(len(order))], 3)))
    assert len(got) == len(rows)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == totals[order.index(r.source)] and r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 3 * r.size
    for s in order:
        assert abs(sum(r.taken for r in got if r.source == s) - goal[s]) <= 0.03 * goal[s] + 8
    again = mixing.mix_sources(docs.repartition(7), block=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(empty).collect() == []
    small = mixing.mix_sources(docs, block=4, shard_docs=5).collect()
    assert abs(sum(r.taken for r in small) - sum(totals)) < 0.05 * sum(totals)
    stay = mixing.mixed(docs, block=4)
    assert stay.columns == docs.columns and stay.where("text is null").isEmpty()


def highest_quotients(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(min(seats, sum(c for c, v in zip(caps, votes) if v > 0))):
        out[max((i for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0), key=lambda i: (Fraction(votes[i]) / (2 * out[i] + 1), -i))] += 1
    return out


def test_mix_by_listing_blocks(docs, rows):
    """Quotas by dealing seat after seat, words taken by listing every word's block; repeated rows, null ids and clashing names included."""
    extra = docs.where("doc_id % 4 = 0").withColumn("doc_id", F.when(F.col("doc_id") % 8 != 0, F.col("doc_id")))
    many = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(extra).unionByName(extra).withColumns({"key": F.lit(1), "n": F.lit(2), "shard": F.lit("x"), "size": F.lit(3)})
    how = dict(block=4, shard_docs=3, fan=2, seed=5)
    dealt = [r.asDict() for r in mixing._dealt(many, "doc_id", "source", "text", (5, 2, 1), 3, 4, 3, 5, 99, 2).collect()]
    assert sum(r["n"] for r in dealt) == many.count()
    starts = {(r.source, r.shard): r.s for r in docs.sparkSession.createDataFrame([(r["source"], r["shard"]) for r in dealt], "source string, shard long").select("source", "shard", F.xxhash64("source", "shard", F.lit(5)).alias("s")).collect()}
    want = collections.Counter()
    for source in {r["source"] for r in dealt}:
        own = [r for r in dealt if r["source"] == source]
        shards = sorted({r["shard"] for r in own})
        words_of = {s: sum(r["size"] * r["n"] for r in own if r["shard"] == s) for s in shards}
        blocks = {s: -(-words_of[s] // 4) for s in shards}
        groups = [[s for s in shards if s // 2 == g] for g in sorted({s // 2 for s in shards})]
        top = highest_quotients([sum(words_of[s] for s in g) for g in groups], own[0]["source_quota"], [3 * sum(blocks[s] for s in g) for g in groups])
        assert own[0]["source_quota"] == min(sum(3 * b for b in blocks.values()), own[0]["source_quota"])
        for g, q in zip(groups, top):
            for s, quota in zip(g, highest_quotients([words_of[s] for s in g], q, [3 * blocks[s] for s in g])):
                here = sorted((r for r in own if r["shard"] == s), key=lambda r: r["end"])
                assert {r["quota"] for r in here} == {quota}
                n = max(blocks[s], 1)
                start, more = starts[source, s] % n, quota % n
                times = [quota // n + ((j + 1) * more + start) // n - (j * more + start) // n for j in range(n)]
                laid = [(r["doc_id"], source, r["text_hash"], k) for r in here for k in range(r["n"]) for _ in range(r["size"])]
                counts = collections.Counter()
                for i, of in enumerate(laid):
                    counts[of] += times[i // 4]
                want.update((d, source, r["size"], counts[d, source, h, k]) for r in here for k in range(r["n"]) for d, h in [(r["doc_id"], r["text_hash"])])
    got = collections.Counter((r.doc_id, r.source, r.size, r.taken) for r in mixing.mix_sources(many, **how).collect())
    assert got == want
    kept = mixing.mixed(many, **how)
    assert kept.columns == many.columns
    rows_of = collections.Counter((r.doc_id, r.source, r.text) for r in many.collect())
    found = collections.Counter((r.doc_id, r.source, r.text) for r in kept.collect())
    assert all(found[x] <= 3 * rows_of[x] for x in found)
    for s in {(r["source"], r["shard"]) for r in dealt}:  # a shard's words are its quota's, but for half of one of its smallest documents
        own = [r for r in dealt if (r["source"], r["shard"]) == s and r["size"]]
        ids = {r["doc_id"] for r in own}
        if own and None not in ids and len(ids) == len(own):
            words_kept = sum(len(words(t)) * c for (d, q, t), c in found.items() if q == s[0] and d in ids)
            small = min(int(math.log2(r["size"])) for r in own)
            rate = min(3.0, own[0]["quota"] * 4 / sum(r["size"] * r["n"] for r in own))
            assert abs(words_kept - rate * sum(r["size"] * r["n"] for r in own)) <= 2 ** (small + 1) * 1.5 or rate > 2.5


# ---------------------------------------------------------------- 4


def fits(host, path, rule):
    _, h, p = rule
    return (host == h or host.endswith("." + h)) and path.startswith(p)


def test_url_filter(spark):
    rng = random.Random(4)
    hosts = ["example.com", "a.example.com", "example.net", "xexample.net", "com", "org", "EXAMPLE.org", "", "example.net:80"]
    paths = ["/en/7", "/en/77?x", "/en/8#y", "/de/8", "/de/", "/de", "", "/es/x/y/z", "//en/7", "/en", "?/en/7"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "a://b://c/en/7", "://com/en/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = [*url_trie.RULES, ("allow", "Example.ORG", "/es/x/"), ("block", "example.org", "/es/x/"), ("block", "a.example.com", ""), url_trie.RULES[0]]
    for most in (200_000, 2):
        for r in url_trie.url_filter(df, rules, max_rules=most).collect():
            rest = r.url.partition("://")[2] if r.url and "://" in r.url else ""
            k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:k].lower(), rest[k:].split("?")[0].split("#")[0]
            own = [x for x in rules if host and fits(host, path, (x[0], x[1].lower(), x[2]))]
            best = max(own, key=lambda x: (len(x[1] + x[2]), len(x[1]), x[0] == "block"), default=None)
            assert (r.host, r.path) == (host, path)
            assert (r.rule, r.verdict) == ((best[1].lower() + best[2], best[0]) if best else (None, "allow")), r
    assert url_trie.url_filter(df.limit(0), rules).collect() == []
    with pytest.raises(ValueError):
        url_trie.UrlTrie([("block", "", "/x")])


# ---------------------------------------------------------------- 5


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_fst.public_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=vocabulary[0], special_tokens={})


@pytest.mark.parametrize("states", [0, 50, 20_000])
def test_transducer_is_the_library(vocabulary, library, states):
    codec = bpe_fst.Codec(*vocabulary, max_pieces=100, max_states=states)
    rng = random.Random(6)
    letters = "aeiouthnsr éèß  \n\t,.!0123日本語한😀\x1c\x85\u0301"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)] + [c * n for c in ("a", "=", "é", "日") for n in (1, 7, 700)] + ["<|endoftext|>", None]
    for t in texts:
        ids = list(codec.encode(t))
        assert ids == library.encode_ordinary(t or "")
        assert all("".join(codec.decode_stream(ids, n)) == (t or "") for n in (1, 3, 4096))


def test_unreachable_tokens():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"xyz": 301}
    import tiktoken

    library = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    codec = bpe_fst.Codec(ranks, r"\S+|\s+")
    rng = random.Random(7)
    for _ in range(500):
        t = "".join(rng.choice("abcxyz ") for _ in range(rng.randint(0, 12)))
        assert list(codec.encode(t)) == library.encode_ordinary(t)


def test_utf8_machine():
    rng = random.Random(8)
    for _ in range(5000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xA9, 0xE0, 0xA0, 0x9F, 0xED, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0]) for _ in range(8))
        m, j, k = bpe_fst.Utf8Machine(), *sorted((rng.randint(0, 8), rng.randint(0, 8)))
        assert m.feed(data[:j]) + m.feed(data[j:k]) + m.feed(data[k:]) + m.close() == data.decode("utf-8", "replace")


def test_bpe_tables(docs, rows, vocabulary, library, empty):
    coded = bpe_fst.encode(docs.withColumn("ids", F.lit("clash")), *vocabulary, decoded="decoded")
    text = {d: t or "" for d, t, *_ in rows}
    got = coded.select("doc_id", "ids", *(v.alias(k) for k, v in bpe_fst.digests(coded).items())).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    back = bpe_fst.decode(coded.drop("decoded", "text"), *vocabulary).collect()
    assert {r.doc_id: r.text for r in back} == text
    assert bpe_fst.encode(empty, *vocabulary).collect() == []
    again = coded.unionByName(coded).select("doc_id", "ids")
    assert sorted((r.doc_id, r.text) for r in bpe_fst.decode(again, *vocabulary).collect()) == sorted([*text.items()] * 2)
    for bad in ([-1], [10**6]):
        with pytest.raises(Exception, match="vocabulary"):
            bpe_fst.decode(docs.sparkSession.createDataFrame([(bad,)], "ids array<int>"), *vocabulary).collect()


# ---------------------------------------------------------------- 6


def sets(rows):
    out = []
    for d, t, *_ in rows:
        w = lower(t)
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute_components(rows, similarity=Fraction(3, 4)):
    s = sets(rows)
    at = list(range(len(s)))
    find = lambda i: i if at[i] == i else find(at[i])
    for i, (_, x) in enumerate(s):
        for j, (_, y) in enumerate(s[:i]):
            if x and y and len(x & y) >= similarity * len(x | y):
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(s):
        ids[find(i)].append(d)
    return [(d, len(x), min((k for k in ids[find(i)] if k is not None), default=None)) for i, (d, x) in enumerate(s)]


@pytest.mark.parametrize("similarity", ["0.05", "0.3", "0.5", "0.51", "0.6", "0.75", "0.9", "1"])
def test_linked_sets_share_a_key_and_sketches_bound(similarity):
    rng = np.random.default_rng(9)
    s = Fraction(similarity)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        x = np.unique(common.mix(rng.integers(1, 2**62, n).astype(np.uint64)))
        gone, new = rng.random(2) * (1 - float(s)) * [1, 1 / float(s)]
        y = np.unique(np.concatenate([x[rng.random(len(x)) >= gone], common.mix(rng.integers(1, 2**62, int(n * min(new, 3))).astype(np.uint64))]))
        both = len(np.intersect1d(x, y))
        if not len(y) or both < s * (len(x) + len(y) - both):
            continue
        assert set(parity_join.block_keys(x, s)) & set(parity_join.block_keys(y, s))
        a, b = parity_join.sketch(x), parity_join.sketch(y)
        k = min(len(a), len(b))
        apart = int(np.bitwise_count(parity_join.folded(a, k) ^ parity_join.folded(b, k)).sum())
        assert apart <= len(x) + len(y) - 2 * both


def chain(n=40):
    """Each text is near the next one, not the one after next; and a hot passage on unlike texts."""
    rng = random.Random(10)
    w = [f"c{i}" for i in range(100)]
    out = []
    for i in range(n):
        out.append((i, " ".join(w), "en", "s", 0))
        w = w.copy()
        k = rng.randrange(0, 86)
        w[k : k + 7] = [f"e{i}_{j}" for j in range(7)]
    hot = " ".join(f"h{i}" for i in range(60))
    out += [(n + i, hot + " " + " ".join(f"o{i}_{j}" for j in range(20 + i % 9)), "en", "s", 0) for i in range(30)]
    rng.shuffle(out)
    return out


def test_jaccard_components(docs, rows, empty, spark):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.jaccard_components(docs).collect())
    assert got == sorted(brute_components(rows))
    more = [*chain(), (None, "x y z", None, None, None), (None, "x Y z", None, None, None), (500, "X y z", "", "", 0), (500, "X y z", "", "", 0), (500, "another text of six words", "", "", 0)]
    df = spark.createDataFrame(more, docs.schema)
    for tile in (1024, 3):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in parity_join.jaccard_components(df, tile=tile).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute_components(more)))
    one = parity_join.keep_one(df)
    assert one.columns == docs.columns
    assert one.count() == len({c for _, _, c in brute_components(more)}) + 1  # the two texts of id 500
    assert parity_join.jaccard_components(empty).collect() == []


@pytest.mark.parametrize("similarity", ["0.35", "0.9"])
def test_jaccard_components_at_any_similarity(docs, rows, similarity):
    clash = docs.withColumns({"node": F.lit(1), "key": F.lit("x"), "comp": F.lit(2)})
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.jaccard_components(clash, similarity=similarity).collect())
    assert got == sorted(brute_components(rows, Fraction(similarity)))


# ---------------------------------------------------------------- 7


def brute_removed(rows, width=13):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, math.inf), math.inf if d is None else d)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < (math.inf if d is None else d) for j in range(i, i + width)}
        out.append((d, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def test_suffix_automaton():
    rng = random.Random(11)
    for _ in range(200):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(0, 4))]
        a = substring_dedup.SuffixAutomaton()
        for t in texts:
            a.add(t)
        held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        q = [rng.choice("abcd") for _ in range(12)]
        want = [max((n for n in range(1, i + 2) if tuple(q[i + 1 - n : i + 1]) in held), default=0) for i in range(12)]
        assert a.statistics(q) == want


def test_substring_dedup(docs, rows, empty, spark):
    got = lambda df, **k: sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(df, **k).collect()), key=str)
    assert got(docs) == sorted(brute_removed(rows), key=str)
    assert got(docs, stream_words=5) == sorted(brute_removed(rows), key=str)
    rng = random.Random(12)
    mess = [(rng.choice([None, *range(25)]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))), None, None, 0) for _ in range(30)]
    mess += [(90 + i, " ".join(x if i & 1 << k else x.upper() for k, x in enumerate("pqrst")) + " common six word phrase stands here " + " ".join(f"{i % 4}{j}" for j in range(14)), None, None, 0) for i in range(24)]
    df = spark.createDataFrame(mess, docs.schema)
    assert got(df) == sorted(brute_removed(mess), key=str)
    assert got(df, width=6) == sorted(brute_removed(mess, 6), key=str)
    again = docs.unionByName(docs.where("doc_id % 4 < 2")).unionByName(docs.where("doc_id % 4 < 2")).withColumns({"anchor": F.lit(1), "doc": F.lit(2), "holder": F.lit(3)})
    assert got(again) == sorted([x for x in brute_removed(rows) for _ in range(3 if x[0] % 4 < 2 else 1)], key=str)
    out = substring_dedup.drop_repeats(docs.withColumn("spans", F.lit("own")))
    assert out.columns == [*docs.columns, "spans"] and out.where("spans <> 'own'").isEmpty()
    want = {d: (t if not n else k) for (d, t, *_), (_, _, n, k) in zip(rows, brute_removed(rows))}
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert substring_dedup.dedup_substrings(empty).collect() == []


# ---------------------------------------------------------------- 8


def brute_top(rows, k, mod):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q is None or q % mod:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), i is None, i) for i, b in ok if i is None or i != q), key=lambda t: (t[0], t[1], t[2] or 0))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return out


def test_exact_top_k(spark):
    rng = random.Random(13)
    vectors = [(i, [rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(9)]) for i in range(120)]
    vectors += [(200 + i, [0.5] * 9) for i in range(40)]  # ties
    vectors += [(None, [0.5] * 9), (300, None), (301, [None] * 9), (302, [float("nan")] * 9), (303, [float("inf")] + [0.0] * 8), (310, [0.5] * 4), (320, []), (3, [0.9] * 9)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, rank int").repartition(4)
    for block, lists in ((4096, 4), (5, 2), (4096, 1)):
        got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, query_block=block, lists=lists).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(brute_top(vectors, 5, 10))
    few = df.where("vec_id < 3")
    assert sorted((r.query_id, r["rank"]) for r in topk.exact_top_k(few, F.col("vec_id") == 0).collect()) == [(0, 1), (0, 2)]
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") == 0).collect() == []
    large = [(i, [x * 1e6 for x in v]) for i, v in vectors if v and i is not None and i < 60]
    got = topk.exact_top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(brute_top(large, 5, 10))
    huge = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 0.0]), (2, [1e30, 0.0]), (3, [-1e30, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    top = (1 << 63) - 1  # totals beyond 64 bits count as the nearest number
    assert [tuple(r) for r in topk.exact_top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, top), (0, 2, 2, top), (0, 3, 4, 65536 * 10**12), (0, 4, 3, -top)]


def test_top_k_phases_handle_few_entries(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.standard_normal(32).tolist()) for i in range(2000)], "vec_id long, embedding array<double>").repartition(4)
    n = topk.phase_counts(df, F.col("vec_id") % 50 == 0)
    assert n["all"] == 40 * 2000 * 2 and 40 * 5 <= n["gathered"] <= 40 * 5 * 2 * 4
    assert n["candidates"] <= n["collected"] < n["all"] // 10 and n["resolved"] < n["all"] // 10


# ---------------------------------------------------------------- 9


def brute_counts(text):
    w = [x.decode() for x in words(text)]
    lines = [x for x in (text or "").split("\n") if words(x)]
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat)


def test_quality_counts(docs, rows):
    got = {r.doc_id: tuple(r[c] for c in quality.COUNTS[:5]) for r in quality.counted(docs).collect()}
    assert got == {d: brute_counts(t) for d, t, *_ in rows}


def test_upper_bound_is_exact():
    for k, n, e in ((0, 10, 0.05), (3, 40, 0.01), (39, 40, 0.1), (500, 9000, 0.001)):
        p = quality.upper_bound(k, n, e)
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert tail == pytest.approx(e, rel=1e-6)
    assert quality.upper_bound(0, 0, 0.05) == quality.upper_bound(4, 4, 0.05) == 1.0
    assert quality.upper_bound(0, 10, 0.05) == pytest.approx(1 - 0.05 ** (1 / 10))


def test_cutoffs_keep_the_bound():
    good, bad = np.zeros(102, int), np.zeros(102, int)
    good[0], good[9], bad[8], bad[30] = 5000, 3, 40, 100
    cutoff = quality.certified_cutoff(good, bad, 0.01, 0.01)
    assert cutoff == 7
    assert quality.certified_cutoff(good, bad, 0.0001, 0.01) is None
    assert quality.certified_cutoff(good // 5000, bad, 0.01, 0.01) is None  # too few labels
    assert quality.certified_cutoff(good, bad * 0, 0.01, 0.01) is None  # nothing to catch


def test_quality_rules(spark):
    rng = random.Random(14)
    clean = lambda: " ".join(rng.choice(VOCABULARY[:-9]) + str(rng.randint(0, 999)) + "q" for _ in range(80))
    junk = lambda: " ".join("".join(rng.choice("abc") for _ in range(4)) + "***" + str(rng.randint(0, 99)) for _ in range(80))
    rows = [(i, junk() if i % 4 == 0 else clean(), "en" if i % 2 or i % 4 == 0 else None, 1) for i in range(3000)] + [(9000, None, "de", 1), (9001, "x " * 60, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 2900)] + [(1, 0, 0), (None, 1, 0), (5, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels, max_false_rejection=0.06).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept == (i % 4 != 0) and not got[i].base_failed for i in range(3000))
    assert got[9000].base_failed and got[9001].base_failed and not got[9000].kept
    stay = quality.keep_quality(docs, labels, max_false_rejection=0.06)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == [i for i in range(3000) if i % 4]
    none = quality.quality_rules(docs, labels.limit(0)).collect()
    assert sum(r.kept for r in none) == 3000
    assert quality.quality_rules(docs.limit(0), labels).collect() == []


def test_cutoffs_are_certified_together(spark):
    """The registered values certify from 217 good labels in each of four strata, and not from 216."""
    rows, marks = [], []
    for lang, good in (("a", 217), ("b", 217), ("c", 217), ("d", 216)):
        for i in range(good + 40):
            d, junk = len(rows), i >= good
            # half of the junk has digits, the other half capitals; good texts hold a few of both
            counts = dict.fromkeys(quality.COUNTS, 0) | {"n_words": 100, "word_chars": 1000, "n_digits": 400 if junk and i % 2 else i % 30, "n_upper": 500 if junk and not i % 2 else i % 50}
            rows.append((d, lang, *counts.values()))
            rows.append((100_000 + d, lang, *counts.values()))  # without a label
            marks.append((d, int(not junk)))
    features = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    cutoffs = quality.certified_cutoffs(features, labels, stratum="lang")
    got = {r._stratum: r for r in cutoffs.collect()}
    assert all(got["=d"][rule] is None for rule in quality.RULES)
    for lang in "abc":
        assert 2 <= got[f"={lang}"].digits < 40 and 4 <= got[f"={lang}"].capitals < 50
    kept = {r.doc_id for r in quality.judged(features, cutoffs, stratum="lang").where("kept AND lang <> 'd'").collect()}
    strata = {d: lang for d, lang, *_ in rows}
    assert kept & {d for d, _ in marks} == {d for d, good in marks if good and strata[d] != "d"}


def plain_cutoffs(rows, good, max_false, error):
    """A stratum's cutoffs, one step of one rule after the other: rows are (doc, values); good says what the labels say."""
    at, left, order = [100] * 6, 600, {}
    bad = [v for d, v in rows if good.get(d) == 0]
    others = [v for d, v in rows if d not in good]
    while left:
        best = None
        for r in range(6):
            for low in range(at[r], 0, -1):
                n = at[r] - low + 1
                ratio = sum(low <= v[r] <= at[r] for v in bad) / (sum(low <= v[r] <= at[r] for v in others) + n / 100)
                if best is None or ratio > best[0] + 1e-12:
                    best = (ratio, r, low)
        _, r, low = best
        for v in range(at[r], low - 1, -1):
            order[r, v] = left
            left -= 1
        at[r] = low - 1
    level = lambda v: max(order.get((r, x), 0) for r, x in enumerate(v))
    cases = {d: max(level(v) for e, v in rows if e == d) for d, _ in rows if d in good}
    n, m = sum(good[d] for d in cases), sum(1 - good[d] for d in cases)
    taken, gain = None, 0.0
    for cutoff in range(599, -1, -1):
        k = sum(good[d] and x > cutoff for d, x in cases.items())
        if k >= n or sum(math.comb(n, i) * max_false**i * (1 - max_false) ** (n - i) for i in range(k + 1)) > error:
            break
        g = sum(not good[d] and x > cutoff for d, x in cases.items()) / max(m, 1) - k / n
        if m and g > gain + 1e-12:
            taken, gain = cutoff, g
    return taken, lambda v: taken is not None and level(v) > taken


def test_kept_by_plain_cutoffs(spark):
    """The verdict on every row, by brute force; a labelled document's repeated rows are one case."""
    rng = random.Random(21)
    rows, marks = [], {}
    for d in range(900):
        lang, bad = rng.choice(["a", "b", "b", None]), rng.random() < 0.25
        counts = dict.fromkeys(quality.COUNTS, 0) | {"n_words": 100, "word_chars": 100, "n_lines": 100}
        for c, top in (("n_symbols", 12), ("n_digits", 30), ("n_upper", 20), ("n_dup_lines", 9)):
            counts[c] = rng.randint(0, top) + (rng.choice([0, 25]) if bad else 0)
        if rng.random() < 0.6:
            marks[d] = int(not bad) if rng.random() < 0.98 else int(bad)
        rows += [(d, lang, *counts.values())] * rng.choice([1, 1, 1, 6])
    features = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    cutoffs = quality.certified_cutoffs(features, labels, stratum="lang", max_false_rejection=0.1, error=0.3)
    got = sorted((r.doc_id, r.kept) for r in quality.judged(features, cutoffs, stratum="lang").collect())
    index = {c: i + 2 for i, c in enumerate(quality.COUNTS)}
    value = lambda r: [min(100, 100 * r[index[a]] // r[index[b]]) if r[index[b]] else 0 for a, b in quality.RULES.values()]
    want, certified = [], 0
    for lang in {r[1] for r in rows}:
        own = [(r[0], value(r)) for r in rows if r[1] == lang]
        taken, rejects = plain_cutoffs(own, marks, 0.1, 0.1)
        certified += taken is not None
        want += [(d, not rejects(v)) for d, v in own]
    assert got == sorted(want) and certified >= 2


def test_order_of_cutoffs():
    bad, others = np.zeros((6, 101), int), np.zeros((6, 101), int)
    bad[0, 30], others[0, 30], others[0, 3] = 10, 2, 500
    bad[1, 5], others[1, 5] = 10, 400
    order = quality.levels(bad, others)
    assert sorted(order[:, 1:].ravel()) == list(range(1, 601)) and not order[:, 0].any()
    assert (np.diff(order, axis=1) > 0).all() and order[0, 30] > order[1].max()


# ---------------------------------------------------------------- 10


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind", 9), (1, 1, "ann", "hi", 9), (1, 2, "bob", None, 9), (1, 2, "ann", "a<|im_end|>b", 9), (2, 0, "system", "s", 9), (3, None, None, "x", 9), (None, 5, "ann", "é", 9), (None, 5, "ann", "é", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask int")
    got = {(r.conv_id, r.perspective): r for r in chat.perspectives(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "ann")}
    r = got[1, "ann"]
    assert r.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>assistant\na<| im_end|>b<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    assert got[1, "bob"].text.count("user name=ann") == 2 and (got[1, "bob"].n_turns, got[1, "bob"].n_own) == (4, 1)
    for r in got.values():
        runs = [tuple(map(int, x.split(":"))) for x in r.mask.split(",")]
        assert sum(n for n, _ in runs) == len(r.text) == r.n_chars and sum(n for n, m in runs if m) == r.n_loss
        at, own = 0, []
        for n, m in runs:
            if m:
                own.append(r.text[at : at + n])
            at += n
        assert all(x.endswith("<|im_end|>") for x in own) and len(own) == r.n_own
    assert got[None, "ann"].n_turns == 2
    assert chat.perspectives(df.limit(0)).collect() == []
