"""The pipeline's stages, one after the other, against brute force on a small table."""

import collections
import hashlib

import corpus_pipeline
from latticore.llm import bpe_fst, common, mixing
from pyspark.sql import functions as F
from test_corpus import brute_components, brute_counts, brute_removed


def test_stages_against_brute_force(spark, sf, tmp_path):
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, docs, sf))
        before, after = docs.collect(), out.collect()
        if name == "quality rules":
            stay = [r for r in before if (c := brute_counts(r.text))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
            good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
            assert {r.doc_id for r in after} <= {r.doc_id for r in stay}
            assert {r.doc_id for r in stay} & good <= {r.doc_id for r in after}
        elif name == "n-gram Jaccard join":
            comps = brute_components([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in comps})
        elif name == "substring dedup":
            want = {d: (t if not n else k) for (d, t), (_, _, n, k) in zip([(r.doc_id, r.text) for r in before], brute_removed([(r.doc_id, r.text) for r in before]))}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        elif name == "mixing sources to target weights":
            size = {r.doc_id: len((r.text or "").encode().split()) for r in before}
            of = {r.doc_id: r.source for r in before}
            goal = {r.source: r.target for r in mixing.mix_sources(docs).collect()}
            times = collections.Counter(r.doc_id for r in after)
            assert max(times.values()) <= 3 and {r.text for r in after} <= {r.text for r in before}
            for source, words in goal.items():
                got = sum(size[d] * n for d, n in times.items() if of[d] == source)
                small = min((n for d, n in size.items() if of[d] == source and n), default=0)  # a size class reaches to twice its smallest
                assert abs(got - words) <= 0.01 * words + 1.5 * small + 8
        else:
            ranks, pattern = bpe_fst.public_vocabulary()
            library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            assert len(after) == len(before)
            text = {r.doc_id: r.text for r in before}
            for r in after:
                assert list(r.ids) == library.encode_ordinary(text[r.doc_id])
                assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        kept.append(len(after))
        docs = out
    assert kept[0] >= kept[1] == kept[2] > 0
    assert corpus_pipeline.run(spark, sf).count() == kept[-1]


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.limit(12)
    odd = odd.withColumn("doc_id", F.lit(None).cast("bigint")).unionByName(odd).unionByName(odd).unionByName(docs.limit(5).withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    mess = docs.unionByName(odd).withColumn("key", F.lit("own"))
    for table in (mess, mess.limit(0)):
        before = table
        for name, stage in corpus_pipeline.STAGES:
            after = common.cut(stage(spark, before, sf))
            n = after.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == before.columns and after.where("key <> 'own'").isEmpty()
            assert n > 0 if table is mess else n == 0
            before = after
