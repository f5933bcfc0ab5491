"""The pipeline, stage by stage, against plain forms of its stages."""

import collections
import random

import corpus_pipeline
from collatio.llm import packing, quality
from tests_llm_plain import WORDS, naive_classes, naive_removed_words, weighted


def tables(spark, path):
    rnd = random.Random(12)
    v = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(500)]
    make = lambda n: [rnd.choice(v) for _ in range(n)]
    passage, base = make(60), make(150)
    items = [(i, " ".join(make(30))) for i in range(5)]
    docs = []
    for i in range(90):
        w = make(rnd.randrange(60, 140))
        if i % 6 == 0:
            w = w[:20] + passage + w[20:]
        if i % 15 == 4:
            w = w[:10] + items[i % 5][1].split() + w[10:]
        if i % 10 == 7:
            w = [x.upper() + "$$$" for x in w]
        docs.append((i, "\n".join([" ".join(w[:30]), " ".join(w[30:])])))
    for i in range(90, 100):
        w = list(base)
        w[i - 90] = "changed"
        docs.append((i, " ".join(w)))
    docs += [(100, docs[1][1]), (101, None), (102, ""), (103, "short text"), (104, " ".join(make(3000)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "e") for i, t in docs], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 7), 0) for i in range(0, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items


def test_stages(spark, tmp_path):
    docs, items = tables(spark, str(tmp_path))
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, state = df.columns, dict(docs)
    verdicts = {r.doc_id: r.s_kept for r in quality.judged(df, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k == 4:
            break
        assert out.columns == columns
        path = f"{tmp_path}/stage{k}.parquet"
        out.write.parquet(path)
        df = spark.read.parquet(path)
        got = {r.doc_id: r for r in df.collect()}
        if k == 0:
            state = {i: t for i, t in state.items() if verdicts[i]}
            assert {100, 0, 104} <= set(state) and not {101, 102, 103} & set(state) and sum(i % 10 == 7 for i in state if i < 90) <= 2
        elif k == 1:
            classes = naive_classes(state)
            state = {i: t for i, t in state.items() if classes[i] == i}
            assert 100 not in state and sum(i in state for i in range(90, 100)) == 1
        elif k == 2:
            gone = naive_removed_words(state)
            assert sum(map(len, gone.values())) >= 60 * 5
            state = {i: [w for j, w in enumerate(WORDS.findall(t)) if j not in gone[i]] for i, t in state.items()}
            assert {i: WORDS.findall(r.text) for i, r in got.items()} == state and all(r.n_chars == len(r.text) and r.extra == "e" for r in got.values())
            state = {i: r.text for i, r in got.items()}
        elif k == 3:
            hit = {i for i, t in state.items() for _, x in items if max((weighted((w := t.split())[s : s + 30], x.split()) for s in range(max(1, len(t.split()) - 29))), default=0) >= 0.8}
            assert len(hit) >= 4
            state = {i: t for i, t in state.items() if i not in hit}
        assert {i: r.text for i, r in got.items()} == state, name
    pieces = out.collect()
    enc = packing.encoder(packing.default_vocabulary())
    want = {i: len(enc.encode(t)) // 2 + 1 for i, t in state.items()}
    have = collections.Counter()
    for p in pieces:
        have[p.doc_id] += p.length
    assert have == want and sorted(p.sequence_id * 4096 + p.offset for p in pieces)[0] == 0


def test_run(spark, tmp_path):
    tables(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 30 and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "substring_dedup", "benchmark_decontamination", "packing"]
