import math
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from collatio import queries
from collatio.operators import matching, similarity

SCHEMA = "vec_id long, embedding array<float>, label string"


def plain(rows, k=5):
    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / size, 6) if size else 0.0

    out = set()
    for q, v, _ in rows:
        if q is not None and q % 50 == 0:
            near = sorted((-cosine(v or [], e or []), i) for i, e, _ in rows if i is not None and i != q)[:k]
            out |= {(q, i, -s or 0.0, n + 1) for n, (s, i) in enumerate(near)}
    return out


def vectors(seed=0, n=260):
    rnd = random.Random(seed)
    rows = [(i, [float(rnd.randrange(-3, 4)) for _ in range(3)], str(i % 7)) for i in range(n)]  # few values, so many ties
    return rows + [(n, None, "0"), (n + 1, [0.0] * 3, "1"), (None, [1.0, 2.0, 3.0], "2")]


@pytest.mark.parametrize("blocks", [(similarity.BLOCK_ROWS, similarity.BLOCK_QUERIES), (40, 2), (1000, 1)])
def test_nearest_of_all_rows(spark, blocks):
    rows = vectors()
    e = spark.createDataFrame(rows, SCHEMA)
    got = similarity.nearest(e.where("vec_id % 50 = 0"), e, 5, *blocks).collect()
    assert {(r.query_id, r.vec_id, r.sim, r["rank"]) for r in got} == plain(rows) and len(got) == 30


def test_nearest_of_few_rows_and_other_sizes(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [1.0], "a"), (2, [-1.0, 0.0], "b")], SCHEMA)
    got = [(r.query_id, r.vec_id, r.sim, r["rank"]) for r in similarity.nearest(e.where("vec_id = 0"), e, 5).orderBy("rank").collect()]
    assert got == [(0, 2, -1.0, 1), (0, 1, None, 2)]
    assert similarity.nearest(e.limit(0), e, 5).count() == 0


def test_vector_query_looks_at_all_labels(spark, tmp_path):
    rows = vectors(1)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.vector_cosine_topk(spark, str(tmp_path)).collect()
    assert {(r.query_id, r.vec_id, r.sim, r["rank"]) for r in got} == plain(rows)


def test_terms_are_those_of_python(spark):
    every = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{c}{c} a{c}b" for c in every[i : i + 5000]) for i in range(0, len(every), 5000)]
    texts += ["हिन्दी x½ cafe\u0301s", "", "a b cd", "x" * 50_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.regexp_extract_all("t", F.lit(similarity.TERM), F.lit(0)).alias("w")).collect()
    assert all(r.w == re.findall(r"\b\w\w+\b", texts[r.i]) for r in got) and len(got) == len(texts)


def test_both_paths_agree_beyond_ascii(spark, monkeypatch):
    o = "हिन्दी भाषा x½ cafe\u0301s\nje\u0301 suis cafe\u0301 ½½ deux\nthree words stay\nटेक्स्ट एक ¾x"
    m = "cafe\u0301 deux suis x½\nभाषा हिन्दी cafe\nthree words\nएक टेक्स्ट ¾x ¼y\ncafes je"
    pairs = spark.createDataFrame([(1, o, m)], "pair_id long, original string, modified string")
    seen = lambda df: sorted((r.pos, r.type, r.original, r.modified, r.similarity, r.confidence) for r in df.collect())
    key = lambda rows: [tuple(map(str, r)) for r in rows]
    small = seen(matching.semantic_matches(pairs))
    monkeypatch.setattr(matching, "LOCAL_CELLS", 0)
    assert key(seen(matching.semantic_matches(pairs))) == key(small) and any(r[4] and 0 < r[4] < 1 for r in small)
