"""Each operator against a plain form of itself on small rows, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from collatio.llm import common, decontam, jaccard, langid, licenses, packing, quality, sharding, substrings, urls, warc
from collatio.llm.common import word_hashes
from collatio.llm.graph import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, shard string, rid string, n string"


def vocabulary(n=400, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(n)]


def corpus(seed=0):
    """(doc_id, text) with copies, near copies, shared passages, nulls, empty texts, repeated rows, null ids and one long text."""
    rnd, v = random.Random(seed), vocabulary()
    make = lambda n: [rnd.choice(v) for _ in range(n)]
    passage, base = make(60), make(120)
    rows = []
    for i in range(40):
        w = make(rnd.choice([3, 20, 60, 150]))
        if i % 5 == 0:
            w = w[:5] + passage + w[5:]
        rows.append((i, (" " if i % 3 else "\n").join(w)))
    for i in range(40, 55):
        w = list(base)
        for _ in range(i % 5):
            w[rnd.randrange(len(w))] = rnd.choice(v)
        rows.append((i, " ".join(w)))
    rows += [(60, rows[0][1]), (61, rows[0][1]), (62, rows[1][1] + " "), (63, "one two"), (64, "one two"), (65, "é ü\u00a0x"), (66, "é ü\u00a0x")]
    rows += [(70, None), (71, ""), (72, " \n\t"), (73, None), (74, " ".join(make(4000)))]
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, "no id here but text"), (None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 7 else None, len(t or ""), "k", "s", "r", "n") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def shingle_set(text):
    w = WORDS.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# ---- 1 ----


def naive_links(rows):
    sets = [shingle_set(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return collections.Counter((d, least.get(find(i)), links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block,blocks,hot", [(jaccard.BLOCK, jaccard.MOST_BLOCKS, common.HOT_ROWS), (4, 16, 3), (3, 1, 2)])
def test_links_and_classes(docs, rows, block, blocks, hot, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.linked(docs).collect())
    assert got == naive_links(rows)


def test_one_of_each(docs, rows, empty):
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert 60 not in ids and 61 not in ids and ids.count(0) == 1 and ids.count(3) == 1 and {70, 71, 72, 73} <= set(ids) and sum(40 <= (i or 0) < 55 for i in ids) < 15
    assert jaccard.one_of_each(empty).count() == 0 and jaccard.linked(empty).count() == 0


@pytest.mark.parametrize("hot", [common.HOT_ROWS, 3])
def test_components(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 530)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_pruning_keeps_near_sets():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, 120, dtype=np.uint64))
        b = a.copy()
        b[: rng.integers(0, 13)] += np.uint64(1)
        sets += [a, np.unique(b)]
    i, j = np.arange(0, 400, 2), np.arange(1, 400, 2)
    sig = jaccard.signatures(sets)
    near = set(jaccard.verified(sets, i, j))
    assert len(near) > 150 and near <= set(jaccard.pruned(sig, i, j))
    assert len(jaccard.pruned(sig, i[:-1], j[1:])) == 0
    big_i, big_j = np.triu_indices(400, 1)
    k = jaccard.verified(sets, big_i, big_j)
    assert set(zip(big_i[k].tolist(), big_j[k].tolist())) == {(2 * x, 2 * x + 1) for x in near}
    assert (jaccard.band_keys(sig)[i[sorted(near)]] == jaccard.band_keys(sig)[j[sorted(near)]]).any(1).all()


# ---- 2 ----


def test_pieces_against_the_tokenizer(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    ids = collections.defaultdict(list)
    for d, t in rows:
        ids[d].append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    pieces = packing.packed(docs, packing.default_vocabulary(), window=256).collect()
    stream = {}
    for p in pieces:
        assert len(p.ids) == p.length and p.offset + p.length <= 256 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        for k, x in enumerate(p.ids):
            assert stream.setdefault((p.sequence_id, p.offset + k), x) == x
    total = sum(len(x) for some in ids.values() for x in some)
    assert len(stream) == total == sum(p.length for p in pieces) and sorted(stream) == [divmod(i, 256) for i in range(total)]
    for d in (0, 40, 70, 74):
        own = sorted((p.start, p.ids) for p in pieces if p.doc_id == d)
        assert [x for _, part in own for x in part] == ids[d][0] and own[0][0] == 0
    assert packing.packed(empty, packing.default_vocabulary()).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    tok, own, rnd = Tokenizer.from_file(packing.default_vocabulary()), packing.WordEncoder(packing.default_vocabulary()), random.Random(5)
    texts = ["Don't WE'LL İstanbul ﬁ é <|endoftext|> a<|endoftext|>b 12½", "", " \n", "ÀÉß'S ªº µ ÿ x\x1cy z\x85w \x00", "日本語 🙂🙂"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 256), rnd.randrange(1, 0x500), rnd.randrange(32, 127)])) for _ in range(60)) for _ in range(500)]
    assert all(np.frombuffer(own.encode(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids for t in texts)


# ---- 3 ----


def test_shards(docs, rows, empty):
    got = sharding.shard_rows(docs, 7, bits=3).toPandas()
    assert len(got) == len(rows) and list(got.columns) == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    count = got.groupby("shard").slot.count()
    assert count.max() - count.min() <= 1 and all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    mix = got.fillna({"source": "?"}).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mix.max(axis=1) - mix.min(axis=1)).max() <= 2
    assert sharding.shard_rows(empty, 7).count() == 0
    again = sharding.shard_rows(docs, 7, bits=3).toPandas()
    key = lambda df: sorted(map(str, df[["doc_id", "text", "shard", "slot"]].values.tolist()))
    assert key(got.drop_duplicates(["doc_id", "text"], keep=False)) == key(again.drop_duplicates(["doc_id", "text"], keep=False))


# ---- 4 ----


def test_forward_backward_by_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    length, k = np.array([4, 3, 1]), 3
    e, t = rng.random((8, k)) + 0.1, rng.random((k, k)) + 0.1
    pairs = np.zeros((k, k))
    got, at, want_pairs = langid.forward_backward(e, length, t, pairs), 0, np.zeros((k, k))
    for n in length:
        p, q, z = np.zeros((n, k)), np.zeros((k, k)), 0
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.prod([e[at + i, s] for i, s in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:])])
            z += w
            for i, s in enumerate(path):
                p[i, s] += w
            for a, b in zip(path, path[1:]):
                q[a, b] += w
        assert np.allclose(got[at : at + n], p / z)
        want_pairs += q / z
        at += n
    assert np.allclose(pairs, want_pairs)


def test_languages(spark):
    rnd = random.Random(4)
    stems = {"en": ["the", "thing", "with", "shall"], "de": ["nicht", "schaft", "über", "ung"], "es": ["ción", "para", "los", "que"]}
    rows = [(i, " ".join(rnd.choice(stems[x]) + rnd.choice(["", rnd.choice(stems[x])]) for _ in range(rnd.randrange(3, 40))), x) for i in range(240) for x in [rnd.choice(list(stems))]]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (None, "the thing with the thing", None), (1002, "the thing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = langid.fitted(docs, sample=40)
    got = {r.doc_id: r for r in langid.identified(docs, field).collect()}
    held = [i for i, _, _ in rows[:240] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i, _, _ in rows[:240])
    assert np.mean([got[i].lang_pred == x for i, _, x in rows[:240] if i in held]) > 0.95
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[None].held_out is False and all(0 <= r.score <= 1 for r in got.values())
    tags = langid.tagged(field, "the thing with thing nicht über schaftung los para que")
    assert [t for _, t, _ in tags][:3] == ["en"] * 3 and [t for _, t, _ in tags][-2:] == ["es"] * 2
    assert langid.identified(docs, langid.fitted(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_gradient_by_differences():
    """Of the log-likelihood by enumeration of all labellings, for every weight and transition."""
    import itertools

    rng = np.random.default_rng(3)
    k, types, features, lengths = 2, 4, 3, np.array([3, 2])
    row, column = np.array([0, 0, 1, 2, 3, 3]), np.array([0, 1, 1, 2, 0, 2])
    flat, truth = rng.integers(0, types, 5), rng.integers(0, k, 5)
    wanted, gold = np.zeros((types, k)), np.zeros((k, k))
    np.add.at(wanted, (flat, truth), 1.0)
    for a, b in ((0, 1), (1, 2), (3, 4)):
        gold[truth[a], truth[b]] += 1

    def value(w, t):
        score = np.array([[sum(w[c, s] for r, c in zip(row, column) if r == x) for s in range(k)] for x in flat])
        total, at = -0.05 * ((w**2).sum() + (t**2).sum()), 0
        for n in lengths:
            path_score = lambda p: sum(score[at + i, x] for i, x in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            total += path_score(truth[at : at + n]) - np.log(sum(np.exp(path_score(p)) for p in itertools.product(range(k), repeat=int(n))))
            at += n
        return total

    w, t = rng.normal(size=(features, k)), rng.normal(size=(k, k))
    got = langid.gradient(w, t, flat, lengths, row, column, wanted, gold, decay=0.1)
    for x, g in ((w, got[0]), (t, got[1])):
        for i in np.ndindex(x.shape):
            old = x[i]
            x[i] = old + 1e-5
            up = value(w, t)
            x[i] = old - 1e-5
            down = value(w, t)
            x[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-5


def test_languages_of_odd_tables(spark, empty):
    docs = spark.createDataFrame([(i, "the thing with shall" if i % 2 else "nicht über ung", "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    field = langid.fitted(docs)
    rows = [(1, "the thing " * 60_000, "x"), (2, "nicht über", "x"), (2, "nicht über", "x"), (None, "shall", None)]
    odd = spark.createDataFrame([(*r, "p", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = collections.Counter((r.doc_id, r.lang_pred) for r in langid.identified(odd, field).collect())
    assert got == collections.Counter([(1, "en"), (2, "de"), (2, "de"), (None, "en")])
    assert langid.identified(empty, field).count() == 0
    long = langid.drawn("word " * 100_000)
    assert len(long.split()) == langid.RUNS * langid.SEQUENCE // 2 and langid.drawn("a b 1 c") == "a b c"
    words = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}x{'y' * (i // 600)}" for i in range(6000)]
    taken = langid.drawn(" ".join(words)).split()
    assert len(taken) == langid.RUNS * 32 and [words.index(w) for w in taken[::32]] == sorted(words.index(w) for w in taken[::32]) and max(words.index(w) for w in taken) > 4500


# ---- 5 ----


def test_urls(spark):
    cases = {
        "https://Sub.EXAMPLE.com/en/7/x?q=1": ("sub.example.com", "/en/7/x", "example.com/en/7", "allow"), "http://a.com/en/1": ("a.com", "/en/1", "com/en/", "block"), "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://xcom/en/1": ("xcom", "/en/1", None, None), "ftp://example.net/de/81#z": ("example.net", "/de/81", "example.net/de/8", "block"), "x://b.net/de/": ("b.net", "/de/", "net/de/", "allow"), "no scheme": ("", "", None, None),
        None: ("", "", None, None), "http://h?x://y": ("h", "", None, None), "http://org/es/#/": ("org", "/es/", "org/es/", "block"), "http://É.com/en": ("É.com", "/en", None, None),
    }
    df = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(cases)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in urls.judged_urls(df).collect()}
    for i, want in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == want[:3] and (want[3] is None or r.verdict == want[3]) and r.verdict in ("allow", "block")
    assert urls.judged_urls(df.limit(0)).count() == 0


def test_trees_as_expression(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = urls.BoostedTrees(x, y)
    assert ((trees.margin(x) > 0) == y).mean() > 0.95
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    assert np.allclose([r.m for r in df.select(trees.expression([F.col("a"), F.col("b")]).alias("m")).collect()], trees.margin(x))


def test_labelled_urls_are_learned(spark):
    rows = [(i, f"http://{'spam' * (i % 2)}site{i}.info/{'9' * (12 * (i % 2))}p", "block" if i % 2 else "allow") for i in range(200)]
    labelled = spark.createDataFrame([(u, v) for _, u, v in rows[:150]], "url string, verdict string")
    got = urls.judged_urls(spark.createDataFrame([(i, u) for i, u, _ in rows[150:]], "page_id long, url string"), labelled=labelled).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got)


def test_rules_joined_as_in_one_expression(spark, monkeypatch):
    rnd = random.Random(15)
    hosts = ["com", "a.com", "b.a.com", "net", "", "x.net", "é.org", "com."]
    rules = [(h + "/" * (i % 2) + "".join(rnd.choice("ab/") for _ in range(rnd.randrange(4))), rnd.choice(["allow", "block"])) for i, h in enumerate(rnd.choices(hosts, k=60))]
    rules = list(dict(sorted(rules, reverse=True)).items())
    rows = [(i, f"http://{rnd.choice(['', 'w.', 'a.', '.'])}{rnd.choice(hosts)}/{''.join(rnd.choice('ab/') for _ in range(rnd.randrange(6)))}") for i in range(400)]
    rows += [(1, None), (2, "none"), (3, "http://a.com/ab"), (3, "http://a.com/ab"), (4, "http://a.com/" + "ab" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("says", F.lit("y"))
    seen = lambda d: collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule is not None else None) for r in d.collect())
    want = seen(urls.judged_urls(df, rules))
    assert sum(k[3] is not None for k in want) > 50
    monkeypatch.setattr(urls, "MOST_RULES", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert seen(urls.judged_urls(df, rules)) == want
    assert seen(urls.judged_urls(df, spark.createDataFrame(rules, "rule string, verdict string"))) == want


def test_tree_growing_by_trying_every_cut():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 5, (40, 3)).astype(float), rng.integers(0, 2, 40).astype(float)
    trees = urls.BoostedTrees(x, y, trees=1, depth=1)
    p = np.full(40, y.mean())
    grad, hess = y - p, p * (1 - p)
    score = lambda some: grad[some].sum() ** 2 / (hess[some].sum() + 1)
    gains = {(f, c): score(x[:, f] < c) + score(x[:, f] >= c) for f in range(3) for c in (0.5, 1.5, 2.5, 3.5)}
    f, cut, left, right = trees.trees[0]
    assert gains[f, cut] == pytest.approx(max(gains.values()))
    assert (left, right) == (pytest.approx(grad[x[:, f] < cut].sum() / (hess[x[:, f] < cut].sum() + 1)), pytest.approx(grad[x[:, f] >= cut].sum() / (hess[x[:, f] >= cut].sum() + 1)))


def test_held_out_urls_of_other_labels(spark):
    """Labels that no rule gives: long, numeric, hyphenated urls under few suffixes are bad, with a tenth of the labels wrong; learned from half."""
    rnd = random.Random(16)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9)))
    rows = []
    for i in range(1200):
        bad = i % 2
        host = f"{'-'.join(word() for _ in range(1 + 2 * bad))}{rnd.randrange(10**5) if bad else ''}.{rnd.choice(['xyz', 'info', 'com'] if bad else ['org', 'edu', 'com'])}"
        path = "/".join(word() for _ in range(rnd.randrange(1, 4))) + (f"?{word()}={rnd.randrange(10**9)}&{word()}={rnd.randrange(10**9)}" if bad and rnd.random() < 0.7 else "")
        rows.append((i, f"http://{host}/{path}", "block" if bad != (rnd.random() < 0.1) else "allow", bad))
    labelled = spark.createDataFrame([(u, v) for i, u, v, _ in rows if i < 600], "url string, verdict string")
    got = {r.page_id: r.verdict for r in urls.judged_urls(spark.createDataFrame([(i, u) for i, u, _, _ in rows if i >= 600], "page_id long, url string"), rules=(), labelled=labelled).collect()}
    assert np.mean([(got[i] == "block") == bool(bad) for i, _, _, bad in rows if i >= 600]) > 0.95


def test_urls_with_one_verdict_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/x"), (1, "http://a.com/en/x"), (None, "http://b.com/en/" + "z" * 200_000)], "page_id long, url string")
    got = urls.judged_urls(df).collect()
    assert len(got) == 3 and all(r.verdict == "block" and r.rule == "com/en/" for r in got)
    one = spark.createDataFrame([("http://x/", "block")], "url string, verdict string")
    assert [r.verdict for r in urls.judged_urls(spark.createDataFrame([(1, "http://q/")], "page_id long, url string"), labelled=one).collect()] == ["allow"]


# ---- 6 ----


def plain_records(data):
    """(header fields, block) of each record of a WARC file, read byte by byte as the format says."""
    out = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        assert first == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines)
        assert len(fields) == len(lines) and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI"} <= set(fields) and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
        size = int(fields["Content-Length"])
        out.append((fields, data[:size]))
        assert data[size : size + 4] == b"\r\n\r\n"
        data = data[size + 4 :]
    return out


def test_archive_round_trip(spark, tmp_path):
    big, small = "x" * 999 + "é", "tiny"
    rows = [(1, "http://a/", big), (5, "http://b\r\n/", big), (3, None, big), (2, "u", small), (4, "u", small), (6, "u", None), (None, "u", big), (5, "http://b/", big), (None, "v", "y" * 1000), (9, "long", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "z", "q") for r in rows], "page_id long, url string, html string, sha256 string, payload string")
    warc.write_archive(df, str(tmp_path / "a"), date="2020-01-02T03:04:05Z")
    out = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert len(out) == len(rows) and spark.read.parquet(str(tmp_path / "a/payloads")).count() == 5
    for r in out:
        raw = bytes(r.payload)
        assert r.payload_digest == hashlib.sha1(raw).hexdigest() and r.payload_bytes == len(raw) and bytes(r.record) == bytes(r.header) + (raw if r.record_type == "response" else b"") + b"\r\n\r\n"
        want = ("revisit", 5) if raw == big.encode() and r.page_id != 5 else ("response", None)
        assert (r.record_type, r.refers_to) == want
    records = plain_records(b"".join(bytes(r.record) for r in out))
    ids = {h["WARC-Record-ID"]: (h, body) for h, body in records}
    assert len(records) == len(ids) == len(rows)
    for h, body in records:
        assert h["WARC-Date"] == "2020-01-02T03:04:05Z" and h["Content-Type"] == "application/http; msgtype=response" and re.fullmatch(r"[!-~\u00a0-\uffff]+", h["WARC-Target-URI"])
        top, _, payload = body.partition(b"\r\n\r\n")
        assert top.startswith(b"HTTP/1.1 200 OK\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", top)[1])
        if h["WARC-Type"] == "revisit":
            of, source = ids[h["WARC-Refers-To"]]
            assert payload == b"" and h["WARC-Profile"].endswith("identical-payload-digest") and of["WARC-Type"] == "response" and (of["WARC-Target-URI"], of["Page-ID"]) == (h["WARC-Refers-To-Target-URI"], "5")
            payload = source.partition(b"\r\n\r\n")[2]
        assert len(payload) == size and h["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
    warc.write_archive(df.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 0


# ---- 7 ----


def test_rule_counts(rows):
    texts = [t for _, t in rows] + ["a b c a b c", "x x x x", "l\nl\n l\n\n\nl", "#*$%&|<> a|b", "a b c d a b c"]
    for t in texts:
        w = WORDS.findall(t or "")
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)]
        assert quality.rule_stats(t)[0] == want


def test_forest_parts_bad_from_good(spark, empty):
    rnd, v = random.Random(6), vocabulary()
    good = [(i, " ".join(rnd.choice(v) for _ in range(rnd.randrange(60, 200)))) for i in range(150)]
    bad = [(i + 1000, " ".join(rnd.choice(v).upper() + rnd.choice(["!!", "$$$", "###"]) for _ in range(100))) for i in range(40)]
    docs = frame(spark, good + bad + [(2000, None), (2001, "few words")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:100]] + [(i, 0, 0) for i, _ in bad[:20]] + [(None, 1, 0), (2000, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged(docs, labels, ("lang", "text")).collect()}
    assert np.mean([got[i].s_kept for i, _ in good]) > 0.97 and np.mean([got[i].s_kept for i, _ in bad]) < 0.2
    assert got[2000].s_base_failed and got[2001].s_base_failed and not got[2000].s_kept and got[0].k_0 == "en" and got[0].k_1 == good[0][1]
    assert quality.judged(docs, labels.limit(0)).where("s_kept <> (NOT s_base_failed)").count() == 0
    assert quality.judged(empty, labels).count() == 0


def test_forest_by_a_plain_form(spark):
    """Path lengths by walking each tree, scores by the formula, the threshold by trying every value."""
    rng = np.random.default_rng(7)
    good, bad = rng.normal(size=(120, 3)), rng.normal(size=(60, 3)) + [3, 0, 0]
    forest = quality.IsolationForest(good, (np.minimum(good.min(0), bad.min(0)), np.maximum(good.max(0), bad.max(0))), trees=20, points=64)

    def mean_path(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def walk(node, x):
        while forest.left[node] >= 0:
            node = forest.left[node] if x[forest.feature[node]] < forest.cut[node] else forest.right[node]
        return forest.depth[node]

    for x in (*good[:10], *bad[:10]):
        assert forest.score(x[None])[0] == pytest.approx(2 ** -(np.mean([walk(r, x) for r in forest.roots]) / mean_path(64)))
    depths = [forest.depth[i] for i in range(len(forest.left)) if forest.left[i] < 0]
    assert all(any(abs(d - k - mean_path(n)) < 1e-9 for k in range(13) for n in range(65)) for d in depths)

    v = vocabulary()
    rnd = random.Random(17)
    texts = [(i, " ".join(rnd.choice(v) for _ in range(80))) for i in range(90)] + [(i, " ".join(rnd.choice(v) + rnd.choice(["!!", "", "$"]) for _ in range(80))) for i in range(100, 140)]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    grown, threshold = quality.fitted(frame(spark, texts), labels, loss=0.05)
    score = {i: grown.score(np.array([quality.rule_stats(t)[1]]))[0] for i, t in texts}
    g, b = [s for i, s in score.items() if i < 100], [s for i, s in score.items() if i >= 100]
    lost = lambda t: np.mean([s > t for s in g])
    worth = {t: np.mean([s > t for s in b]) - lost(t) for t in {*g, *b} if lost(t) <= 0.05}
    assert lost(threshold) <= 0.05 and np.mean([s > threshold for s in b]) - lost(threshold) == pytest.approx(max(worth.values()))


def test_forest_and_threshold_of_all_labelled_rows(spark):
    """With more labelled rows than ever were sampled: every good row is in a leaf of each tree, paths by walking down the counts, the threshold by trying every value on all rows."""
    rnd = random.Random(23)
    texts = [(i, " ".join(rnd.choice(["word", "other", "A", "No!", "7"]) for _ in range(rnd.randrange(3, 9)))) for i in range(3600)] + [(i, " ".join(rnd.choice(["WORD!!", "$", "x"]) for _ in range(6))) for i in range(3600, 6800)]
    labels = spark.createDataFrame([(i, int(i < 3600), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    forest, threshold = quality.fitted(frame(spark, texts), labels)
    x = np.array([quality.rule_stats(t)[1] for _, t in texts])
    good, bad = x[:3600], x[3600:]
    assert forest.points == 3600
    first = 2**forest.levels - 1

    def walk(row, k):
        node, path = 0, [0]
        while node < first:
            node = 2 * node + 1 + (row[forest.feature[k][node]] >= forest.cut[k][node])
            path.append(node)
        return path

    for k in range(0, 100, 33):
        reached = collections.Counter(n for row in good for n in walk(row, k))
        for row in (*good[:15], *bad[:15]):
            path = walk(row, k)
            end = next((d for d, n in enumerate(path) if reached[n] < 2), None)
            want = end if end is not None else forest.levels + quality.IsolationForest.mean_path(reached[path[-1]])
            assert forest.path[k][path[-1] - first] == pytest.approx(want)
    g, b = forest.score(good), forest.score(bad)
    worth = {t: np.mean(b > t) - np.mean(g > t) for t in {*g, *b} if np.mean(g > t) <= quality.LOSS}
    assert np.mean(g > threshold) <= quality.LOSS and worth[threshold] == pytest.approx(max(worth.values()))
    assert np.mean(b > threshold) > 0.9


# ---- 8 ----


def weighted(a, b):
    a, b = (collections.Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a, b))
    return sum(min(a[s], b[s]) * len(s) for s in a) / max(1, sum(max(a[s], b[s]) * len(s) for s in a | b))


def test_contamination(spark, empty):
    rnd, v = random.Random(7), vocabulary()
    items = [(i, " ".join(rnd.choice(v) for _ in range(rnd.choice([2, 14, 30, 45])))) for i in range(14)] + [(90, None), (91, ""), (5, None)]
    rows = []
    for i in range(80):
        w = [rnd.choice(v) for _ in range(rnd.randrange(60))]
        if i % 3 == 0:
            own = items[i % 14][1].split()
            for _ in range(i % 4):
                own[rnd.randrange(len(own))] = rnd.choice(v)
            w = w[: len(w) // 2] + own + w[len(w) // 2 :]
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, items[1][1].upper()), (103, items[1][1]), (103, items[1][1]), (None, items[1][1])]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, sh string, n int")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    for d, t in rows:
        w = (t or "").lower().split()
        for i, x in items:
            q = (x or "").lower().split()
            if not q:
                continue
            best = max((weighted(w[s : s + len(q)], q) for s in range(max(1, len(w) - len(q) + 1))), default=0) if w else 0
            assert ((d, i) in got) == (best >= 0.8), (d, i, best)
            if (d, i) in got:
                assert got[d, i].similarity == pytest.approx(best)
    kept = decontam.without_benchmark(frame(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got} and kept.columns == empty.columns
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_best_window_between_seeded_starts(spark):
    """Texts whose best window is at the threshold though no window at a shared shingle's own place is."""
    rnd, rows, items = random.Random(4), [], []
    while len(rows) < 4:
        q = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(1, 19))) for _ in range(rnd.randrange(30, 61))]
        new = lambda n: ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(1, 19))) for _ in range(n)]
        at, n = rnd.randrange(5, len(q) - 5), rnd.randrange(2, 5)
        w = new(20) + (q[:at] + new(n) + q[at:] if rnd.random() < 0.5 else q[:at] + q[at + n :]) + new(20)
        best = {s: weighted(w[s : s + len(q)], q) for s in range(len(w) - len(q) + 1)}
        at_item = {tuple(q[j : j + 5]): j for j in range(len(q) - 4)}
        seeded = {p - at_item[tuple(w[p : p + 5])] for p in range(len(w) - 4) if tuple(w[p : p + 5]) in at_item}
        if max(best.values()) >= 0.8 > max(best[min(max(s, 0), len(w) - len(q))] for s in seeded):
            rows.append((len(rows), " ".join(w)))
            items.append((len(items), " ".join(q)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(i, i) for i in range(4)}


def test_reordered_items_are_found(spark):
    """Items with their halves or sentences swapped inside a longer text: no run keeps its own place, the best window is found all the same."""
    rnd, v = random.Random(8), vocabulary()
    make = lambda n: [rnd.choice(v) for _ in range(n)]
    items = [make(60) for _ in range(12)]
    rows = []
    for i, q in enumerate(items):
        at = 20 + i
        rows.append((i, " ".join(make(15) + q[at:] + q[:at] + make(25))))
        rows.append((100 + i, " ".join(make(15) + q[40:] + q[20:40] + q[:20] + make(25))))
    bench = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    for d, t in rows:
        w = t.split()
        for i, q in enumerate(items):
            sims = [weighted(w[s : s + 60], q) for s in range(len(w) - 59)]
            assert ((d, i) in got) == (max(sims) >= 0.8)
            if (d, i) in got:
                assert (got[d, i].similarity, got[d, i].start_word) == (pytest.approx(max(sims)), sims.index(max(sims)))
    assert sum(d < 100 for d, _ in got) >= 10


def test_recall_near_the_threshold(spark):
    """Texts whose best window lies between 0.8 and 0.85: the fingerprints' radius loses none of some hundred."""
    rnd, v = random.Random(10), vocabulary()
    items, rows, want = [], [], 0
    while want < 150:
        q = [rnd.choice(v) for _ in range(rnd.randrange(20, 60))]
        w = list(q)
        for _ in range(rnd.randrange(1, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(v)
        if 0.8 <= weighted(w, q) < 0.85:
            rows.append((want, " ".join(w)))
            items.append((want, " ".join(q)))
            want += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, rows), bench).collect()} >= {(i, i) for i in range(want)}


def test_fingerprint_is_the_weighted_simhash(spark):
    rnd, v = random.Random(11), vocabulary()
    rows = {i: [" ".join(rnd.choice(v) for _ in range(3)) for _ in range(rnd.randrange(1, 30))] for i in range(20)}
    rows[20] = ["x" * 70_000, "y" * 69_999, "z"]
    df = spark.createDataFrame(list(rows.items()), "i int, sh array<string>").withColumn("total", F.expr(decontam.characters("sh")))
    hashes = {r.i: r.h for r in df.select("i", F.expr("transform(sh, s -> xxhash64(s))").alias("h")).collect()}
    got = decontam.fingerprinted(df, "sh", "total").select("i", "print", F.size(F.array_distinct(decontam.blocks("print"))).alias("n")).collect()
    assert len(got) == len(rows)
    for r in got:
        sums = [sum(len(s) if h >> b & 1 else -len(s) for s, h in zip(rows[r.i], hashes[r.i])) for b in range(64)]
        assert r.print & (1 << 64) - 1 == sum(1 << b for b in range(64) if sums[b] > 0) and r.n == decontam.RADIUS + 1


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WINDOWS, 0])
def test_decontamination_with_and_without_broadcasts(spark, monkeypatch, limit):
    """Very long texts, ids that repeat, clashing columns, and both join plans."""
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", limit)
    rnd, v = random.Random(12), vocabulary()
    make = lambda n: [rnd.choice(v) for _ in range(n)]
    item = make(40)
    rows = [(1, " ".join(make(30_000) + item + make(30_000)), 7), (2, "la " * 5000, 7), (2, " ".join(make(50)), 7), (None, None, 7), (3, " ".join(item[:39]), 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int").withColumn("start", F.lit("s")).withColumn("item", F.lit(1))
    bench = spark.createDataFrame([(5, " ".join(item)), (6, "la " * 30)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word) for r in decontam.contaminated(df, bench).collect()}
    assert got == {(1, 5, 30_000), (2, 6, 0), (3, 5, 0)}
    kept = decontam.without_benchmark(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.rid, r.start, r.item) for r in kept.collect()) == [(0, 7, "s", 1), (2, 7, "s", 1)]


# ---- 9 ----

MIT_FILE = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2_FILE = """Copyright 2020 Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY.
"""
BSD3_FILE = "BSD 3-Clause License\n\nCopyright (c) 2019, A B\n" + BSD2_FILE.partition("\n")[2] + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""" + BSD_END
APACHE_HEADER = """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

import os
"""
APACHE_FILE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

   END OF TERMS AND CONDITIONS

   Copyright [yyyy] [name of copyright owner]

""" + APACHE_HEADER.replace("# ", "   ").replace("#", "")
GPL3_NOTICE = """/*
 * Copyright (C) 2020  Someone
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */"""
GPL2_NOTICE = GPL3_NOTICE.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
GPL3_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

    <one line to give the program's name and a brief idea of what it does.>
""" + GPL3_NOTICE.replace("/*\n", "").replace(" */", "").replace(" *", "   ")
LGPL_NOTICE = """ ; This library is free software; you can redistribute it and/or
 ; modify it under the terms of the GNU Lesser General Public
 ; License as published by the Free Software Foundation; either
 ; version 2.1 of the License, or (at your option) any later version."""
AGPL_NOTICE = GPL3_NOTICE.replace("GNU General", "GNU Affero General")
MPL_NOTICE = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC_NOTICE = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS."""
ZERO_NOTICE = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted."
ZLIB_NOTICE = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software."""
EPL_NOTICE = "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"
NOTICES = [
    (MIT_FILE, "MIT"), (MIT_FILE.replace("\n", "\r\n"), "MIT"), (MIT_FILE.replace("\n", "\r"), "MIT"), (" ".join(MIT_FILE.partition("Someone")[2].split()), "MIT"), (BSD2_FILE, "BSD-2-Clause"), (BSD2_FILE + BSD_END, "BSD-2-Clause"), (BSD3_FILE, "BSD-3-Clause"),
    (APACHE_HEADER, "Apache-2.0"), (APACHE_FILE, "Apache-2.0"), (GPL3_NOTICE, "GPL-3.0-or-later"), (GPL3_NOTICE.replace("\n *", ""), "GPL-3.0-or-later"), (GPL2_NOTICE, "GPL-2.0-or-later"), (GPL3_FILE, "GPL-3.0-only"), (LGPL_NOTICE, "LGPL-2.1-or-later"),
    (AGPL_NOTICE, "AGPL-3.0-or-later"), (MPL_NOTICE, "MPL-2.0"), (ISC_NOTICE, "ISC"), (ZERO_NOTICE, "0BSD"), (ZLIB_NOTICE, "Zlib"), (EPL_NOTICE, "EPL-2.0"), ("Released under\nthe MIT License.", "MIT"), ("Released under\n\nthe Zlib License.", ""),
    ("Text.\nReleased under the MIT License.\nAll rights reserved.", "MIT,Proprietary"), ("Some heading\nAll rights reserved\nmore", "Proprietary"), ("We say all rights reserved.\nNot all rights\nreserved here", ""), ("Copyright 2020 X; all\rrights reserved", "Proprietary"),
    ("# SPDX-License-Identifier: Apache-2.0\nx = 1", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("The code is available under the terms of the\nMozilla Public License 2.0.", "MPL-2.0"), ("All rights reserved", "Proprietary"), (None, ""), ("", ""), ("plain software text under no terms", ""), ("All \u212aights reserved. Rights", ""), ("word " * 30_000 + ". All rights reserved.", "Proprietary"),
]


def test_licence_files_and_notices(spark, empty):
    rows = [(i, t) for i, (t, _) in enumerate(NOTICES)] + [(0, MIT_FILE), (None, ISC_NOTICE)]
    got = collections.Counter((r.doc_id, r.licenses, r.n_licenses) for r in licenses.scanned(frame(spark, rows).withColumn("licenses", F.lit("x")).withColumn("__text", F.lit("y"))).collect())
    assert got == collections.Counter([(i, want, len([x for x in want.split(",") if x])) for i, (_, want) in enumerate(NOTICES)] + [(0, "MIT", 1), (None, "ISC", 1)])
    assert licenses.scanned(empty).count() == 0 and licenses.scanned(empty).columns == ["doc_id", "sentence_ids", "licenses", "n_licenses"]


def test_licence_sql_by_other_means():
    documents = pd.DataFrame({"doc_id": range(len(NOTICES)), "text": [t for t, _ in NOTICES]})  # noqa: F841
    got = {r[0]: r[1:] for r in duckdb.sql(licenses.SCANNED_SQL).fetchall()}
    for i, (t, want) in enumerate(NOTICES):
        ids = "".join(f"<{x}>" for x in licenses.sentence_ids(t or ""))
        assert got[i] == (ids, want, len([x for x in want.split(",") if x])), t


def test_every_identifier_has_a_rule_and_every_sentence_an_anchor():
    used = set(re.findall("<([^>]+)>", " ".join(p for _, p in licenses.PATTERNS).replace("[.]", ".")))
    assert used == set(licenses.KNOWN.values()) | set(licenses.NAMED.values()) | {"copyright"}
    assert all(re.search(licenses.ANCHORS, s) for s in licenses.KNOWN)


# ---- 10 ----


def naive_removed(rows):
    words = [WORDS.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = collections.Counter()
    for (d, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("split,shard,hot", [(substrings.SPLIT_CONTEXTS, substrings.SHARD_WORDS, common.HOT_ROWS), (1, 300, 3)])
def test_repeated_passages_go(spark, docs, rows, empty, split, shard, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    for name, value in (("SPLIT_CONTEXTS", split), ("SHARD_WORDS", shard), ("BROADCAST_KEYS", 0 if split == 1 else substrings.BROADCAST_KEYS)):
        monkeypatch.setattr(substrings, name, value)
    loop = [(200, "la " * 80), (201, "a b c " * 30)]
    more = frame(spark, rows + loop)
    got = substrings.deduplicated(more, ("lang",), texts=True).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == naive_removed(rows + loop)
    for r in got:
        if r.kept is not None:
            assert hashlib.sha256(" ".join(WORDS.findall(r.kept)).encode()).hexdigest() == r.kept_sha256 and r.k_0 == "en"
    assert substrings.deduplicated(empty).count() == 0


def test_automaton_statistics():
    rnd = random.Random(9)
    for _ in range(50):
        seqs = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 12))] for _ in range(4)]
        auto = substrings.SuffixAutomaton()
        for s in seqs:
            auto.add(s)
        auto.finish()
        times = collections.Counter(tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        for least in (1, 2, 3):
            for s in seqs:
                want = [max([n for n in range(e + 2) if n == 0 or times[tuple(s[e + 1 - n : e + 1])] >= least]) for e in range(len(s))]
                assert list(auto.statistics(s, least)) == want


def test_finer_anchors_agree_on_equal_windows():
    rnd = random.Random(14)
    v = vocabulary(30)
    passage = [rnd.choice(v) for _ in range(70)]
    texts = [[rnd.choice(v) for _ in range(rnd.randrange(5, 40))] + passage[k : k + 50] + [rnd.choice(v)] for k in (0, 9, 20)] + [["x", "y", "z"] * 20, ["la"] * 90]
    for level in range(len(substrings.FINER) + 1):
        keys = collections.defaultdict(set)
        digests = collections.defaultdict(set)
        for t in texts:
            covered = 0
            for key, first, count, digest in zip(*substrings.finer_anchors(word_hashes(" ".join(t))[3], level)):
                assert first == covered
                covered += count
                digests[key, digest].add(tuple(t[first : first + count + 34]))
                for i in range(first, first + count):
                    keys[tuple(t[i : i + 35])].add(key)
            assert covered == max(0, len(t) - 34)
        assert all(len(k) == 1 for k in keys.values()) and all(len(x) == 1 for x in digests.values())
    assert len(keys) == len({next(iter(k)) for k in keys.values()})


@pytest.mark.parametrize("most", [substrings.REFERENCE_WORDS, 10])
def test_another_reference(spark, most):
    v = vocabulary()
    ref = " ".join(v[:80])
    rows = [(1, "start " + " ".join(v[10:60]) + " end"), (2, " ".join(v[10:40])), (3, None), (4, " ".join(v[200:260])), (5, " ".join(v[200:260])), (None, ref), (6, ref), (6, ref)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in substrings.without_reference(docs, spark.createDataFrame([(ref,), (None,), ("",)], "text string"), most).collect())
    assert got == collections.Counter([(1, "start end"), (2, " ".join(v[10:40])), (3, None), (4, rows[3][1]), (5, rows[4][1]), (None, ""), (6, ""), (6, "")])


def test_text_batches_leave_a_chosen_size(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for given, want in (("10000", str(common.TEXT_BATCH)), ("77", "77")):
            spark.conf.set(key, given)
            assert common.in_text_batches(docs) is docs and spark.conf.get(key) == want
    finally:
        spark.conf.set(key, old)
