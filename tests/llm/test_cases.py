"""Cases that once went wrong, clashing columns in every pipeline stage, and registered queries against plain versions."""

import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bundleloom.llm import ann, embed_dedup, license, mixing, queries, sentencepiece, toxicity, urlfilter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
VEC = "vec_id long, embedding array<float>, label int"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", 1) for i, t in enumerate(texts)], DOC)


# ---------------------------------------------------------------- licences


def test_licence_wherever_it_stands(spark):
    mit = next(t for n, t in license.TEMPLATES if n == "MIT" and "furnished" in t)
    texts = [
        "Licensed under\nthe Apache License, Version 2.0. " + "x" * 5000,  # a long word
        "intro " * 40 + "\n * " + mit.replace(" of ", "\n * of ") + " outro" * 500,  # wrapped, in a longer text
        "we say Released under the MIT License. and go on " * 2,  # inside a line, twice
        "MIT license. " * 5000, "released under the license", None, "",
    ]
    got = {r.doc_id: (r.n_found, r.licenses) for r in license.digest(docs(spark, texts).withColumnRenamed("lang", "words").withColumnRenamed("source", "g")).collect()}
    assert got == {0: (1, "Apache-2.0"), 1: (1, "MIT"), 2: (2, "MIT"), 3: (0, ""), 4: (0, ""), 5: (0, ""), 6: (0, "")}


def test_licence_anchors_lose_nothing():
    words = set(license.anchors(license.TEMPLATES, license.LEAST))
    for _, text in license.TEMPLATES:
        b = license.bigrams(text)
        assert sum(not words & set(g.split()) for g in b) < license.size_bounds(len(b), license.LEAST)[0]


# ---------------------------------------------------------------- mixing


def test_split_changes_no_pick(spark, monkeypatch):
    rng = random.Random(2)
    df = docs(spark, ["a b c " * rng.choice([1, 1, 1, 2, 5]) for _ in range(800)], [rng.choice(["hot", "hot", "b", None]) for _ in range(800)])
    got = []
    for split in (20_000, 40):
        monkeypatch.setattr(mixing, "SPLIT", split)
        got.append({r.doc_id: r.taken for r in mixing.mix(df).collect()})
    assert got[0] == got[1] and len(got[0]) == 800


@pytest.mark.parametrize("longest", [40_000, 70_000, 5_000_000, 100_000_000])
def test_one_rule_for_the_room(longest):
    lengths = np.array([7, 1000, longest // 2, longest])
    counts = np.array([50, 20, 3, 4])
    for budget in (10, longest, int((lengths * counts).sum()) * 2 // 3):
        take = mixing.fill(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and abs(budget - int((take * lengths).sum())) <= longest / 2


# ---------------------------------------------------------------- vectors


@pytest.mark.parametrize("factor", [1.0, ann.FACTOR])
def test_collinear_vectors_tie(spark, factor):
    rng = np.random.default_rng(1)
    one = rng.normal(size=16).astype(np.float32)
    rows = [(1000 + i, [float(np.float32(x)) for x in one * 2.0 ** rng.integers(-6, 6)], 0) for i in range(40)]
    rows += [(2000 + i, [float(x) for x in rng.normal(size=16)], 0) for i in range(300)]
    rng.shuffle(rows)
    rows = [(int(i), v, 0) for i, v, _ in rows] + [(50, [float(x) for x in one], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, VEC).withColumn("cell", F.lit(1)).withColumn("asks", F.lit(False))
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 50, factor=factor, shard=60, block=1).collect())
    assert [x[:2] for x in got] == [(i + 1, 1000 + i) for i in range(5)] and all(x[2] == 1.0 for x in got)


def test_nearest_in_cells_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(9000, 6))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(m)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 500 == 0, factor=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    u = ann.unit(m)
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        assert [i for _, i in sorted(found)] == np.argsort(-s)[:5].tolist()
    assert len(got) == 18


def test_a_pair_at_the_edge_counts_once(spark):
    """Pairs whose distance in a block is the block's budget, give or take rounding, are still one link."""
    n, rng = 16, np.random.default_rng(3)
    turn, budget = embed_dedup.rotation(n), embed_dedup._budget(0.98, n)
    rows = []
    for k in range(60):
        a = ann.unit(rng.normal(size=(1, n)))[0] @ turn
        b = a.copy()
        for s in embed_dedup.parts(n)[:3]:
            step = rng.normal(size=s.stop - s.start)
            b[s] += step / np.sqrt((step * step).sum()) * np.sqrt(budget + rng.uniform(-1, 1) * 1e-9)
        b[-2:] *= np.sqrt(max(0.0, 1 - (b[:-2] ** 2).sum())) / np.sqrt((b[-2:] ** 2).sum())
        rows += [(2 * k, (a @ turn.T).tolist(), k), (2 * k + 1, (b @ turn.T).tolist(), k)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    m = np.array([r[1] for r in rows])
    linked = [float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) >= 0.98 for a, b in zip(m[::2], m[1::2])]
    got = {r.vec_id: r.n_links for r in embed_dedup.digest(df).collect()}
    assert [got[2 * k] for k in range(60)] == [int(x) for x in linked] and any(linked)


# ---------------------------------------------------------------- URL filter, toxicity


def test_url_hosts_are_distinct_and_hold_out():
    hosts = [urlfilter.split_url(u)[0] for u, _ in urlfilter.EXAMPLES]
    assert len(set(hosts)) == len(hosts)
    right = 0
    for i in range(4):
        w = urlfilter.train([e for h, e in zip(hosts, urlfilter.EXAMPLES) if zlib.crc32(h.encode()) % 4 != i])
        right += sum((urlfilter.blocked(w, *urlfilter.split_url(u)) >= 0.5) == bool(y) for h, (u, y) in zip(hosts, urlfilter.EXAMPLES) if zlib.crc32(h.encode()) % 4 == i)
    assert right / len(hosts) > 0.85


def test_url_query_on_the_given_table(spark, sf_dir):
    w = urlfilter.train()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op8_url_filter(spark, sf_dir).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = urlfilter.split_url(urls[r.page_id] or "")
        fits = [(h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "block" if urlfilter.blocked(w, host, path) >= 0.5 else "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_toxicity_query_on_the_given_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for r in queries.op10_toxicity(spark, sf_dir).collect():
        s = (model.bias if model.bias is not None else -math.inf) + sum(model.weights.get(toxicity.bucket(w), 0.0) for w in toxicity.words_of(texts[r.doc_id]))
        assert abs(r.score - 1 / (1 + math.exp(-max(-700, min(700, s))))) < 1e-9 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


# ---------------------------------------------------------------- mixing and SentencePiece on the given table


def test_mixing_query_on_the_given_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    size = {r.doc_id: len((r.text or "").split(None)) if (r.text or "").isascii() else len((r.text or "").encode().split()) for r in rows}
    got = {r.doc_id: r for r in queries.op2_mixing(spark, sf_dir).collect()}
    assert {i: r["size"] for i, r in got.items()} == size
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r.doc_id)
    for ids in by.values():
        taken, target = sum(got[i].taken for i in ids), got[ids[0]].target
        assert abs(taken - target) <= max(size[i] for i in ids) / 2 + 1 and all(got[i].taken in (0, size[i], 2 * size[i]) for i in ids)


@pytest.mark.skipif(not os.path.exists(sentencepiece.MODEL_PATH), reason="no model file here")
def test_sentencepiece_query_on_the_given_table(spark, sf_dir):
    import hashlib

    import sentencepiece as library

    lib = library.SentencePieceProcessor(model_proto=sentencepiece.load())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op3_sentencepiece(spark, sf_dir).collect():
        ids = np.array(lib.encode(texts[r.doc_id]), dtype="<i4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and r.decoded_same


@pytest.mark.skipif(not os.path.exists(sentencepiece.MODEL_PATH), reason="no model file here")
def test_forward_scores_and_small_caches(monkeypatch):
    p = sentencepiece.Pieces(sentencepiece.load())
    walk = sentencepiece.Walk(p)
    for word in sorted([" the", " thermal", " thermometer", " there", " zoo"]):
        out, total = walk.encode(word), 0.0
        for piece in out:
            total += p.score.get(piece, p.lowest)
        assert "".join(out) == word and abs(walk.best[len(word)] - total) < 1e-6
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeth ") for _ in range(300)) for _ in range(60)]
    want = sentencepiece.Coder(p).encode_all(texts)
    monkeypatch.setattr(sentencepiece, "WORD_BYTES", 2000)
    monkeypatch.setattr(sentencepiece, "PAIRS", 50)
    small = sentencepiece.Coder(sentencepiece.Pieces(sentencepiece.load()))
    assert [small.encode_all([t])[0] for t in texts] == want and len(small.p.fits) <= 50 and small.size < 100_000


# ---------------------------------------------------------------- pipeline stages


CLASH = ["id", "size", "words", "copies", "rows", "each", "copy", "kept_id", "_kept_id", "_rows", "_id", "key", "low", "part", "mark", "target"]


def test_stages_with_clashing_columns(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = base.unionByName(base.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "long " * 200_000, "en", "s", 1_000_000)], DOC))
    extra = base.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    for name, step in corpus_pipeline.STAGES[:-1]:
        plain = step(spark, base, sf_dir)
        wide = step(spark, extra, sf_dir)
        assert wide.columns == extra.columns, name
        order = lambda df: sorted(map(str, df.select(base.columns).collect()))
        assert order(wide) == order(plain) and plain.count() > 0, name
        assert step(spark, extra.limit(0), sf_dir).count() == 0, name


def test_toxicity_and_private_stages_against_plain_versions(spark, sf_dir):
    from bundleloom.llm import pii

    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    judged = {r.doc_id: r.predicted for r in queries.op10_toxicity(spark, sf_dir).collect()}
    rows = base.collect()
    kept = stages["toxicity"](spark, base, sf_dir).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in rows if not judged[r.doc_id])
    clean = {r.doc_id: (r.text, r.n_chars, r.source, r.lang) for r in stages["pii"](spark, base, sf_dir).collect()}
    assert clean == {r.doc_id: (pii.redacted(r.text), len(pii.redacted(r.text)), r.source, r.lang) for r in rows}
    mixed = {}
    for r in stages["mixing"](spark, base, sf_dir).collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + 1
    assert mixed == {r.doc_id: r.copies for r in mixing.mix(base).collect() if r.copies}


# ---------------------------------------------------------------- odd rows


def test_substring_of_long_texts_and_null_ids(spark):
    from tests.llm.test_group_ops import plain_removal

    from bundleloom.llm import substring

    rng = random.Random(9)
    long = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    rows = [(3, " ".join(long)), (1, " ".join(long[50_000:50_400])), (None, " ".join(long[7_000:7_100])), (None, " ".join(long[9_000:9_030])), (None, None), (2, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    got = sorted((math.inf if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(df.repartition(3)).collect())
    assert got == plain_removal(rows) and [r[2] for r in got] == [0, 0, 400, 0, 30, 100]


def test_repeated_and_null_rows(spark):
    from bundleloom.llm import pii

    df = spark.createDataFrame([(None, "a@b.co", "en", None, 1), (5, "a@b.co", "en", "s", 1), (5, "a@b.co", "en", "s", 1), (None, "Released under the MIT License.", "en", None, 1)], DOC)
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.digest(df).collect()) == [(0, 0), (0, 1), (5, 1), (5, 1)]
    assert sorted((r.doc_id or 0, r.n_found) for r in license.digest(df).collect()) == [(0, 0), (0, 1), (5, 0), (5, 0)]
    assert sorted((r.doc_id or 0, r.copies) for r in mixing.mix(df).collect())[2:] in ([(5, 1), (5, 1)], [(5, 1), (5, 2)], [(5, 2), (5, 2)])
    labels = spark.createDataFrame([(5, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scores = {(r.doc_id, r.score) for r in toxicity.judge(df.filter("doc_id = 5"), labels).collect()}
    assert len(scores) == 1
    pages = spark.createDataFrame([(1, "http://a.org/fr/x"), (1, "http://a.org/fr/x"), (None, None)], "page_id long, url string")
    assert sorted((r.page_id or 0, r.rule) for r in urlfilter.judge(pages).collect() if r.page_id) == [(1, "org/fr/")] * 2
