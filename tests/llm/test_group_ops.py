"""SimHash, embedding dedup, nearest neighbours, substring dedup, components and the pipeline, against brute force."""

import hashlib
import math
import pickle
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from bundleloom.llm import ann, embed_dedup, jaccard, queries, simhash, substring
from bundleloom.llm.common import connected_components
from tests.compare import connect, same

DOC = "doc_id long, text string, lang string, source string, n_chars long"
VEC = "vec_id long, embedding array<float>, label int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)


def components(n, edges):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(7, 7)]
    want = components(1000, edges)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert connected_components(df.limit(0)).count() == 0


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text, width):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def plain_simhash(rows, width):
    fps = [plain_fingerprint(t, width) for _, t in rows]
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = components(len(fps), edges)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root[k]] = min(low.get(root[k], i), i)
    return sorted((i if i is not None else -1, f"{fps[k]:016x}", low.get(root[k])) for k, (i, _) in enumerate(rows))


def test_simhash(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    rows = list(enumerate(base))
    for k in range(80):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = "EDIT"
        rows.append((1000 + k, "\t".join(w).upper() if k % 2 else "\n ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "one"), (5003, "one two"), (5002, "one"), (None, base[0]), (None, "lonely words here now"), (5004, "é " * 30_000)]
    got = simhash.digest(docs(spark, rows).withColumnRenamed("lang", "fp")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == plain_simhash(rows, 4)
    assert simhash.digest(docs(spark, rows).limit(0)).count() == 0


def test_simhash_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(x & (2**64 - 1) for x in fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps)).collect()
    at = {x: i for i, x in enumerate(signed)}
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert components(len(fps), [(at[r.a], at[r.b]) for r in links]) == components(len(fps), edges)
    assert len(links) < 40 * len(fps)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = a ^ np.array([sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 12), replace=False)) for _ in a], dtype=np.uint64)
    hit = simhash.lanes(simhash.within(simhash.planes_of(a), simhash.planes_of(b), radius, block=3), len(a))
    assert np.array_equal(hit, np.flatnonzero(np.bitwise_count(a ^ b) <= radius))


@pytest.mark.parametrize("rows", [1, 10**5, 10**8, 10**11])
def test_blocks_cover_the_radius(rows):
    blocks, agree = simhash.blocks_for(rows, 4)
    assert blocks - agree >= 4


def test_keep_one(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(200))
    other = " ".join(str(rng.random()) for _ in range(80))
    rows = [(3, text), (1, text), (2, text.upper()), (9, other), (9, other), (None, text), (None, None)]
    got = simhash.keep_one(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 9] and got[0].asDict().keys() == docs(spark, rows).first().asDict().keys()


def plain_sets(rows, width=5):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def plain_kept(rows):
    sets = plain_sets(rows)
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root, low = components(len(rows), edges), {}
    for k, (i, _) in enumerate(rows):
        low[root[k]] = min(low.get(root[k], i), i)
    return set(low.values())


@pytest.mark.parametrize("chunk", [8, 1024])
def test_pipeline_near_dedup_is_jaccard(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "BUCKET", 5_000)
    monkeypatch.setattr(jaccard, "SAMPLE", 20)
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(400)]
    common = " ".join(rng.choice(vocab) for _ in range(60))
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 200))) + (" " + common if k % 3 == 0 else "") for k in range(50)]
    rows = list(enumerate(base))
    for k in range(150):
        w = (base[0] if k % 3 == 0 else rng.choice(base)).split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
        rows.append((1000 + k, " ".join(w).upper() if k % 2 else "\n".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "one"), (5003, "One "), (7000, base[3]), (7000, base[4])]
    rng.shuffle(rows)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = [r.doc_id for r in stage(spark, docs(spark, [*rows, (None, base[0])]).repartition(5), "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) - {None} == plain_kept(rows)
    assert None in kept and stage(spark, docs(spark, rows).limit(0), "").count() == 0


def near_copies(seed):
    rng = random.Random(seed)
    base = [[f"v{rng.randrange(400)}" for _ in range(300)] for _ in range(20)]
    edited = [[f"e{rng.randrange(50)}" if rng.random() < 0.01 else x for x in w] for w in base]
    return [(i, " ".join(w)) for i, w in enumerate(base + edited)]


def test_near_dedup_candidates_come_from_fingerprints(spark, monkeypatch):
    rows = near_copies(5)
    assert len(plain_kept(rows)) < len(rows)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    asked, search = [], simhash.near
    monkeypatch.setattr(jaccard, "near", lambda wides, n: asked.append(wides.columns) or search(wides, n))
    assert {r.doc_id for r in stage(spark, docs(spark, rows), "").collect()} == plain_kept(rows) and asked == [["key", "fp"]]
    # nothing else proposes: without the search only equal sets are joined
    monkeypatch.setattr(jaccard, "near", lambda wides, n: wides.selectExpr("key as a", "key as b").limit(0))
    assert stage(spark, docs(spark, [*rows, (900, rows[0][1])]), "").count() == len({frozenset(s) for s in plain_sets(rows)})


def test_near_dedup_gathers_nothing_on_the_driver(spark, monkeypatch):
    kind, got = type(spark.range(0)), []
    for name in ("collect", "toArrow", "toPandas"):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name), **k: got.append(f(self, *a, **k)) or got[-1])
    store = spark._jsparkSession.sharedState().statusStore()
    ran = lambda: {x.executionId(): x.physicalPlanDescription() for x in map(store.executionsList().apply, range(store.executionsList().size()))}
    before = set(ran())
    dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs(spark, near_copies(6)), "").write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [p for i, p in ran().items() if i not in before]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)
    assert got and sum(len(pickle.dumps(x)) for x in got) < 10_000


def test_wide_search(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SIDE", 40)
    rng = random.Random(9)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(384), n))
    fps = [rng.getrandbits(384) for _ in range(60)]
    fps += [flip(rng.choice(fps[:30]), rng.choice([0, 1, 90, 124, 125, 150])) for _ in range(240)]
    keys = [rng.getrandbits(64) - 2**63 for _ in fps]
    found = simhash.near(spark.createDataFrame([(k, bytearray(f.to_bytes(48, "little"))) for k, f in zip(keys, fps)], "key long, fp binary"), len(fps)).collect()
    low = (1 << 128) - 1
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 124 and ((fps[i] ^ fps[j]) & low).bit_count() <= 52]
    at = {k: i for i, k in enumerate(keys)}
    assert components(len(fps), [(at[r.a], at[r.b]) for r in found]) == components(len(fps), edges)


def test_similar_sets_lie_within_the_radius():
    rng = np.random.default_rng(3)
    pairs = [(4, 0, 1), (5, 0, 1), (8, 1, 1), (12, 0, 3), (16, 2, 2), (40, 5, 5), (80, 0, 20), (160, 20, 20)] * 150
    sets = [[rng.integers(0, 2**63, n).astype(np.uint64) for n in p] for p in pairs]
    each = [np.concatenate(x) for c, a, b in sets for x in ((c, a), (c, b))]
    fps = simhash.wide(np.concatenate(each), np.array([len(x) for x in each]))
    assert fps.shape == (len(each), simhash.WORDS) and np.array_equal(fps[:, 0], simhash.majority(np.concatenate(each), np.array([len(x) for x in each])))
    apart = simhash.apart(fps[::2], fps[1::2])
    assert apart.max() <= simhash.RADIUS_WIDE and simhash.apart(fps[::2][:, :2], fps[1::2][:, :2]).max() <= simhash.FIRST
    far = simhash.apart(fps[:-2], fps[2:])
    assert far.min() > simhash.RADIUS_WIDE and apart.mean() < 80 < 180 < far.mean()


# ---------------------------------------------------------------- vectors

ODD = [None, [], [0.0, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0]]


def vectors(spark, n, dims, seed, groups=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    rows = []
    for i in range(n):
        v = centres[i % groups] + rng.normal(size=dims) * rng.choice([0.01, 0.1, 0.12, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 5])], int(i % 3) if i % 11 else None))
    rows += [(n + k, rows[0][1], 0) for k in range(40)]
    rows += [(n + 100 + k, v, 1) for k, v in enumerate(ODD)] + [(None, rows[0][1], 0), (n + 200, [1.0, 2.0], 0), (n + 201, [2.0, 4.0], 0)]
    return rows, spark.createDataFrame(rows, VEC)


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cos(a, b):
    return float(np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b)))


@pytest.mark.parametrize("chunk", [2048, 20])
def test_embedding_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    rows, df = vectors(spark, 400, 24, 5)
    own = [(i, np.array(v), y) if good(v) and i is not None and y is not None else (i, None, None) for i, v, y in rows]
    edges = [(a, b) for a in range(len(own)) for b in range(a) if own[a][1] is not None and own[b][1] is not None and own[a][2] == own[b][2] and len(own[a][1]) == len(own[b][1]) and cos(own[a][1], own[b][1]) >= 0.98 - 1e-12]
    root = components(len(own), edges)
    links = [0] * len(own)
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    want = {own[k][0]: (links[k], own[root[k]][0], k == root[k]) for k in range(len(own)) if own[k][0] is not None}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.digest(df.withColumn("rep", F.lit(1))).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == want
    assert embed_dedup.digest(df.limit(0)).count() == 0


def test_embedding_dedup_of_many_lengths(spark):
    rows = [(2 * n + k, [1.0] * (n - 1) + [2.0 if k else 2.001], 0) for n in range(2, 72) for k in (0, 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.digest(spark.createDataFrame(rows, VEC)).collect()}
    assert got == {i: (1, i - i % 2) for i, _, _ in rows}


def test_budgets_add_up():
    for n in (1, 2, 7, 8, 64, 100):
        p = embed_dedup.parts(n)
        assert p[0].start == 0 and p[-1].stop == n and embed_dedup._budget(0.98, n) * len(p) >= 0.04
        r = embed_dedup.rotation(n)
        assert np.allclose(r @ r.T, np.eye(n))


@pytest.mark.parametrize("copies", [2, 6])
def test_nearest_of_repeated_queries(spark, copies):
    rows = [(i, [1.0, 2.0], 0) for i in [0] * copies + [1, 2, 3, 4, 5]] + [(i, [2.0, float(i)], 0) for i in range(10, 30)]
    got = ann.nearest(spark.createDataFrame(rows, VEC), F.col("vec_id") == 0, factor=1.0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(i, i) for i in range(1, 6)] and all(r.score > 1 - 1e-9 for r in got)


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (ann.FACTOR, 0.9)])
def test_nearest(spark, factor, least):
    rows, df = vectors(spark, 900, 16, 9)
    own = [(i, np.array(v)) for i, v, _ in rows if good(v) and i is not None]
    got = {}
    for r in ann.nearest(df.withColumn("score", F.lit(1)), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), factor=factor, shard=300, block=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q, v in own:
        if q % 50:
            continue
        best = sorted((-round(cos(v, u), 12), i) for i, u in own if i != q and len(u) == len(v))[:5]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert all(abs(m[2] - cos(v, dict(own)[m[1]])) < 1e-12 for m in mine)
        hit += len({i for _, i in best} & {m[1] for m in mine})
        total += len(best)
    assert hit / total >= least
    assert ann.digest(df.limit(0)).count() == 0


def test_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(0)
    rows = ann.unit(rng.normal(size=(3000, 8)))
    q = ann.unit(rng.normal(size=(40, 8)))
    d, _ = ann.Tree(rows).search(q, 5, 1.0)
    assert np.allclose(d, np.sort(np.sqrt(2 - 2 * q @ rows.T), axis=1)[:, :5], atol=1e-7)


def test_recall_on_the_given_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    m = ann.unit(np.array([r.embedding for r in rows], dtype=float))
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in queries.op4_nearest(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in got:
        s = m @ m[ids == q][0]
        s[ids == q] = -9
        hit += len(set(ids[np.argsort(-s)[:5]].tolist()) & got[q])
    assert hit / (5 * len(got)) >= 0.9


# ---------------------------------------------------------------- substring dedup


def plain_removal(rows, n=20):
    """By comparing every window of words itself."""
    key = lambda i: math.inf if i is None else i
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, (math.inf, math.inf)), (key(i), s))
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] != (key(i), s):
                keep[s : s + n] = [False] * n
        left = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((key(i), len(w), keep.count(False), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed,group", [(1, 1_500_000), (2, 300), (3, 2000)])
def test_substring_dedup(spark, monkeypatch, seed, group):
    monkeypatch.setattr(substring, "GROUP_WORDS", group)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [[word() for _ in range(rng.choice([19, 20, 21, 50, 300]))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        rows.append((rng.randrange(10_000), " ".join(w)))
    rows += [(i + 20_000, rows[i][1].replace(" ", "\n\t")) for i in range(25)]
    rows += [(30_000, "ha " * 300), (30_001, "ab cd " * 90), (30_002, "x y z " * 10 + "ha " * 25), (30_003, "a a b " * 30), (29_000, "ha " * 41)]
    rows += [(40_000, None), (40_001, ""), (None, rows[0][1]), (None, "q r s " * 9), rows[3], (40_002, "Ünï x " * 30)]
    ids = [i for i, _ in rows]
    rows = [(i if i is None or ids.count(i) == 1 or i == rows[3][0] else i + 100_000 + k, t) for k, (i, t) in enumerate(rows)]
    got = substring.digest(docs(spark, rows).withColumnRenamed("lang", "starts").repartition(5)).collect()
    assert sorted((math.inf if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_removal(rows)
    texts = {r.doc_id: r.text for r in substring.remove(docs(spark, rows)).collect()}
    assert texts[30_000].split() == ["ha"] * texts[30_000].split().count("ha")


def test_substring_on_nothing(spark):
    assert substring.digest(docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert substring.digest(docs(spark, [(1, None), (2, "short text")])).count() == 2


def test_equal_substrings_get_equal_symbols():
    rng = random.Random(6)
    inner = [f"i{rng.randrange(40)}" for _ in range(200)]
    texts = [" ".join([f"p{rng.randrange(99)}" for _ in range(rng.randrange(40))] + inner + [f"q{rng.randrange(99)}"] * rng.randrange(30)) for _ in range(6)]
    w = substring.Words(texts)
    x = substring.Symbols(w).round().round()
    starts, symbol, _ = substring.window_symbols(w, x, 20)
    seen = {}
    words = [t.split() for t in texts]
    for s, y in zip(starts, symbol):
        d = w.doc[s]
        at = s - w.first[d]
        assert seen.setdefault(tuple(words[d][at : at + 20]), y) == y


def test_on_the_given_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op9_substring_dedup(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_removal(rows)
    got = queries.op5_simhash(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == plain_simhash(rows, 4)


@pytest.mark.parametrize("name", ["op6_embedding_dedup", "op9_substring_dedup"])
def test_same_as_sql(spark, sf_dir, name):
    assert same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name]) > 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, sf_dir):
    first = df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "sentencepiece"]
    seen = [first]
    for _, step in corpus_pipeline.STAGES:
        df = step(spark, df, sf_dir)
        df = spark.createDataFrame(df.toArrow())
        seen.append(df)
    for x in seen[1:-1]:
        assert sorted(x.columns) == sorted(first.columns)
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert ids[5] == ids[4] <= ids[3] == ids[2] < ids[1] < ids[0]
    rows = [(r.doc_id, r.text) for r in seen[1].collect()]
    assert ids[2] == {c for _, _, c in plain_simhash(rows, 5)}
    assert corpus_pipeline.run(spark, sf_dir).count() == seen[5].count() == seen[4].count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", None, 0), (3, "x y +1 212 555 0100", "en", "s", 19)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {None, 1, 2, 3} and out
