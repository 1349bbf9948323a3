"""Toxicity, search, URL verdicts and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tramline.llm import ann, bloom, graph, packing, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity_scores(docs, labels)
    assert out.count() == docs.count()
    got = out.join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == brute.held_out(r.doc_id, 3, 1) for r in got)
    for held_out in (False, True):
        toxic = [r.predicted for r in got if r.toxic == 1 and r.held_out == held_out]
        clean = [r.predicted for r in got if r.toxic == 0 and r.held_out == held_out]
        assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


def test_toxicity_ignores_held_out_labels_ids_and_other_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    pick = docs.where("doc_id < 50")
    one = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).join(pick.select("doc_id"), "doc_id").collect()}
    two = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs.withColumn("lang", F.lit("xx")), turned)
           .join(pick.select("doc_id"), "doc_id").collect()}
    assert one == pytest.approx(two)


def test_toxicity_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "you idiot"), (4, "!!! \U0001f600 é"), (4, "!!! \U0001f600 é")],
                                 "doc_id long, text string").withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(1, 0), (2, None), (9, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, labels).count() == 5
    assert toxicity.toxicity_scores(docs.where("false"), labels.where("false")).count() == 0


def test_label_model_shares_weight_among_correlated_voters(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        y = rng.random() < 0.3
        a, b = (rng.random() < (0.6 if y else 0.05) for _ in range(2))
        rows.append(([i for i, v in enumerate((a, a, b)) if v], 1))
    patterns = spark.createDataFrame(rows, "votes array<int>, n long")
    model = toxicity.LabelModel(0.3, np.full(3, 0.5), np.full(3, 0.1))
    model.fit(patterns)
    assert model.weight[0] == pytest.approx(model.weight[1]) and model.weight[0] < 0.7 < model.weight[2]
    assert (model.toxic > model.clean).all()


def exact_search(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        out[q] = sorted((float(v), i) for v, i in zip(d, ids) if i != q)[:k]
    return out


def test_nearest_against_exact_search(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vectors.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got = ann.nearest(vectors, vectors.where("vec_id % 10 = 0"), block_rows=200).collect()
    true = exact_search(ids, x, [i for i in ids if i % 10 == 0], 10)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
        assert r.score == pytest.approx(float(np.sqrt(((x[ids.index(r.vec_id)] - x[ids.index(r.query_id)]) ** 2).sum())))
    hits = sum(len({v for _, v in found[q].values()} & {v for _, v in t}) for q, t in true.items())
    assert hits >= 0.9 * 10 * len(true)
    assert all([f[i] for i in range(1, 11)] == sorted(f.values()) for f in found.values())


def test_nearest_edge_vectors(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(30)]
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 1.0]), (103, [float("nan"), 1.0, 1.0]),
           (104, [float("inf"), 1.0, 1.0]), (105, [1.0]), (None, [1.0, 2.0, 3.0]), (106, [-1.0, 5.0, 2.0])]
    vectors = spark.createDataFrame(same + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = ann.nearest(vectors, vectors.where("vec_id IN (20, 100, 101, 103, 106)"), k=4).collect()
    assert {r.query_id for r in got} == {20, 106}
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 20] == [
        (i + 1, i, 0.0) for i in range(4)]
    few = vectors.where("vec_id IN (1, 106)")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, few, k=4).orderBy("query_id").collect()] == [(1, 106), (106, 1)]
    assert ann.nearest(vectors.where("false"), vectors.where("false")).count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (3000, 16), dtype=np.uint8)
    codes[:1000] = codes[0] ^ np.packbits(rng.random((1000, 128)) < 0.1, axis=1)
    index = ann.MultiIndex(codes)
    for radius in (0, 1, 5, 15, 16, 31, 60, 128):
        want = np.flatnonzero(ann.hamming(codes, codes[0]) <= radius)
        assert index.within(codes[0], radius).tolist() == want.tolist()


def test_url_verdicts(spark):
    urls = ["http://A.Example.COM/de/x?y", "https://example.com/DE/", "http://sub.example.net/en/1#a", "ftp://net/",
            "http://notnet/", "http://a.net", "http://a.net?/", None, "", "no scheme", "x://", "http://fr.org/fr/",
            "http://org/fr/http://b/", "http://ads-1.info/p?q", "http://ads-1.info/p2\nline?z", "a://b.c.d.e.net/" + "z" * 5000]
    pages = spark.createDataFrame([*enumerate(urls), (3, urls[3]), (None, urls[0])], "page_id long, url string")
    pages = pages.selectExpr("page_id", "url", "'h' AS host", "'k' AS key")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    listed = spark.createDataFrame([("ads-1.info", "/p"), ("ads-1.info", "/p")], "host string, path string")
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), listed).collect()

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].lower(), rest[end:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), h + p, v) for h, p, v in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        return host, path, None, "block" if (host, path) == ("ads-1.info", "/p") else "allow"

    want = [(i, *plain(u)) for i, u in [*enumerate(urls), (3, urls[3]), (None, urls[0])]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge(pages, empty).collect()} == {"allow"}
    assert url_filter.judge(pages.where("false"), empty).count() == 0


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    b = bloom.BlockedBloom(keys, "k")
    assert b.possible(keys, "k").count() == 3000
    assert b.possible(spark.range(10_000, 30_000).select(F.col("id").cast("string").alias("k")), "k").count() < 400


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (101, 50), (101, 99), (7, 7)] + [(200 + i, 200) for i in range(30)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 50 for i in (50, 99, 100, 101))
    assert all(got[200 + i] == 200 for i in range(30)) and len(got) == 41 + 4 + 30


def test_pipeline_stages_against_plain_versions(spark):
    """Every stage on its own input; the rows it keeps are those of the plain version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        rows, out = list(before.items()), stage(spark, docs, SF)
        if name == "best_fit_packing":
            held = {}
            for r in out.collect():
                held[r.doc_id] = held.get(r.doc_id, 0) + r.n_tokens
            assert held == {i: len((t or "").encode().split()) for i, t in rows}
            break
        assert out.columns == columns
        out.write.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        docs = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            clean = [i for i, y in labels.items() if y == 0]
            assert len(after) < len(before) and np.mean([i in after for i in clean]) > 0.97
            assert np.mean([i in after for i, y in labels.items() if y == 1]) < 0.6
        elif name == "exact_dedup":
            assert set(after) == {i for i, _, _, kept, _ in brute.exact(rows) if kept}
        elif name == "ngram_jaccard_join":
            assert set(after) == {c for _, c, _ in brute.near(rows)}
        else:
            assert set(after) == set(before)
            want = {i: d for i, _, _, d in brute.repeats(rows)}
            assert all(brute.digest(b" ".join((t or "").encode().split())) == want[i] for i, t in after.items())


def test_pipeline_keeps_rows_without_ids_or_texts(spark):
    docs = spark.createDataFrame([(None, "a b", "en", "s", 3), (1, None, None, None, None), (2, "", "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == (2 if name == "exact_dedup" else 3), name
    assert packing.pack(docs.where("false")).count() == 0


def test_pipeline_stages_decide_by_row(spark):
    """Rows without an id, or under one id, stand or go by their own texts."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    base = spark.read.parquet(f"{SF}/documents.parquet").select(*(f.split()[0] for f in schema.split(", ")))
    toxic = (toxicity.toxicity_scores(base, spark.read.parquet(f"{SF}/labels.parquet"), digest=True)
             .where("predicted = 1").join(base, "doc_id").orderBy("doc_id").first().text)
    a, b, c, d, e = (prose(80) for _ in range(5))

    mixed = base.where(F.col("doc_id") < 10 ** 9).unionByName(table([(None, toxic), (None, a), (-7, toxic), (-7, b)]))
    kept = stages["toxicity"](spark, mixed, SF).where("doc_id IS NULL OR doc_id = -7")
    assert texts(kept) == sorted([(None, a), (-7, b)], key=repr)

    copies = table([(None, a), (None, a), (5, b), (5, b), (5, b.upper()), (4, b), (5, c), (None, d), (6, d)])
    kept = texts(stages["exact_dedup"](spark, copies, SF))
    assert sorted((i, t.lower()) for i, t in kept if i is not None) == sorted([(5, b), (5, c), (6, d)])
    assert [t for i, t in kept if i is None] == [a]

    near = table([(1, a + " x"), (None, a + " y"), (None, b), (None, b + " z"), (None, c), (3, d), (3, d + " w"), (3, e)])
    kept = texts(stages["ngram_jaccard_join"](spark, near, SF))
    assert {(1, a + " x"), (None, c), (3, e)} < set(kept) and len(kept) == 5
    assert len({(None, b), (None, b + " z")} & set(kept)) == len({(3, d), (3, d + " w")} & set(kept)) == 1

    repeats = table([(None, a + " x"), (None, a + " y"), (3, b + " v"), (3, b + " w"), (None, c), (9, c + " u")])
    cut = texts(stages["substring_dedup"](spark, repeats, SF))
    assert len(cut) == 6 and {(None, ""), (9, c + " u")} < set(cut)
    for i, passage in ((None, a), (3, b)):
        assert sum(passage in t for k, t in cut if k == i) == 1


def test_repeated_query_rows_have_whole_lists(spark):
    x = np.random.default_rng(7).standard_normal((40, 8))
    rows = [(i, x[i].tolist()) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [(0, 0), (1, 1), (1, 39), (2, 2)]  # id 1 with two vectors
    queries = spark.createDataFrame([rows[0]] * 4 + [(i, rows[j][1]) for i, j in asked], vectors.schema)
    want = []
    for i, j in asked:
        d = np.sqrt(((x - x[j]) ** 2).sum(1))
        d[i] = np.inf
        want += [(i, n, int(v)) for n, v in enumerate(np.argsort(d, kind="stable")[:10], start=1)]
    for block_rows in (100, 12):
        got = ann.nearest(vectors, queries, recall=1.0, block_rows=block_rows).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)
