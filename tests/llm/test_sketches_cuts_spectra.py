"""HyperMinHash components, fill-in-middle and whitening against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tramline.llm import feast, fim, hyperminhash, queries, whitening

RNG = random.Random(8)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(80)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def changed(text, n):
    words = text.split()
    for _ in range(n):
        words[RNG.randrange(len(words))] = RNG.choice(VOCABULARY) + "x"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    base = [prose(RNG.randint(30, 200)) for _ in range(10)]
    tiny = [" ".join(RNG.choice("ab") for _ in range(RNG.randint(1, 7))) for _ in range(60)]
    copies = [changed(base[0], RNG.randint(0, 6)) for _ in range(50)]
    texts = [*base, *tiny, *copies, base[1].upper(), base[1], changed(base[2], 1), changed(base[3], 60), prose(5000),
             "", None, " \t\n ", "one", "ONE", "été ÉTÉ \U0001f600", "a <S> b", "x" * 3000, "\0\x7f[`{@Zz"]
    order = list(range(3, 3 + len(texts)))
    RNG.shuffle(order)
    return list(zip(order, texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With clashing extra columns."""
    return (spark.createDataFrame(rows, "doc_id long, text string")
            .selectExpr("doc_id", "text", "'x' AS id", "1 AS n", "2 AS node", "3 AS h", "4 AS g", "'en' AS output", "5 AS form"))


def test_near_components(docs, rows):
    want = brute.near_components(rows)
    assert sum(not r[3] for r in want) > 60
    for block in (1024, 8):  # with small blocks, hot keys are cut up
        assert sorted(map(tuple, hyperminhash.near_components(docs, block=block).collect())) == want
    assert hyperminhash.near_components(docs.where("false")).count() == 0


def test_open_pairs_after_the_hubs(spark):
    """A chain of texts, each like its neighbours only: hubs cannot join it alone."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i:8 * i + 160])) for i in range(30)] + [(99, "w1 w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 4):
        got = sorted(map(tuple, hyperminhash.near_components(docs, block=block).collect()))
        assert got == brute.near_components(rows) and {r[2] for r in got} == {0, 99}


def test_near_components_of_null_and_repeated_ids(spark):
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(None, a), (7, a + " x"), (7, a), (None, b), (None, b + " x"), (5, c), (5, c), (None, None), (5, "")]
    got = hyperminhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr)
    sizes = [len({tuple(t.split()[i:i + 2]) for i in range(len(t.split()) - 1)}) for t in (a, a + " x", b, b + " x", c)]
    assert found == sorted([(None, sizes[0], 7, False), (7, sizes[1], 7, True), (7, sizes[0], 7, True), (None, sizes[2], None, True),
                            (None, sizes[3], None, True), (5, sizes[4], 5, True), (5, sizes[4], 5, True), (None, 0, None, True),
                            (5, 0, 5, True)], key=repr)


def test_registers_hold_zeros_and_mantissa():
    v = np.array([0, 1, 2, 3, 1 << 31, (1 << 32) - 1, 12345], np.uint32)
    for value, r in zip(v.tolist(), hyperminhash.registers(v).tolist()):
        bits = value.bit_length()
        assert abs(r // 1024 - (32 - bits if value else 33)) <= (0 if value else 1)
        if bits > 12:
            assert r % 1024 == (value >> (bits - 11)) - 1024


def test_estimates_are_close_and_corrected():
    rng = np.random.default_rng(2)
    for n, shared in ((2000, 1600), (2000, 0), (60, 50), (12, 11)):
        pool = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        sketch = hyperminhash.sketches(np.concatenate([pool[:n], pool[n - shared:]]), np.array([0, n]))
        got = hyperminhash.estimate(np.array([(sketch[0] == sketch[1]).mean()]), np.array([n]))[0]
        truth = shared / (2 * n - shared)
        assert abs(got - truth) < 5 * max(0.01, (truth * (1 - truth) / min(200, 20 * n)) ** 0.5)
    assert 0 < hyperminhash._chance(40) < 2 ** -8


def test_unit_ends_in_words():
    alphabet = ["a", "Z", "@", "[", "`", "{", "é", "\U0001f600", "中", " ", "\n", "\0", "\x7f", "ab"]
    texts = ["".join(RNG.choice(alphabet) for _ in range(RNG.randrange(50))) for _ in range(600)] + ["", "abcdefgh", "é" * 8]
    units, cut = fim.Units([t.encode() for t in texts]), [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert units.counts.tolist() == [len(u) for u in cut]
    for part in (0, 0.3, 0.5, 1):
        k = [int(part * len(u)) for u in cut]
        ends = units.byte_after(np.array(k))
        heads = ["".join(u[:i]) for u, i in zip(cut, k)]
        assert ends.tolist() == [len(h.encode()) for h in heads]
        assert units.code_points(ends).tolist() == [len(h) for h in heads]
    assert fim.Units([]).counts.tolist() == []


def test_fill_in_middle(docs, rows):
    more = docs.unionByName(docs.where("text IS NOT NULL").limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    out = fim.fill_in_middle(more).withColumn("again", fim.restored("output", "form"))
    texts, seen = dict(rows), set()
    for r in out.collect():
        seen.add(r.form)
        if r.doc_id is None:
            continue
        text = texts[r.doc_id] or ""
        assert r.again == text
        assert tuple(r)[1:6] == brute.fill_in_middle(r.doc_id, text)
    assert seen == {"plain", "psm", "spm"} and out.count() == len(rows) + 1
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS id", "'x' AS v", "3 AS component")


def test_whitening(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 12)) * np.linspace(1, 4, 12) + 7
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11),
           (904, [1.0]), (905, []), (906, [1e300] * 12)]
    out = whitening.whiten(vectors_of(spark, [*rows, *odd])).collect()
    want, deviation, explained = brute.whitened(x)
    assert len(out) == 500 * 8 and {r.n for r in out} == {500}
    got = np.zeros((500, 8))
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-8


def test_whitening_of_few_rows(spark):
    none = whitening.whiten(vectors_of(spark, [(1, None)]))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(vectors_of(spark, [(1, [0.5, 2.0]), (None, [0.5, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {
        (i, c, 2, 0, None, None, None) for i in (1, None) for c in (1, 2)}
    line = whitening.whiten(vectors_of(spark, [(i, [float(i), 1.0, -float(i)]) for i in range(5)] + [(0, [0.0, 1.0, 0.0])])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1}
    assert all(r.identity_error < 1e-9 and (r.component > 1 or abs(r.explained - 1) < 1e-12) for r in line)
    huge = whitening.whiten(vectors_of(spark, [(i, [i * 1e9, 1.0]) for i in range(40)])).collect()
    assert {r.deviation for r in huge} == {None}


@pytest.mark.parametrize("values", [np.arange(20.0, 0, -1), 10.0 ** -np.arange(20), [5.0] * 12 + [1.0] * 8, [1.0] * 20,
                                    1 + 1e-9 * np.arange(20), [-1.0] * 15 + [2.0] * 5])
def test_contour_integration_misses_none(values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((20, 20)))[0]
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    found, v = feast.leading(a, 8)
    scale = np.abs(values).max()
    assert np.abs(found - np.sort(values)[::-1][:8]).max() < 1e-13 * scale
    assert np.abs(a @ v - v * found).max() < 1e-12 * scale and np.abs(v.T @ v - np.eye(8)).max() < 1e-13
    for shift in (0.5, 4.3, -3.0):
        assert feast.count_above(a, shift) == (np.array(values) > shift).sum()


def test_queries_have_the_columns_asked_for(spark, docs, monkeypatch):
    vectors = vectors_of(spark, [(i, [float(i), 1.0]) for i in range(4)])
    monkeypatch.setattr(queries, "table", lambda spark, folder, name: vectors if name == "embeddings" else docs)
    assert queries.op12_fim(spark, "").dtypes == [
        ("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"),
        ("output_sha256", "string"), ("restored_sha256", "string")]
    assert queries.op13_whitening(spark, "").dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double")]
    digest = {r.doc_id: r.restored_sha256 for r in queries.op12_fim(spark, "").collect()}
    assert all(digest[r.doc_id] == hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
