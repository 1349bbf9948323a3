"""Deduplication, scoring, encoding and packing against plain versions."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tramline.llm import bpe, exact_dedup, line_dedup, lm_score, ngram_join, packing, substring_dedup

RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(60)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(text, n, rng=RNG):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY) + "x"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    base = [prose(RNG.randint(60, 220)) for _ in range(12)]
    passage = prose(70)
    texts = [*base, base[0].upper(), base[0], base[0], changed(base[1], 2), changed(base[1], 3), changed(base[2], 30),
             base[3] + "\n" + passage, passage + "\t" + base[4], "x " + passage, base[5] + " " + base[5],
             "", None, "one", "One", "a b c", "été ÉTÉ \U0001f600", " \t\n ",
             "<|endoftext|>ab<|startoftext|>", prose(6000)]
    return list(enumerate(texts, start=3))


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With clashing extra columns and a row without an id."""
    return (spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
            .selectExpr("doc_id", "text", "'x' AS id", "1 AS n", "2 AS node", "'en' AS lang", "3 AS h"))


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id = -1")


def test_exact_groups(docs, nothing, rows):
    got = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()), key=repr)
    assert got == brute.exact([*rows, (None, rows[0][1])])
    assert exact_dedup.exact_groups(nothing).count() == 0
    only_null = docs.where("doc_id IS NULL").unionAll(docs.where("doc_id IS NULL"))
    assert {(r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(only_null).collect()} == {(None, 2, True)}


def test_clashing_chunk_identifiers_fall_back_to_texts(docs, rows, monkeypatch):
    """With identifiers of one byte's worth of difference, texts still decide."""
    recipes = docs.select(F.col("doc_id").alias("id"), F.array(F.lit(b"same")).alias("recipe"),
                          F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                             "abcdefghijklmnopqrstuvwxyz"), 256).alias("text_sha256"))
    clashing = recipes.select(F.lit(b"same").alias("chunk")).limit(1)
    keyed = exact_dedup._with_clashing_texts(docs.select(F.col("doc_id").alias("id"), "text"), recipes, clashing)
    got = {r.n for r in keyed.groupBy("text").agg(F.count("id").alias("n")).collect()}
    assert keyed.count() == len(rows) + 1 and max(got) == 4


def test_chunks_cover_a_text_whatever_stands_before_it():
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    cuts = exact_dedup.cut_points(data)
    spans = exact_dedup.chunks_of(0, len(data), cuts)
    assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]] and (spans[0][0], spans[-1][1]) == (0, len(data))
    moved = exact_dedup.chunks_of(777, 777 + len(data), exact_dedup.cut_points(b"y" * 777 + data))
    assert [(a - 777, b - 777) for a, b in moved] == spans
    long = exact_dedup.chunks_of(0, 200_000, exact_dedup.cut_points(b"a" * 200_000))
    assert max(b - a for a, b in long) <= exact_dedup.MAX_CHUNK


def test_near_duplicates(docs, nothing, rows):
    known = docs.where("doc_id IS NOT NULL")
    assert sorted(map(tuple, ngram_join.near_duplicates(known).collect())) == brute.near(rows)
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_near_duplicates_in_blocks_and_hot_trie_nodes(spark):
    """A group larger than a block, among others: counts of links stay whole."""
    rng = random.Random(9)
    base, other = prose(150, rng), prose(150, rng)
    rows = [(i, changed(base, rng.randint(0, 4), rng)) for i in range(45)] + [(100 + i, changed(other, 1, rng)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.near_duplicates(docs, block=8).collect()))
    assert got == brute.near(rows)


def test_prefix_length_reaches_the_recall():
    d = ngram_join.prefix_length(0.8)
    assert 1 - (1 - 0.8 ** d) ** ngram_join.TREES >= ngram_join.TARGET
    assert d == ngram_join.LONGEST or 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES < ngram_join.TARGET


@pytest.mark.parametrize("width", [50, 7, 2])
def test_substring_repeats(docs, nothing, rows, width):
    out = substring_dedup.remove_repeats(docs, width=width)
    got = sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=repr)
    assert got == brute.repeats([*rows, (None, rows[0][1])], width)
    assert substring_dedup.remove_repeats(nothing, width=width).count() == 0


def test_cut_texts_keep_rows_and_columns(docs, rows):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows) + 1
    kept = {r.doc_id: r.text for r in out.collect()}
    wanted = {i: d for i, _, _, d in brute.repeats(rows)}
    for i, text in rows:
        assert brute.digest(b" ".join((kept[i] or "").encode().split())) == wanted[i]


def test_scores(docs, nothing, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in lm_score.score_documents(docs.where("doc_id IS NOT NULL"), path).collect()}
    for i, (held_out, n, known, total, base) in brute.base_scores(rows).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n, known, total)
        assert r.base_score == pytest.approx(base) and -1e9 < r.score < 0
    assert lm_score.score_documents(nothing, path).count() == 0


def test_scores_by_path(spark):
    """The score against one worked out from the counts; unseen words by their pieces alone."""
    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(3)
    rows = [(i, prose(40, rng), "en" if i % 2 else "de") for i in range(60)]
    held = [i for i in range(100, 400) if brute.held_out(i, 7, 2)]
    odd = ["", "zqx", "zqxzqx", "zqx" * 400, "abcd abcd", "plausibly", "pxqzvkjw", "漢字\U0001f600"]
    rows += [(held[k], t, None) for k, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in lm_score.score_documents(docs, path).collect()}
    want = brute.lattice_scores(rows, path)
    # The weights are means over tasks of those that each task fits, here of a few words.
    assert all(got[i] == pytest.approx(want[i], rel=0.02, abs=0.02) for i in got) and len(got) == len(rows)
    by = {t: got[held[k]] for k, t in enumerate(odd)}
    assert by["zqx" * 400] < 100 * by["zqx"] < 0 and by["zqxzqx"] < by["zqx"] < by[""] and by["pxqzvkjw"] < by["plausibly"]


def test_scores_of_rows_without_an_id_or_under_one(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 500)
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [prose(9) for _ in range(20)] + ["a b c"] * 30 + [None]
    rows = [(None if k % 2 else 7, t, "en") for k, t in enumerate(texts)]
    got = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path).collect()
    assert len(got) == len(rows) and all(r.score < 0 for r in got)
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == sorted((i is None, len((t or "").split()) + 1) for i, t, _ in rows)


def test_lattice_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, _, raw, prior = lm_score.vocabulary(path)
    lattice = lm_score.Lattice(path, np.log(np.append(prior, 0.1)))

    def total(text):
        if not text:
            return 1.0
        out = sum(prior[pieces[text[:k]]] * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces)
        if text[0] not in pieces:
            out += np.prod([prior[raw[b]] for b in text[0].encode()]) * total(text[1:])
        return out

    for word in ("a", "then", "station", "über", "\U0001f600x"):
        assert lattice.log_marginal(word) == pytest.approx(np.log(total("▁" + word)))
        counts = {k: 0.0 for k in range(len(prior))}
        lattice.expect(word, 2.0, counts)
        back = {v: k for k, v in pieces.items()}
        assert sum(c * len(back[k]) for k, c in counts.items() if k in back) == pytest.approx(
            2 * sum(ch in pieces for ch in "▁" + word))


def test_bpe_keeps_words_in_use(monkeypatch):
    class Asked:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, []

        def encode(self, text, **options):
            self.texts.append(text)
            return self.tokenizer.encode(text, **options)

    monkeypatch.setattr(bpe, "MEMO_WORDS", 10)
    enc = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    enc.tokenizer = Asked(enc.tokenizer)
    texts = [" harbour\t", "", None, "\x0bHarbour\x1clight\x85 \x01 a\x01b <|endoftext|>", "  ", *[f"harbour w{n}x y{n}" for n in range(40)]]
    for text in texts:
        ids, decoded = enc.slab(pa.array([text or "", "harbour", text or ""]))
        want = enc.tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids.to_pylist()[0] == ids.to_pylist()[2] == want
        assert decoded.to_pylist()[0] == enc.tokenizer.tokenizer.decode(want, skip_special_tokens=False)
    assert sum(t.split().count("harbour") for t in enc.tokenizer.texts) == 1


@pytest.mark.parametrize("leaf", [bpe.LEAF_CHARS, 50])
def test_bpe_equals_the_library(docs, nothing, rows, leaf):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, path, leaf_chars=leaf).collect()}
    for i, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == whole.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(nothing, path).count() == 0


def test_tree_joins_unsplit_text_exactly():
    enc = bpe.encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    parts = ["a", "th", "ing", "'s", "'", "́", "é", "ß", "7", "!!", "%'s", "漢", "\U0001f600", "İ", " ", "\x01"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 300)))
        size = rng.randint(1, 60)
        leaves = [enc.leaf(text[i:i + size]) for i in range(0, len(text), size)]
        assert enc.tree(leaves).ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_lines(spark, nothing):
    rng = random.Random(3)
    pool = [prose(rng.randint(1, 12), rng) for _ in range(25)]
    pool += [changed(p, 1, rng) for p in pool] + [p + " zz" for p in pool[:10]] + ["", "  ", "\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(40)] + [(90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.removed) for r in line_dedup.duplicate_lines(docs).collect()), key=repr)
    assert got == brute.lines(rows)
    assert line_dedup.duplicate_lines(nothing).count() == 0
    text = docs.limit(1).select(line_dedup.without(F.lit("a\nb\nc"), F.array(F.lit(1))).alias("t")).first().t
    assert text == "a\nc"


def test_longer_lines_around_a_shorter_one(spark):
    """Two lines one word longer than a third, at different places, hide it from neither."""
    rng = random.Random(12)
    short, alone = "a b c d e", "f g h i j k"
    longer = [" ".join([*short.split()[:i], w, *short.split()[i:]]) for i in range(6) for w in ("x", "y")]
    rng.shuffle(longer)
    cases = [["x a b c d e", short, "a b c d e y"], ["x f g h i j k", "f g h i j k y"],
             [*longer[:6], short, *longer[6:]], [short, *longer], [*longer, short],
             [alone + " y", "x " + alone, alone]]
    for case in cases:
        rows = list(enumerate(case))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(((r.doc_id, r.n_lines, r.removed) for r in line_dedup.duplicate_lines(docs).collect()), key=repr)
        assert got == brute.lines(rows)


def test_line_twin_compares_plain_lines_with_variants_only():
    import duckdb

    from tramline.llm import queries
    for case in (["x f g h i j k", "f g h i j k y"], ["x a b c d e", "a b c d e", "a b c d e y"],
                 ["f g h i j k y", "x f g h i j k", "f g h i j k"], ["a b c d e\na b c x e", "a b c d"]):
        rows = list(enumerate(case))
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        got = con.execute(queries.ORACLE["op4_line_dedup"]).fetchall()
        want = [(i, n, len(gone), ",".join(map(str, gone))) for i, n, gone in brute.lines(rows)]
        assert sorted(got) == want


def test_packing(docs, nothing, rows):
    out = packing.pack(docs, lengths=(64, 128, 256)).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in parts) == len((text or "").encode().split())
        assert [r.piece_start for r in parts] == [256 * k for k in range(len(parts))]
    bins = {}
    for r in out:
        if r.n_tokens:
            bins.setdefault((r.shard, r.bin), []).append(r)
        else:
            assert r.shard is None and r.bin is None
    for held in bins.values():
        held.sort(key=lambda r: r.bin_start)
        ends = [r.bin_start + r.n_tokens for r in held]
        assert [r.bin_start for r in held] == [0, *ends[:-1]]
        assert held[0].bin_length == min(c for c in (64, 128, 256) if c >= ends[-1])
    assert packing.pack(nothing).count() == 0


def test_best_fit_takes_the_fullest_bin_that_fits():
    rng = random.Random(8)
    sizes = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    bins, starts, lengths = packing.best_fit(sizes, (40, 64, 100))
    rooms, rest, caps = {}, sum(sizes), (40, 64, 100)
    for size, b, start in zip(sizes, bins, starts):
        fitting = [r for r in rooms.values() if r >= size]
        if b in rooms:
            assert rooms[b] == min(fitting)
        else:
            assert not fitting
            rooms[b] = min((c for c in caps if c >= size), key=lambda c: (packing.cost(c) / min(c, rest), c))
        rooms[b] -= size
        rest -= size
    assert all(r >= 0 for r in rooms.values()) and set(lengths) <= set(caps)
