"""Toxicity by weak supervision.

Voters mark or pass over a text: lexicon voters (a short list of insults, and one
voter for each word or word beginning that marks toxic texts among the labelled ones)
and pattern voters (shouting, runs of marks). A generative label model estimates each
voter's accuracy on toxic and clean texts by expectation-maximisation over the vote
patterns of all documents, starting from the labelled rows, and the correlation of
voters given the label; groups of correlated voters share one vote's weight. A linear
classifier is then trained on the posterior labels.

Words are what counts for a voter and for the classifier: letters only, lower-cased,
each once per text, so length and decoration don't move a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.words import text_digest
from tramline.session import written

# Common English insults.
INSULTS = ("clown", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron",
           "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless")
LABELLED_ROWS = 20_000   # most labelled rows voters are induced from (a share by hash)
TRAINING_ROWS = 20_000   # most labelled rows the classifier is trained on
FEATURES = 2048          # words and beginnings the classifier knows
VOTERS = 256             # most induced lexicon voters
LEAST_ROWS = 5
CHANCE, LEAST_ODDS = 2.5, 1.3  # a term's log odds, less so many standard errors, exceed this
LEAST_SHARE = 0.015      # share of toxic rows that a voter must speak on
LABEL_ACCURACY = 0.95
SILENT = 0.1             # odds factor of a text on which no voter votes
STEMS = (4, 5, 6, 7, 8)

_LETTERS = re.compile(r"[^\W\d_]+")
_CASE = np.zeros(256, np.int64)
_CASE[ord("A"):ord("Z") + 1] = 1
_CASE[ord("a"):ord("z") + 1] = 2
_RUNS = re.compile(r"([!?*#$%&])\1\1")


def terms(text: str) -> set[str]:
    """The different words of a text, their beginnings (marked by a dash), and the
    beginnings that several of its words share (marked by two)."""
    words = set(_LETTERS.findall(text.lower()))
    out = set(words)
    for n in STEMS:
        stems = [w[:n] for w in words if len(w) > n]
        once = set(stems)
        out.update([s + "-" for s in once])
        if len(once) < len(stems):
            out.update([s + "--" for s, c in Counter(stems).items() if c > 1])
    return out


def patterns(text: str) -> tuple[bool, bool]:
    """Shouting: mostly capitals; and a mark repeated three times."""
    kinds = np.bincount(_CASE[np.frombuffer(text.encode(), np.uint8)], minlength=3)
    return bool(kinds[1] > 20 and kinds[1] > kinds[2]), bool(_RUNS.search(text))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled rows of each label that hold a term, summed per task; an empty term
    counts the rows."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label].update(terms(text))
            counts[label][""] += 1
    names = list(set(counts[0]) | set(counts[1]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([counts[0][t] for t in names], pa.int64()),
         pa.array([counts[1][t] for t in names], pa.int64())], names=["term", "clean", "toxic"])


class Voters:
    """What votes for toxic: each induced term, the insult list, the two patterns."""

    def __init__(self, induced: list[str]):
        self.induced = {t: i for i, t in enumerate(induced)}
        self.insults = frozenset(INSULTS)
        self.size = len(induced) + 3

    def votes(self, text: str, found: set[str]) -> list[int]:
        n = len(self.induced)
        out = sorted(self.induced[t] for t in found if t in self.induced)
        if not self.insults.isdisjoint(found):
            out.append(n)
        return out + [n + 1 + i for i, hit in enumerate(patterns(text)) if hit]


def _vote_patterns(voters: Voters) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Different vote patterns of a task, with the rows that show them."""
        counts: Counter[tuple[int, ...]] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[tuple(voters.votes(text, terms(text)))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())],
            names=["votes", "n"])
    return run


class LabelModel:
    """Posterior of toxic given the votes: each voter's rate on toxic and on clean texts,
    and its weight among the voters that it is correlated with."""

    def __init__(self, share: float, toxic: np.ndarray, clean: np.ndarray):
        self.share, self.toxic, self.clean = share, toxic, clean
        self.weight = np.ones(len(toxic))

    def posterior(self, votes: list[np.ndarray], labels: np.ndarray | None = None) -> np.ndarray:
        cast = np.log(self.toxic / self.clean) * self.weight
        base = np.log(self.share / (1 - self.share))  # a voter that passes says nothing by itself
        z = np.array([base + (cast[v].sum() if len(v) else np.log(SILENT)) for v in votes], np.float64)
        if labels is not None:
            z += np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)) * (2 * labels - 1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def expectation(self, pairs: bool) -> Callable:
        """Rows of a task's expected counts: place of the sum, toxic and clean rows. Place
        -1 counts rows; voter i has place i * size + i; with ``pairs``, i * size + j
        counts common votes."""
        size = len(self.toxic)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = (Counter(), Counter())
            for batch in batches:
                votes, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                p = self.posterior([np.array(v, np.int64) for v in votes])
                for v, t, c in zip(votes, (n * p).tolist(), (n * (1 - p)).tolist()):
                    for place in [-1, *(i * size + j for i in v for j in (v if pairs else (i,)))]:
                        sums[0][place] += t
                        sums[1][place] += c
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums[0]), pa.int32()), pa.array(list(sums[0].values()), pa.float64()),
                 pa.array([sums[1][k] for k in sums[0]], pa.float64())], names=["place", "toxic", "clean"])
        return run

    def fit(self, patterns: DataFrame, rounds: int = 4, inertia: float = 1.0) -> None:
        """Expectation-maximisation over all vote patterns (votes, n). The rates at the
        start, which come from labels, count like ``inertia`` times all rows, lest voters
        that share a few texts talk each other up. The last round also
        estimates, among toxic and among clean rows, the correlation of each two voters
        beyond their rates; the positive ones of a voter divide its weight."""
        size, first = len(self.toxic), (self.toxic, self.clean)
        for step in range(rounds):
            pairs = step == rounds - 1
            found = (patterns.mapInArrow(self.expectation(pairs), "place int, toxic double, clean double")
                     .groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
                     .collect())  # at most one row for each two voters
            sums = np.zeros((2, size * size + 1))
            for r in found:
                sums[:, r["place"]] = r["toxic"], r["clean"]
            total, joint = sums[:, -1], sums[:, :-1].reshape(2, size, size)
            if not total.all():
                return
            single = np.diagonal(joint, axis1=1, axis2=2)
            self.toxic, self.clean = (
                np.clip((single[k] + inertia * total[k] * first[k]) / ((1 + inertia) * total[k]), 1e-7, 1 - 1e-6)
                for k in (0, 1))
            if pairs:
                rate = single / total[:, None]
                sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
                corr = (joint / total[:, None, None] - rate[:, :, None] * rate[:, None, :]) / (sd[:, :, None] * sd[:, None, :])
                corr = (corr.clip(0, 1) * total[:, None, None]).sum(axis=0) / total.sum()
                np.fill_diagonal(corr, 1)
                self.weight = 1 / corr.sum(axis=1)


def train(rows: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features with soft targets."""
    n = np.array([len(r) for r in rows], np.int64)
    at, who = np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(np.arange(len(rows)), n)
    each = 1 / max(len(rows), 1)
    w, b, m, v, mb, vb = np.zeros(size), 0.0, np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(who, w[at], len(rows)) + b
        g = each * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target)
        gw, gb = np.bincount(at, g[who], size) + 1e-6 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 / (1 - 0.9 ** step) * (1 - 0.999 ** step) ** 0.5
        w -= rate * m / (np.sqrt(v) + 1e-9)
        b -= rate * mb / (np.sqrt(vb) + 1e-9)
    return w, b


def _featured(vocabulary: dict[str, int], voters: Voters) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, votes = [], []
            for text in batch.column(0).to_pylist():
                found = terms(text)
                features.append([vocabulary[t] for t in found if t in vocabulary])
                votes.append(voters.votes(text, found))
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.list_(pa.int32())),
                                              pa.array(votes, pa.list_(pa.int32())), batch.column(1)],
                                             names=["features", "votes", "label"])
    return run


def _scored(vocabulary: dict[str, int], w: np.ndarray, b: float) -> Callable:
    weight = {t: float(w[i]) for t, i in vocabulary.items() if w[i]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([b + sum([weight[t] for t in sorted(terms(text) & weight.keys())])
                          for text in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2),
                                              pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40)))), *batch.columns[3:]],
                                             names=["id", "held_out", "score", *batch.schema.names[3:]])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", folds: int = 3, held_out_fold: int = 1,
                    threshold: float = 0.7, digest: bool = False) -> DataFrame:
    """One row per input row: id_col, held_out, score (0 to 1), predicted (0 or 1); with
    ``digest``, also h and g, two hashes of its text (see ``words.text_digest``).

    ``labels`` has id_col and label_col (0 or 1; other values and nulls are ignored). Labels of
    rows whose crc32(id as text) modulo ``folds`` is ``held_out_fold`` are not learned
    from. Null texts count as empty and score like texts without a known term. Without
    labels of both kinds only the insult list and the patterns vote. At most
    ``LABELLED_ROWS`` labelled rows induce voters and ``TRAINING_ROWS`` of them train the
    classifier, shares by a hash of their id; the label model sees the votes of all
    documents.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    def is_held_out(i: Column) -> Column:
        return F.coalesce(F.crc32(i.cast("string").cast("binary")) % folds == held_out_fold, F.lit(False))

    rows = rows.withColumn("held_out", is_held_out(F.col("id")))
    known = (labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(F.col(label_col).cast("int")).alias("label")).where(~is_held_out(F.col("id"))))
    n = known.count()

    def learned(size: int, purpose: str) -> DataFrame:
        """The labelled rows of a share of the ids by hash, ``size`` or so: few enough to
        send their ids to every task, so that no text moves."""
        part = F.pmod(F.xxhash64("id", F.lit(purpose)), F.lit(1 << 30)) < int(min(1.0, size / max(n, 1)) * (1 << 30))
        return rows.join(F.broadcast(known.where(part)), "id").select("text", "label")

    counts = (learned(LABELLED_ROWS, "labelled").mapInArrow(_term_counts, "term string, clean long, toxic long")
              .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    counts = written(counts.where((F.col("term") == "") | (F.col("toxic") + F.col("clean") >= LEAST_ROWS)), "terms")
    total = counts.where("term = ''").first()
    n_clean, n_toxic = (max(total["clean"], 1), max(total["toxic"], 1)) if total else (1, 1)
    toxic, clean = F.col("toxic") + 0.5, F.col("clean") + 0.5
    rate = toxic / (n_toxic + 1), clean / (n_clean + 1)
    told = counts.where("term <> ''").select(
        "term", "clean", "toxic",
        # log odds, less what chance may have added
        (F.log(rate[0] / rate[1]) - CHANCE * F.sqrt(1 / toxic + 1 / clean)).alias("odds"),
        # information gained: how many toxic rows a term tells from clean ones
        ((rate[0] - rate[1]) * F.log(rate[0] / rate[1])).alias("gain"))
    best = told.where(F.col("odds") > LEAST_ODDS).orderBy(F.desc("gain"), "term").limit(FEATURES).collect()
    least = max(LEAST_ROWS, LEAST_SHARE * n_toxic)
    induced = [r for r in best if r["toxic"] >= least][:VOTERS]
    voters = Voters([r["term"] for r in induced])
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys([r["term"] for r in best] + list(INSULTS)))}
    # The label model, from the votes of all documents.
    toxic = np.array([(r["toxic"] + 0.5) / (n_toxic + 1) for r in induced] + [0.5, 0.1, 0.1])
    clean = np.array([(r["clean"] + 0.5) / (n_clean + 1) for r in induced] + [0.01, 0.05, 0.05])
    model = LabelModel(float(np.clip(n_toxic / (n_toxic + n_clean), 0.01, 0.5)) if total else 0.1, toxic, clean)
    patterns_seen = written(rows.select("text").mapInArrow(_vote_patterns(voters), "votes array<int>, n long")
                            .groupBy("votes").agg(F.sum("n").alias("n")), "votes")
    model.fit(patterns_seen)
    # The classifier, from the posterior labels of a bounded share of the labelled rows, where
    # the label is one more voter.
    sample = (learned(TRAINING_ROWS, "training")
              .mapInArrow(_featured(vocabulary, voters), "features array<int>, votes array<int>, label int").toArrow())
    target = model.posterior([np.array(v, np.int64) for v in sample.column("votes").to_pylist()],
                             sample.column("label").to_numpy())
    w, b = train([np.array(f, np.int64) for f in sample.column("features").to_pylist()], target, len(vocabulary))
    hashes = text_digest("text") if digest else []
    scored = rows.select("id", "text", "held_out", *hashes).mapInArrow(
        _scored(vocabulary, w, b), f"id {kind}, held_out boolean, score double" + ", h long, g long" * digest)
    return scored.select(F.col("id").alias(id_col), "held_out", "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"),
                         *(["h", "g"] if digest else []))
