"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary form a lattice over each word; every
segmentation counts, weighted by its pieces' probabilities, and the forward recursion
in log space gives the word's marginal probability. Pieces never cross words, so a
text's probability is the product over its words and one end. The file's scores,
which order the pieces, start the piece probabilities; one expectation step over all
training words, in which each segmentation counts by its posterior, fits them to the
corpus. A training word is a path of the lattice by itself, too, with its frequency
in one of a few classes of texts (such as languages) and overall. A word never seen
has its segmentations only; that it is one has a weight of its own, which such words
share as their pieces spell them, so the more pieces a word takes the less likely it
is. The weights of the four kinds of path come from leave-one-out counts. The class of
a text is unknown when it is scored and is summed over, like the segmentation.

Counts and marginals are found once for each different word. Documents are dealt to
buckets of bounded size by a hash of id, text and place; a bucket asks once for each of its
words, so what travels are its different words, not all of them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.words import slabs, texts_of
from tramline.session import written

BUCKET_BYTES = 32 << 20
FLUSH_WORDS = 400_000
SMOOTHING = 0.1
LEAST_UNSEEN = 1e-3
CLASSES = 32
_WORD = "▁"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], frozenset[str], list[int], np.ndarray]:
    """Pieces with their number, all prefixes of pieces, the 256 byte pieces, and the
    probabilities that the file's scores stand for. The scores of a merge vocabulary
    are ranks, which a Zipf law turns into probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, raw = {}, [0] * 256
    scores = np.array([model.get_score(i) for i in range(len(model))])
    for i in range(len(model)):
        if model.is_byte(i):
            raw[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces[model.id_to_piece(i)] = i
    prefixes = frozenset(p[:k] for p in pieces for k in range(1, len(p) + 1))
    weights = 1 / (10 + np.argsort(np.argsort(-scores, kind="stable")))
    return pieces, prefixes, raw, weights / weights.sum()


class Lattice:
    """Marginals of words under given log probabilities of the pieces."""

    def __init__(self, path: str, logp: np.ndarray):
        pieces, prefixes, self.raw, _ = vocabulary(path)
        self.logp = logp.tolist()
        # What each prefix of a piece is by itself: log probability, numbers, probability; or nothing.
        self.steps = {p: (self.logp[k], (k,), math.exp(self.logp[k])) if (k := pieces.get(p)) is not None else None
                      for p in prefixes}

    def _spelled(self, char: str) -> tuple[float, tuple[int, ...], float]:
        """A character without a piece of its own, in bytes."""
        ks = tuple(self.raw[b] for b in char.encode())
        lp = sum(self.logp[k] for k in ks)
        return lp, ks, math.exp(lp)

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...], float]]]:
        """From each character: where a piece may end, its log probability, numbers, probability."""
        text, out, steps = _WORD + word, [], self.steps
        n = len(text)
        for i in range(n):
            here = []
            for j in range(i + 1, n + 1):
                step = steps.get(text[i:j], here)
                if step is here:  # no piece goes on like this
                    break
                if step is not None:
                    here.append((j, *step))
            if not here or here[0][0] != i + 1:
                here.append((i + 1, *self._spelled(text[i])))
            out.append(here)
        return out

    @staticmethod
    def forward(edges: list) -> list[float]:
        into: list[list[float]] = [[] for _ in range(len(edges) + 1)]
        into[0].append(0.0)
        alpha = []
        for i in range(len(edges) + 1):
            t = into[i]
            if len(t) == 1:
                a = t[0]
            else:
                m = max(t)
                a = m + math.log(sum([math.exp(x - m) for x in t]))
            alpha.append(a)
            if i < len(edges):
                for j, lp, _, _ in edges[i]:
                    into[j].append(a + lp)
        return alpha

    def log_marginal(self, word: str) -> float:
        """The last value of ``forward``, without keeping the lattice."""
        text, steps = _WORD + word, self.steps
        n = len(text)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n + 1):
            t = into[i]
            if len(t) == 1:
                a = t[0]
            else:
                m = max(t)
                a = m + math.log(sum([math.exp(x - m) for x in t]))
            if i == n:
                return a
            whole = False
            for j in range(i + 1, n + 1):
                step = steps.get(text[i:j], t)
                if step is t:
                    break
                if step is not None:
                    into[j].append(a + step[0])
                    whole = whole or j == i + 1
            if not whole:
                into[i + 1].append(a + self._spelled(text[i])[0])

    def expect(self, word: str, weight: float, into: dict[int, float]) -> None:
        """Add the expected number of each piece, over all segmentations, times weight. Words
        whose probability a double holds are summed as they are, others in log space."""
        edges = self.edges(word)
        n = len(edges)
        a, b = [0.0] * (n + 1), [0.0] * (n + 1)
        a[0] = 1.0
        for x, here in zip(a, edges):  # a is filled ahead of x
            for j, _, _, p in here:
                a[j] += x * p
        if a[n] > 1e-250:
            b[n] = weight / a[n]
            for i in range(n - 1, -1, -1):
                x, total = a[i], 0.0
                for j, _, ks, p in edges[i]:
                    rest = p * b[j]
                    total += rest
                    for k in ks:
                        into[k] += x * rest
                b[i] = total
            return
        alpha = self.forward(edges)
        total, beta = alpha[-1], [0.0] * (len(edges) + 1)
        for i in range(len(edges) - 1, -1, -1):
            t = [lp + beta[j] for j, lp, _, _ in edges[i]]
            m = max(t)
            beta[i] = m if len(t) == 1 else m + math.log(sum([math.exp(x - m) for x in t]))
            base = alpha[i] - total
            for x, (_, _, ks, _) in zip(t, edges[i]):
                p = math.exp(base + x)
                if p > 1e-12:
                    for k in ks:
                        into[k] += weight * p


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of words by class (0 for words seen elsewhere only), summed per
    task; the end of a text is the empty word. A null word carries the bytes read."""
    counts: dict[int, Counter[bytes]] = defaultdict(Counter)
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for k, found in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(np.full(len(found), k, np.int32)),
                 pa.array(list(found.values()), pa.int64())], names=["word", "k", "c"])
        counts.clear()

    for batch in batches:
        for text, held_out, k in zip(texts_of(batch.column(0)), *(c.to_pylist() for c in batch.columns[1:])):
            words = text.lower().split()
            size += len(text)
            if held_out:
                found = counts[0]
                for w in words:
                    found.setdefault(w, 0)
                found.setdefault(b"", 0)
            else:
                counts[k].update(words)
                counts[k][b""] += 1
            if sum(map(len, counts.values())) > FLUSH_WORDS:
                yield from flush()
    yield from flush()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([0], pa.int32()),
                                      pa.array([size], pa.int64())], names=["word", "k", "c"])


def _expected(path: str, logp: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, into = Lattice(path, logp), defaultdict(float)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lattice.expect(word.decode(errors="replace"), c, into)
        yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.int32()),
                                          pa.array(list(into.values()), pa.float64())], names=["piece", "n"])
    return run


def _marginals(path: str, logp: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, logp)
        for batch in batches:
            logz = [lattice.log_marginal(w.decode(errors="replace")) if w else lattice.logp[-1]
                    for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logz, pa.float64())],
                                             names=["word", "c", "by_class", "logz"])
    return run


def _paths(batch: pa.RecordBatch, totals: np.ndarray, spelled: float, less: int) -> tuple[np.ndarray, ...]:
    """Counts (words x classes), and of each the log probability of the path by class
    frequency, by frequency, by pieces, and by pieces as a word not seen; ``less`` is left
    out of the own count. ``spelled`` is the log of the probability that pieces spell a
    word not seen, so that all such words share the last path's weight."""
    c = batch.column("c").to_numpy()
    by_class = batch.column("by_class").values.to_numpy().reshape(-1, len(totals))
    rest, logz = np.maximum(c - less, 0), batch.column("logz").to_numpy()
    with np.errstate(divide="ignore"):
        frequent = np.log(np.maximum(by_class - less, 0) / np.maximum(totals - less, 1))
        others = (np.log(rest / max(totals.sum() - less, 1)), logz, np.where(rest == 0, logz - spelled, -np.inf))
    return (by_class, frequent, *(np.broadcast_to(p[:, None], by_class.shape) for p in others))


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of probabilities given by their logs; one of them at least is not zero."""
    top = np.maximum.reduce(parts)
    return top + np.log(sum(np.exp(p - top) for p in parts))


def _weights(totals: np.ndarray, spelled: float) -> Callable:
    """Expectation-maximisation of the path weights on a task's words, which are dealt by
    hash and so a fair part of all; rows: the weights times the tokens they stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, *paths = _paths(batch, totals, spelled, 1)
            seen = n > 0
            n, paths = n[seen], [p[seen] for p in paths]
            w = np.full(len(paths), 1 / len(paths))
            if len(n):
                top = np.maximum.reduce(paths)
                shares = [np.exp(p - top) for p in paths]
                for _ in range(25):
                    parts = [x * y for x, y in zip(w, shares)]
                    whole = np.maximum(sum(parts), 1e-300)
                    w = np.array([(n * p / whole).sum() for p in parts])
                    w /= max(w.sum(), 1e-300)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in w * n.sum()],
                                             names=[f"w{i}" for i in range(len(w))])
    return run


def _class_scores(totals: np.ndarray, spelled: float, weights: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, *paths = _paths(batch, totals, spelled, 0)
            with np.errstate(divide="ignore"):
                logs = [np.log(w) + p for w, p in zip(weights, paths)]
            score = (_log_sum(logs) / math.log(10)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array([r.tobytes() for r in score], pa.binary())],
                names=["word", "c", "scores"])
    return run


def _asked(group: pa.Table) -> pa.Table:
    words = {b""}
    for text in texts_of(group.column("text").combine_chunks()):
        words.update(text.lower().split())
    return pa.table({"bucket": pa.array(np.full(len(words), group.column("bucket")[0].as_py()), pa.int32()),
                     "word": pa.array(list(words), pa.binary())})


def _scored(total: int, different: int, prior: np.ndarray) -> Callable:
    """Sums over each text's tokens; ``prior``: log10 of the classes' shares."""
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        c = words.column("c").to_numpy()
        base, known = np.log10((c + 1) / (total + different + 1)), c > 0
        scores = np.frombuffer(b"".join(words.column("scores").to_pylist()), np.float32).reshape(-1, len(prior))
        sums = []
        texts = texts_of(docs.column("text").combine_chunks()) if docs.num_rows else []
        for first, last in slabs(texts):
            for text in texts[first:last]:
                tokens = text.lower().split()
                at = np.fromiter(map(place.__getitem__, tokens), np.int32, len(tokens))
                at = np.append(at, place[b""])
                by_class = prior + scores[at].sum(axis=0, dtype=np.float64)
                best = by_class.max()
                sums.append((len(at), int(known[at].sum()), float(base[at].sum()),
                             float(best + np.log10((10 ** (by_class - best)).sum()))))
        n = len(sums)
        columns = list(zip(*sums)) if n else [[], [], [], []]
        return pa.table({"id": docs.column("id"), "held_out": docs.column("held_out"),
                         "n_tokens": pa.array(columns[0], pa.int64()), "n_known": pa.array(columns[1], pa.int64()),
                         "train_tokens": pa.array([total] * n, pa.int64()),
                         "base_score": pa.array(columns[2], pa.float64()),
                         "score": pa.array(columns[3], pa.float64())})
    return run


def score_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                    class_col: str | None = "lang", folds: int = 7, held_out_fold: int = 2) -> DataFrame:
    """One row per input row: id_col, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities of the whole text).

    Words are runs of other bytes than ASCII white space with A-Z lower-cased; each text
    ends with one end token. Null texts are empty and score their end alone. Rows whose
    crc32(id as text) modulo ``folds`` is ``held_out_fold`` are not learned from; a null
    id is learned from. With no training row the counts are 0 and the pieces keep the
    file's order. ``path`` is a vocabulary file. ``class_col`` tells training texts apart
    (null is a class; beyond ``CLASSES`` values they share classes by hash); it is not
    read of the text that is scored. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"),
                       (F.col(class_col).cast("string") if class_col else F.lit("")).alias("class"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("held_out", F.coalesce(
        F.crc32(F.col("id").cast("string").cast("binary")) % folds == held_out_fold, F.lit(False)))
    rows, classes = _with_class(rows)
    counted = (rows.select("text", "held_out", "k").mapInArrow(_count, "word binary, k int, c bigint")
               .groupBy("word").agg(F.sum("c").alias("c"), F.array(
                   *(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("c"))), F.lit(0)) for k in range(classes))
               ).alias("by_class")))
    counts = written(counted, "counts")
    words = counts.where("word IS NOT NULL")
    head = counts.select(
        F.coalesce(F.max(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0)),
        F.count_if(F.col("word").isNotNull() & (F.col("c") > 0)),
        *(F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("by_class")[k])), F.lit(0)) for k in range(classes)),
        *(F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("by_class")[k])), F.lit(0)) for k in range(classes)),
    ).first()
    size, different = head[:2]
    totals, ends = np.array(head[2:2 + classes], np.int64), np.array(head[2 + classes:], np.int64)
    total = int(totals.sum())
    prior = vocabulary(path)[3]
    learned = (words.where("c > 0 AND length(word) > 0").select("word", "c")
               .mapInArrow(_expected(path, np.log(prior)), "piece int, n double")
               .groupBy("piece").agg(F.sum("n").alias("n")).collect())  # at most one row per piece of the file
    n = prior * SMOOTHING * len(prior)
    for r in learned:
        n[r["piece"]] += r["n"]
    n = np.append(n, ends.sum() + 1.0)  # the end of a text
    logp = np.log(n / n.sum())
    model = written(words.mapInArrow(_marginals(path, logp),
                                     "word binary, c bigint, by_class array<bigint>, logz double"), "model")
    # What pieces spell of the words seen; of those seen twice, as each word is left out once.
    mass = model.where("length(word) > 0").agg(
        *(F.coalesce(F.sum(F.when(F.col("c") >= k, F.exp("logz"))), F.lit(0.0)) for k in (1, 2))).first()
    seen, again = (math.log(max(1 - x, LEAST_UNSEEN)) for x in mass)
    found = model.mapInArrow(_weights(totals, again), "w0 double, w1 double, w2 double, w3 double").agg(
        *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)) for i in range(4))).first()
    weights = np.array(found) + [0.0, 1.0, 1.0, 1.0]  # each text stays possible
    buckets = size // BUCKET_BYTES + 1
    # Rows that share an id, or have none, are parted by their texts, copies by their place.
    deal = F.xxhash64("id", "text", F.monotonically_increasing_id())
    dealt = rows.withColumn("bucket", F.pmod(deal, F.lit(buckets)).cast("int")).select(
        "bucket", "id", "text", "held_out")
    answered = (dealt.groupBy("bucket").applyInArrow(_asked, "bucket int, word binary")
                .join(model.mapInArrow(_class_scores(totals, seen, weights / weights.sum()),
                                       "word binary, c bigint, scores binary"), "word")
                .select("bucket", "word", "c", "scores"))
    out = dealt.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(
        _scored(total, different, np.log10((ends + 1) / (ends.sum() + classes))),
        f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, "
        "train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def _with_class(rows: DataFrame) -> tuple[DataFrame, int]:
    """Number the classes of training texts; held-out texts get none of their own."""
    values = [r[0] for r in rows.where("NOT held_out").select("class").distinct().limit(CLASSES + 1).collect()]
    if len(values) > CLASSES:
        k, n = F.pmod(F.xxhash64("class"), F.lit(CLASSES)).cast("int"), CLASSES
    else:
        k, n = F.lit(0), max(1, len(values))
        for i, v in enumerate(sorted(values, key=lambda v: (v is not None, v or ""))):
            k = F.when(F.col("class").eqNullSafe(F.lit(v)), i).otherwise(k)
    return rows.withColumn("k", k).drop("class"), n
