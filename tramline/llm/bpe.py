"""BPE encoding and decoding by tree concatenation.

White space always separates tokens, so words of a text are encoded apart and each
word once per task. A text longer than ``LEAF_CHARS`` is cut into leaves at fixed
places, whatever stands there; the leaves are rows of their own, encoded in
parallel, and joined pairwise, level by level. A join re-encodes a window around the
cut, which grows until one token on either side agrees exactly (place and id) with
what the halves had; from there on the halves' tokens stand. In a sequence of merges
every neighbouring pair decides for itself, so agreement of a token on each side
makes the whole equal to encoding at once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.words import slabs, texts_of

LEAF_CHARS = 32768
WINDOW_TOKENS = 8
MEMO_WORDS = 500_000
SLAB_BYTES = 4 << 20
# Words in one call of the tokenizer; more at once take longer a word.
CALL_WORDS = 250

_SPACE = re.compile(r"[\x20\x09-\x0D]")
_MARK = "\x01"


class Piece:
    """A text with its ids."""

    def __init__(self, text: str, ids: np.ndarray):
        self.text, self.ids = text, ids


class Tokens:
    """Consecutive tokens with the character range of each in the whole text."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.ids, self.starts, self.ends = ids, starts, ends

    def clean(self, i: int) -> bool:
        """Whether token i shares no character with its neighbours."""
        return ((i == 0 or self.ends[i - 1] <= self.starts[i])
                and (i + 1 == len(self.ids) or self.starts[i + 1] >= self.ends[i]))

    def places(self) -> dict[tuple[int, int, int], int]:
        return {(int(self.starts[i]), int(self.ends[i]), int(self.ids[i])): i
                for i in range(len(self.ids)) if self.clean(i)}


class Encoder:
    """The tokenizer file's encoding, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.decoder is not None:
            raise ValueError("Only tokenizers that decode to tokens joined by a space are supported.")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode()
                       for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.names = pa.array(self.tokens, pa.binary()).cast(pa.string())
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark = self.direct(_MARK, 0).ids.tolist()
        # Ids (as int32 bytes) of the words met lately, and of those met before them.
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def direct(self, text: str, at: int) -> Tokens:
        """The tokens of a text that starts at character ``at``."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2) + at
        return Tokens(np.array(e.ids, np.int32), spans[:, 0], spans[:, 1])

    def learn(self, words: Iterable[bytes]) -> None:
        """Encode words that the memo lacks, many in one call, parted by a one-token mark.

        Words not met again leave, those in use are kept.
        """
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        new = []
        for w in words:
            if w not in self.memo:
                known = self.older.get(w)
                if known is None:
                    new.append(w)
                else:
                    self.memo[w] = known
        if len(self.mark) != 1:
            parts, odd = [], new
        else:
            odd = [w for w in new if _MARK.encode() in w]
            parts = [w for w in new if _MARK.encode() not in w] if odd else new
        for at in range(0, len(parts), CALL_WORDS):
            some = parts[at:at + CALL_WORDS]
            ids = np.array(self.tokenizer.encode(f" {_MARK} ".join([w.decode() for w in some]),
                                                 add_special_tokens=False).ids, np.int32)
            cuts = np.flatnonzero(ids == self.mark[0])
            raw, starts, ends = ids.tobytes(), [0, *(cuts * 4 + 4).tolist()], [*(cuts * 4).tolist(), len(ids) * 4]
            for w, first, last in zip(some, starts, ends):
                self.memo[w] = raw[first:last]
        for w in odd:
            self.memo[w] = self.direct(w.decode(), 0).ids.tobytes()

    def short(self, text: bytes) -> bytes:
        """Ids (as int32 bytes) of a text whose words are in the memo."""
        return b"".join([self.memo[w] for w in text.split()])

    def slab(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded text of several texts, each distinct word looked up once."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        at, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy()
        kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
        words = coded.dictionary.cast(kind).to_pylist()
        self.learn([w for w in words if w])
        found = [self.memo[w] if w else b"" for w in words]
        sizes = np.array([len(ids) // 4 for ids in found], np.int32)
        known = pa.ListArray.from_arrays(_offsets(sizes), np.frombuffer(b"".join(found), np.int32))
        ids = pa.ListArray.from_arrays(_offsets(sizes[at])[bounds], known.take(coded.indices).flatten())
        return ids, pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values)), " ")

    def tail(self, text: str, k: int) -> Tokens:
        """At least the last k tokens of a text (all, if fewer), read back to a space."""
        size = 16 * k
        while True:
            space = _SPACE.search(text, len(text) - size) if size < len(text) else None
            at = space.end() if space else 0
            if space or size >= len(text):
                found = self.direct(text[at:], at)
                if len(found.ids) >= k or at == 0:
                    return found
            size *= 2

    def head(self, text: str, k: int, shift: int) -> Tokens:
        """At least the first k tokens of a text (all, if fewer), read up to a space."""
        size = 16 * k
        while True:
            space = _SPACE.search(text, size)
            end = space.start() if space else len(text)
            found = self.direct(text[:end], shift)
            if len(found.ids) >= k or end == len(text):
                return found
            size *= 2

    def join(self, a: Piece, b: Piece) -> Piece:
        """The tokens of two neighbouring pieces' text."""
        text, cut, k = a.text + b.text, len(a.text), WINDOW_TOKENS
        while True:
            left, right = self.tail(a.text, k), self.head(b.text, k, cut)
            all_left, all_right = k >= len(a.ids), k >= len(b.ids)
            if len(left.ids) > k:
                left = Tokens(left.ids[-k:], left.starts[-k:], left.ends[-k:])
            if len(right.ids) > k:
                right = Tokens(right.ids[:k], right.starts[:k], right.ends[:k])
            lo = 0 if all_left else int(left.starts[0])
            hi = len(text) if all_right else int(right.ends[-1])
            window = self.direct(text[lo:hi], lo)
            places = window.places()
            before = [(places[p], i) for p, i in left.places().items() if p in places]
            after = [(places[p], i) for p, i in right.places().items() if p in places]
            j, i = (0, -len(left.ids)) if all_left else min(before, default=(None, None))
            j2, i2 = (len(window.ids), len(right.ids)) if all_right else max(after, default=(None, None))
            if j is not None and j2 is not None and j <= j2:
                kept = len(a.ids) - len(left.ids) + i if not all_left else 0
                return Piece(text, np.concatenate([a.ids[:kept], window.ids[j:j2], b.ids[i2:]]))
            k *= 2

    def tree(self, pieces: list[Piece]) -> Piece:
        while len(pieces) > 1:
            pieces = [self.join(*pieces[i:i + 2]) if i + 1 < len(pieces) else pieces[i]
                      for i in range(0, len(pieces), 2)]
        return pieces[0]

    def leaf(self, text: str) -> Piece:
        """A leaf's ids; its words may be cut at either end."""
        raw = text.encode()
        self.learn(set(raw.split()))
        return Piece(text, np.frombuffer(self.short(raw), np.int32))

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join([self.tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _encode_short(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, texts = batch.columns
            for first, last in slabs(texts_of(texts), SLAB_BYTES):
                some = slice(first, last)
                yield pa.RecordBatch.from_arrays([ids[some], *enc.slab(texts[some])], names=["id", "ids", "decoded"])
    return run


def _encode_leaves(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                ids = [enc.leaf(t).ids.tobytes() for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())],
                                                 names=["sha", "segment", "place", "leaf", "ids"])
    return run


def _join_leaves(path: str) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        """One text: its segments between added tokens, each a tree of leaves."""
        enc = encoder(path)
        rows = sorted(group.to_pylist(), key=lambda r: (r["segment"], r["place"]))
        segments: dict[int, list[Piece]] = {}
        for r in rows:
            segments.setdefault(r["segment"], []).append(Piece(r["leaf"], np.frombuffer(r["ids"], np.int32)))
        ids = np.concatenate([
            np.array([enc.added[whole]], np.int32) if (whole := "".join(x.text for x in p)) in enc.added
            else enc.tree(p).ids for p in segments.values()])
        return pa.table({"sha": pa.array([rows[0]["sha"]], pa.binary()),
                         "ids": pa.array([ids], pa.list_(pa.int32())),
                         "decoded": pa.array([enc.decode(ids)], pa.binary()).cast(pa.string())})
    return run


def added_tokens(path: str) -> list[str]:
    return list(encoder(path).added)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row per input row: id_col, ids (array<int>), decoded (string).

    ``ids`` are those of the tokenizer file at ``path`` for the whole text with no
    special tokens added; added tokens that stand in the text are recognised, as the
    library does. Null counts as empty and gives no ids and an empty text. Equal long
    texts are encoded once. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    small = F.length("text") <= leaf_chars
    short = rows.where(small).mapInArrow(_encode_short(path), f"id {kind}, ids array<int>, decoded string")
    long = rows.where(~small).withColumn("sha", F.unhex(F.sha2("text", 256)))
    # Segments: the text cut before and after each added token standing in it.
    marks = [re.escape(t) for t in added_tokens(path)]
    edge = "|".join([f"(?<={m})|(?={m})" for m in marks]) or "(?!)"
    segments = (long.dropDuplicates(["sha"])
                .select("sha", F.posexplode(F.split("text", edge, -1)).alias("segment", "part"))
                .where("part <> ''"))
    leaves = (segments.select(
        "sha", "segment", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.length("part") - 1) / leaf_chars).cast("int")),
            lambda i: F.substring("part", i * leaf_chars + 1, F.lit(leaf_chars)))).alias("place", "leaf"))
        .repartition("sha", "segment", "place"))
    encoded = leaves.mapInArrow(_encode_leaves(path),
                                "sha binary, segment int, place int, leaf string, ids binary")
    joined = encoded.groupBy("sha").applyInArrow(_join_leaves(path), "sha binary, ids array<int>, decoded string")
    long = long.select("id", "sha").join(joined, "sha").select("id", "ids", "decoded")
    return short.unionByName(long).withColumnRenamed("id", id_col)
