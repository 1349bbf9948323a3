"""Fill-in-middle transformation, with units counted and cut in 64-bit words.

A unit is a run of letters A-Z and a-z, or one other code point. The UTF-8 bytes of many
texts are viewed as little-endian uint64, each text padded to whole words. Arithmetic on
whole words marks the bytes that end a unit; ``bitwise_count`` gives the marks of each
word, their running sum is searched for the word of the k-th mark, and a select inside
that word gives its byte. No byte is looked at by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.words import slabs, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20


def _all(byte: int) -> np.uint64:
    """A word with the same byte eight times."""
    return np.uint64(byte * 0x0101010101010101)


_ONE, _TOP, _LOW7 = _all(0x01), _all(0x80), _all(0x7F)


def _at_least(low7: np.ndarray, byte: int) -> np.ndarray:
    """The top bit of each byte of at most 0x7F that is ``byte`` or more; the sums stay in
    their bytes."""
    return (low7 + _all(0x80 - byte)) & _TOP


def letters(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is a letter; bit 5 tells the cases apart."""
    folded = (words | _all(0x20)) & _LOW7
    return _at_least(folded, 0x61) & ~_at_least(folded, 0x7B) & ~words & _TOP


def continuations(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte 10xxxxxx."""
    return words & ~(words << np.uint64(1)) & _TOP


def _next_byte(marks: np.ndarray) -> np.ndarray:
    """Each byte's mark moved to the byte before it, over word borders."""
    after = np.zeros_like(marks)
    after[:-1] = marks[1:]
    return (marks >> np.uint64(8)) | (after << np.uint64(56))


class Units:
    """The unit ends of several texts: ``counts`` per text, and where the k-th one is."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        # One byte of padding at least, so that nothing runs into the next text.
        spans = self.sizes // 8 + 1
        self.first = np.cumsum(spans) - spans
        words = np.frombuffer(b"".join(t.ljust(int(8 * s), b"\0") for t, s in zip(texts, spans)), "<u8")
        letter, self.inner = letters(words), continuations(words)
        ends = ~((letter & _next_byte(letter)) | _next_byte(self.inner)) & _TOP
        real = np.full(len(words), _TOP)
        if len(words):
            real[self.first + spans - 1] &= (np.uint64(1) << (self.sizes % 8 * 8).astype(np.uint64)) - np.uint64(1)
        self.ends = ends & real
        self.until = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])
        self.inner_until = np.concatenate([[0], np.cumsum(np.bitwise_count(self.inner), dtype=np.int64)])
        self.counts = self.until[self.first + spans] - self.until[self.first]

    def byte_after(self, k: np.ndarray) -> np.ndarray:
        """The number of bytes of each text's first ``k`` units (one k for each text)."""
        wanted = self.until[self.first] + k
        word = np.searchsorted(self.until, wanted, side="left") - 1
        some = k > 0
        word = np.where(some, word, self.first)
        rank = np.where(some, wanted - self.until[word], 1).astype(np.uint64)
        # Byte j holds the number of marks in the bytes 0 to j, at most 8.
        running = (self.ends[word] >> np.uint64(7)) * _ONE
        reached = (running + (np.uint64(0x80) - rank) * _ONE) & _TOP
        at = (word - self.first) * 8 + 9 - np.bitwise_count(reached)
        return np.where(some, at, 0)

    def code_points(self, size: np.ndarray) -> np.ndarray:
        """Code points in each text's first ``size`` bytes, which end at a code point."""
        word, rest = self.first + size // 8, (size % 8 * 8).astype(np.uint64)
        part = self.inner[word] & ((np.uint64(1) << rest) - np.uint64(1))
        inside = self.inner_until[word] - self.inner_until[self.first] + np.bitwise_count(part)
        return size - inside


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    for batch in batches:
        texts = texts_of(batch.column(1))
        draws = np.array([batch.column(c).to_numpy() for c in range(2, 6)])
        for first, last in slabs(texts):
            part, (h1, h2, h3, h4) = texts[first:last], draws[:, first:last]
            units = Units(part)
            a, b = h1 % (units.counts + 1), h2 % (units.counts + 1)
            left, right = units.byte_after(np.minimum(a, b)), units.byte_after(np.maximum(a, b))
            head, body = units.code_points(left), units.code_points(right)
            plain = np.array([not t or any(x in t for x in marks) for t in part], bool) | (h3 % 100 >= PLAIN_FROM)
            spm = h4 % 100 < SPM_BELOW
            out, forms = [], []
            for t, i, j, whole, suffix_first in zip(part, left, right, plain, spm):
                if whole:
                    out.append(t)
                elif suffix_first:
                    out.append(b"".join((s, t[j:], p, t[:i], m, t[i:j])))
                else:
                    out.append(b"".join((p, t[:i], s, t[j:], m, t[i:j])))
                forms.append("plain" if whole else "spm" if suffix_first else "psm")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), pa.array(units.counts, pa.int64()), pa.array(forms),
                 pa.array(head, pa.int64(), mask=plain), pa.array(body - head, pa.int64(), mask=plain),
                 pa.array(out, pa.binary()).cast(pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """One row per input row: id_col, n (units, long), form, prefix_chars, middle_chars
    (code points; null if plain), output.

    The cuts and the form come from the sha256 of ``seed``, a colon and the id, so rows
    that repeat an id are cut by the same draws, each at its own units. A null id draws
    from the seed and the colon alone; a null text is empty, has no units and stays plain.
    Other columns are not read.
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), draw.alias("draw"))
    kind = rows.schema["id"].dataType.simpleString()
    numbers = [F.conv(F.substring("draw", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    out = rows.select("id", "text", *numbers).mapInArrow(
        _transformed, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: str, form: str) -> Column:
    """The text an output was made from; the marks are unambiguous, as no text with one
    of them is cut."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    return (F.when(F.col(form) == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(F.col(form) == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .otherwise(F.col(output)))
