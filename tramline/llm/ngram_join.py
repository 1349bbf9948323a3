"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

Documents with the same words form one class and are compared once. Each class gets
``TREES`` labels of ``LONGEST`` min-hashes; a tree is the trie of its sorted labels.
Matched prefixes are shortened until pairs at the threshold meet in some tree with the
target recall. Classes below one trie node are compared by their whole signatures,
with a margin no true pair misses in practice, which links them into small candidate
components (a byte of each min-hash is kept, so a 256th agree by chance, which only
adds candidates); inside these every pair is verified on its exact shingle sets. Nodes with
more than ``BLOCK`` classes link to their smallest class without that filter, and
components with more are verified in pairs of blocks, so no task holds a whole hot
group and no pair is lost; what leaves a task are counts and spanning edges, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.bloom import BlockedBloom
from tramline.llm.graph import components
from tramline.llm.words import Words, mix, slabs, texts_of, windows
from tramline.session import written

SHINGLE, THRESHOLD = 5, 0.8
TREES, LONGEST, TARGET = 24, 8, 0.9999
MARGIN_SIGMAS = 4.5
BLOCK = 1024
BUCKET_ROWS = 40_000
_FACTORS = np.random.default_rng(11).integers(0, 1 << 31, TREES * LONGEST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def prefix_length(threshold: float, target: float = TARGET, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix at which pairs at the threshold meet with the target recall."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted different shingles; a text of fewer words is one shingle, an empty one none."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes, min(width, len(hashes))))


def signature(found: np.ndarray) -> np.ndarray:
    short = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(out, (short[at:at + 1024, None] * _FACTORS).min(axis=0), out=out)
    return out


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _signed(width: int, depth: int) -> Callable:
    tree = np.arange(TREES, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.lower() for t in texts_of(batch.column(1))]
            for first, last in slabs(texts):
                w = Words(texts[first:last])
                h, keys, signs, prefixes = w.hashes(), [], [], []
                for k, (a, b) in enumerate(zip(w.bounds, w.bounds[1:])):
                    found = shingles(h[a:b], width)
                    if not len(found):
                        keys.append(None), signs.append(None), prefixes.append(None)
                        continue
                    s = signature(found)
                    p = tree.copy()
                    for level in s.reshape(TREES, LONGEST)[:, :depth].T:
                        p = mix(p * np.uint64(0x9E3779B97F4A7C15) + level)
                    keys.append(_key(texts[first + k].split()))
                    signs.append(s.astype(np.uint8).tobytes())
                    prefixes.append(p.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(keys, pa.binary()),
                     pa.array(signs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                    names=["id", "node", "sign", "prefixes"])
    return run


def _spanning(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The pairs that join two parts not yet joined."""
    parent = list(range(size))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _groups(values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    return np.split(order, cuts)


def _alike(least: float) -> Callable:
    """Edges between classes of one trie node whose signatures agree in enough places."""
    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        signs = np.frombuffer(b"".join(group.column("sign").to_pylist()), np.uint8).reshape(len(nodes), -1)
        need, edges = least * signs.shape[1], []
        for members in _groups(group.column("prefix").to_numpy()):
            s, pairs = signs[members], []
            for i in range(len(members) - 1):
                same = (s[i + 1:] == s[i]).sum(axis=1)
                pairs += [(i, i + 1 + int(j)) for j in np.flatnonzero(same >= need)]
            edges += [(int(members[a]), int(members[b])) for a, b in _spanning(pairs, len(members))]
        return pa.table({"a": pa.array([nodes[a] for a, _ in edges], pa.binary()),
                         "b": pa.array([nodes[b] for _, b in edges], pa.binary())})
    return run


def _shingled(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = [t.lower() for t in texts_of(batch.column(0))], batch.column(1).to_pylist()
            for first, last in slabs(texts):
                w = Words(texts[first:last])
                h, rows, out = w.hashes(), [], []
                for row in range(first, last):
                    if _key(texts[row].split()) == wanted[row]:
                        rows.append(row)
                        out.append(shingles(h[w.bounds[row - first]:w.bounds[row - first + 1]], width).tobytes())
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(take), pa.array(out, pa.binary())],
                                                 names=["node", "shingles"])
    return run


def _verified(threshold: float) -> Callable:
    """Each class's links within its component or block pair, and spanning edges."""
    def run(group: pa.Table) -> pa.Table:
        nodes, sides = group.column("node").to_pylist(), group.column("side").to_numpy()
        cross = group.column("cross").to_pylist()
        weights = group.column("size").to_numpy()
        cells = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        out_a, out_b, out_n = [], [], []
        for members in _groups(group.column("part").to_numpy()):
            _, flat = np.unique(np.concatenate([cells[m] for m in members]), return_inverse=True)
            sizes = np.array([len(cells[m]) for m in members])
            starts, side = np.cumsum(sizes) - sizes, sides[members]
            mark, links, pairs = np.zeros(int(flat.max()) + 1, np.int64), np.zeros(len(members), np.int64), []
            for i in range(len(members)):
                own = flat[starts[i]:starts[i] + sizes[i]]
                mark[own] = 1
                shared = np.add.reduceat(mark[flat], starts)
                mark[own] = 0
                linked = shared >= threshold * (sizes + sizes[i] - shared) - 1e-9
                linked[i] = False
                if cross[members[0]]:  # two blocks: each row meets those of the other
                    linked &= side != side[i]
                links[i] = weights[members[linked]].sum()
                pairs += [(i, int(j)) for j in np.flatnonzero(linked) if j > i]
            edges = _spanning(pairs, len(members))
            out_a += [nodes[m] for m in members] + [nodes[members[a]] for a, _ in edges]
            out_b += [None] * len(members) + [nodes[members[b]] for _, b in edges]
            out_n += links.tolist() + [0] * len(edges)
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary()),
                         "links": pa.array(out_n, pa.int64())})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: id_col, class_id, n_links (long).

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. Two rows link
    when the Jaccard similarity of their sets of ``shingle`` consecutive words is at
    least ``threshold`` (a text of fewer words is one shingle; null and empty texts have
    none and link to nothing). ``n_links`` counts all other rows linked to a row, copies
    too; ``class_id`` is the smallest id among the rows connected by links. Rows that
    repeat an id count as rows of their own. A null id is kept as a row; it names a
    class only if all its rows have null ids. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    depth = prefix_length(threshold)
    signed = written(rows.mapInArrow(_signed(shingle, depth),
                                     f"id {kind}, node binary, sign binary, prefixes array<bigint>"), "signed")
    known = signed.where("node IS NOT NULL")
    sizes = known.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    # One row per class carries the signature; equal texts have equal ones.
    classes = written(known.dropDuplicates(["node"]).select("node", "sign", "prefixes")
                      .join(sizes, "node"), "classes")
    entries = classes.select("node", F.explode("prefixes").alias("prefix"))
    tries = entries.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("low"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("n > 1")
    # Trie nodes of different trees that hold the same classes are compared once.
    tries = tries.groupBy("n", "low", "members").agg(F.min("prefix").alias("prefix"))
    met = written(entries.join(tries.select("prefix", "n", "low"), "prefix"), "met")
    small = met.where(F.col("n") <= block).select("prefix", "node").join(classes.select("node", "sign"), "node")
    n_met = met.count()
    sigma = (threshold * (1 - threshold) / (TREES * LONGEST)) ** 0.5
    edges = (small.withColumn("bucket", F.pmod(F.xxhash64("prefix"), F.lit(n_met // BUCKET_ROWS + 1)))
             .groupBy("bucket").applyInArrow(_alike(threshold - MARGIN_SIGMAS * sigma), "a binary, b binary")
             .unionByName(met.where(F.col("n") > block).select(F.col("node").alias("a"), F.col("low").alias("b"))))
    near = components(edges)
    # Verification: the shingles of every class in a candidate component.
    members = written(near.join(near.groupBy("root").agg(F.count(F.lit(1)).alias("of")), "root")
                      .join(classes.select("node", "first", "size"), "node"), "members")
    wanted = BlockedBloom(members, "first") if members.where("first IS NULL").isEmpty() else None
    m, d = members.alias("m"), (wanted.possible(rows, "id") if wanted else rows).alias("d")
    cells = (m.join(d, F.col("m.first").eqNullSafe(F.col("d.id"))).select("d.text", "m.node")
             .mapInArrow(_shingled(shingle), "node binary, shingles binary"))
    n_rows = members.count()
    blocks = F.ceil(F.col("of") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.select("node", "root", "size", blocks.alias("blocks"), own.alias("own")).select(
        "node", "root", "size", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "blocks")
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(
        "node", "size", (F.col("own") > F.col("other")).cast("int").alias("side"), (lo != hi).alias("cross"),
        F.xxhash64("root", lo, hi).alias("part"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(n_rows // (BUCKET_ROWS // 8) + 1)))
        .otherwise(F.xxhash64("root", lo, hi)).alias("bucket"))
    verified = written(dealt.join(cells.dropDuplicates(["node"]), "node").groupBy("bucket")
                       .applyInArrow(_verified(threshold), "a binary, b binary, links long"), "verified")
    linked = verified.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(verified.where("b IS NOT NULL").select("a", "b"))
    named = (sizes.select("node", "size", "first").join(roots, "node", "left").join(linked, "node", "left")
             .select("node", "size", "first", F.coalesce("root", "node").alias("root"),
                     F.coalesce("links", F.lit(0)).alias("links")))
    class_ids = named.groupBy("root").agg(F.min("first").alias("class_id"))
    named = named.join(class_ids, "root").select(
        "node", "class_id", (F.col("links") + F.col("size") - 1).alias("n_links"))
    return (signed.select("id", "node").join(named, "node", "left")
            .select(F.col("id").alias(id_col),
                    F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
