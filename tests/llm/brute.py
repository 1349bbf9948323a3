"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np


def lowered(text):
    return (text or "").encode().lower()


def digest(data):
    return hashlib.sha256(data).hexdigest()


def exact(rows):
    """rows: (id, text)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((i, keep[lowered(t)], len(groups[lowered(t)]), i == keep[lowered(t)], digest(lowered(t)))
                   for i, t in rows), key=repr)


def near(rows, width=5, threshold=0.8):
    """(id, class, links), for rows with different ids."""
    sets = []
    for _, t in rows:
        w = lowered(t).split()
        k = min(width, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    classes = {}
    for i, (doc, _) in enumerate(rows):
        classes.setdefault(root(i), []).append(doc)
    return sorted((doc, min(classes[root(i)]), links[i]) for i, (doc, _) in enumerate(rows))


def repeats(rows, width=50):
    """(id, words, removed, digest of the kept words)."""
    first, out = {}, []
    key = lambda i: (i is None, i)
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for p in range(len(w) - width + 1):
            if i is not None and first.setdefault(tuple(w[p:p + width]), i) < i:
                gone[p:p + width] = b"\1" * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), digest(b" ".join(kept))))
    return sorted(out, key=repr)


def held_out(i, folds, fold):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


def base_scores(rows):
    counts = Counter()
    for i, t in rows:
        if not held_out(i, 7, 2):
            counts.update(lowered(t).split())
            counts[b""] += 1
    total, different = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = [*lowered(t).split(), b""]
        out[i] = (held_out(i, 7, 2), len(w), sum(counts[x] > 0 for x in w), total,
                  sum(math.log10((counts[x] + 1) / (total + different + 1)) for x in w))
    return out


def word_edit_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return any(longer[:i] + longer[i + 1:] == shorter for i in range(len(longer)))


def lines(rows, least=5):
    """(id, lines, removed line numbers)."""
    first, out = {}, []
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in ordered:
        for n, line in enumerate((t or "").split("\n")):
            first.setdefault(tuple(line.split()), (i, n))
    texts = sorted((place for place in first.items() if place[0]), key=lambda p: (p[1][0] is not None, p[1]))
    near_lines = {w for k, (w, _) in enumerate(texts) if len(w) >= least
                  and any(len(v) >= least and word_edit_within_one(w, v) for v, _ in texts[:k])}
    for i, t in ordered:
        split = [tuple(line.split()) for line in (t or "").split("\n")]
        out.append((i, len(split), [n for n, w in enumerate(split)
                                    if w and (w in near_lines or first[w] != (i, n))]))
    return sorted(out, key=repr)


def near_components(rows, percent=80):
    """(id, set size, smallest id reached, kept), for rows with different ids."""
    sets = []
    for _, t in rows:
        w = lowered(t).split()
        k = min(2, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    least = [i for i, _ in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
             if i < j and a and b and 100 * len(a & b) >= percent * len(a | b)]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            low = min(least[i], least[j])
            if (least[i], least[j]) != (low, low):
                least[i] = least[j] = low
                moved = True
    return sorted((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, least))


def fill_in_middle(i, text):
    """(units, form, characters of prefix and middle, output)."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexes = hashlib.sha256(f"1:{i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def whitened(vectors, k=8):
    """Coordinates, deviations and shares of the trace."""
    x = np.floor(1024 * vectors).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    return (centred @ turn[:, :k] / np.sqrt(values[:k]), ((n * x - s) ** 2).sum(axis=1).tolist(), values[:k] / values.sum())


def lattice_scores(rows, path, smoothing=0.1, folds=7, fold=2):
    """log10 probabilities of texts, rows: (id, text, class); by plain sums over all words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = len(model)
    order = np.argsort(np.argsort([-model.get_score(i) for i in range(size)], kind="stable"))
    prior = 1 / (10.0 + order)
    prior = prior / prior.sum()
    pieces = {model.id_to_piece(i): i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    raw = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}

    def arcs(text, i):
        out = [(j, (pieces[text[i:j]],)) for j in range(i + 1, min(len(text), i + 64) + 1) if text[i:j] in pieces]
        if not out or out[0][0] != i + 1:
            out.append((i + 1, tuple(raw[b] for b in text[i].encode())))
        return out

    def sums(text, logp):
        """Log probabilities of all beginnings."""
        a = [0.0] + [-math.inf] * len(text)
        for i in range(len(text)):
            for j, ks in arcs(text, i):
                a[j] = np.logaddexp(a[j], a[i] + sum(logp[k] for k in ks))
        return a

    classes = sorted({c for i, _, c in rows if not held_out(i, folds, fold)}, key=lambda c: (c is not None, c or ""))
    counts = {c: Counter() for c in classes}
    words, ends = {b""}, Counter()
    for i, t, c in rows:
        found = lowered(t).split()
        words.update(found)
        if not held_out(i, folds, fold):
            counts[c].update([*found, b""])
            ends[c] += 1
    whole = sum(counts.values(), Counter())
    n = prior * smoothing * size
    logs = np.log(prior)
    for word, count in whole.items():
        if not word:
            continue
        text = "▁" + word.decode()
        a = sums(text, logs)
        b = [-math.inf] * len(text) + [0.0]
        for i in range(len(text) - 1, -1, -1):
            for j, ks in arcs(text, i):
                b[i] = np.logaddexp(b[i], b[j] + sum(logs[k] for k in ks))
        for i in range(len(text)):
            for j, ks in arcs(text, i):
                for k in ks:
                    n[k] += count * math.exp(a[i] + sum(logs[q] for q in ks) + b[j] - a[-1])
    n = np.append(n, sum(ends.values()) + 1.0)
    logp = np.log(n / n.sum())
    logz = {w: sums("▁" + w.decode(), logp)[-1] if w else logp[-1] for w in words}
    totals = {c: sum(counts[c].values()) for c in classes}
    mass = [sum(math.exp(logz[w]) for w, k in whole.items() if w and k >= 1 + less) for less in (0, 1)]

    def parts(word, c, less):
        count = max(whole[word] - less, 0)
        return [max(counts[c][word] - less, 0) / max(totals[c] - less, 1), count / max(sum(totals.values()) - less, 1),
                math.exp(logz[word]), 0.0 if count else math.exp(logz[word]) / max(1 - mass[less], 1e-3)]

    known = [(counts[c][w], np.array(parts(w, c, 1))) for w in whole for c in classes if counts[c][w]]
    weights = np.full(4, 0.25)
    for _ in range(25):
        new = np.zeros(4)
        for k, p in known:
            share = weights * p
            new += k * share / share.sum()
        weights = new / new.sum()
    weights = weights * sum(k for k, _ in known) + [0, 1, 1, 1]
    weights /= weights.sum()

    def score(word, c):
        p = weights[0] * counts[c][word] / max(totals[c], 1) + weights[1] * whole[word] / max(sum(totals.values()), 1)
        spelled = logz[word] + math.log(weights[2] + (0 if whole[word] else weights[3] / max(1 - mass[0], 1e-3)))
        return float(np.logaddexp(math.log(p) if p else -math.inf, spelled))

    out = {}
    for i, t, _ in rows:
        tokens = [*lowered(t).split(), b""]
        by = [math.log((ends[c] + 1) / (sum(ends.values()) + len(classes))) + sum(score(w, c) for w in tokens) for c in classes]
        out[i] = float(np.logaddexp.reduce(by)) / math.log(10)
    return out
