"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def dedup(rows):
    """(doc_id, text) -> doc_id, keep_id, group_size, sha."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (d, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(d)
    keep = {n: min((d for d in ds if d is not None), default=None) for n, ds in groups.items()}
    return [(d, keep[n], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (d, _), n in zip(rows, norm)]


def fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def near(rows):
    """(doc_id, text) -> doc_id, hex fingerprint, component."""
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    pairs = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1]
    part = union(len(rows), pairs)
    least = {}
    for (d, _), p in zip(rows, part):
        least[p] = min(least.get(p, d), d)
    return [(d, f"{int(f):016x}", least[p]) for (d, _), f, p in zip(rows, fps, part)]


def targets(sizes, weights=(1, 2, 3), cap=3):
    """source -> target for source -> size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return {s: float(cap * sizes[s]) for s in order}
        level = (total - sum(cap * sizes[s] for s in capped)) / sum(w[s] for s in free)
        more = {s for s in free if w[s] * level > cap * sizes[s]}
        if not more:
            return {s: float(cap * sizes[s]) if s in capped else w[s] * level for s in order}
        capped |= more


def vectors(rows, threshold=0.95):
    """(vec_id, vector) -> vec_id, n_links, component, kept."""
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    n = [0] * len(rows)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    part = union(len(rows), pairs)
    least = {}
    for (d, _), p in zip(rows, part):
        if d is not None:
            least[p] = min(least.get(p, d), d)
    return [(d, c, least.get(p), d is not None and d == least.get(p)) for (d, _), c, p in zip(rows, n, part)]


def token_rows(rows, end_id=1):
    """(doc_id, text) in order -> doc_id, start, n_tokens, crc and the ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, out, ids = 0, [], {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        x = t.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        ids[d] = x
        at += len(x)
    return out, ids


def conversation(rows):
    """Rows of one conversation, (turn, role, text) -> n_turns, turns hash, loss chars, loss hash."""
    rows = [(t, r or "", x or "") for t, r, x in sorted(rows)]
    said = "".join(f"{r}\n{x}\n" for _, r, x in rows)
    loss = "".join(x for _, r, x in rows if r == "assistant")
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def toxic_chain(docs, labels, folds=5, cut=10.83, l2=1e-4):
    """(doc_id, text) and (doc_id, quality, toxic), unique ids -> doc_id -> (three probabilities, rejected); dense matrices
    and whole Newton steps."""
    import struct

    import regex

    def tokens(text):
        w = set(regex.findall(r"\p{L}+", (text or "").lower()))
        return w | {f"^{x[:n]}" for x in w for n in (4, 5, 6) if len(x) >= n}

    def fold_of(d):
        h = xxhash.xxh64_intdigest(struct.pack("<i", 66), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", d), h)
        return (h - (1 << 64) if h >= 1 << 63 else h) % folds

    texts = dict(docs)
    train = sorted((d, t, 1 if q is None else q) for d, q, t in labels if d in texts)
    sets, fold = [tokens(texts[d]) for d, _, _ in train], np.array([fold_of(d) for d, _, _ in train])
    toxic = np.array([t == 1 for _, t, _ in train])
    good = np.array([q != 0 for _, _, q in train])
    everything = sorted(set().union(*sets))
    number = {t: i for i, t in enumerate(everything)}
    dense = np.zeros((len(train), len(everything)))
    for i, s in enumerate(sets):
        dense[i, [number[t] for t in s]] = 1

    def chosen(rows):
        a, b = dense[rows & toxic].sum(0), dense[rows & ~toxic].sum(0)
        na, nb = (rows & toxic).sum(), (rows & ~toxic).sum()
        g = np.zeros(len(everything))
        for o, e in ((a, (a + b) * na / (na + nb)), (b, (a + b) * nb / (na + nb)), (na - a, (na + nb - a - b) * na / (na + nb)), (nb - b, (na + nb - a - b) * nb / (na + nb))):
            g += 2 * np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)
        return g >= cut

    def fit(x, y, rows):
        x, y = np.c_[x, np.ones(len(x))][rows], y[rows]
        w, shrink = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, l2), 0]
        if not y.any() or y.all():
            w[-1] = 30 if y.all() else -30
            return w
        for _ in range(300):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + np.diag(shrink + 1e-12), x.T @ (p - y) / len(y) + shrink * w)
            w -= step * min(1, 1 / np.abs(step).max())
            if np.abs(step).max() < 1e-10:
                break
        return w

    score = lambda x, w: np.clip(x @ w[:-1], -12, 12)
    all_rows = np.ones(len(train), bool)
    masks = [chosen(fold != f) for f in range(folds)] + [chosen(all_rows)]
    extra, models = np.zeros((len(train), 0)), []
    for y in (toxic & good, toxic & ~good, toxic):
        out = np.zeros(len(train))
        for f in range(folds):
            x = np.c_[dense[:, masks[f]], extra]
            if (fold == f).any():
                out[fold == f] = score(x, fit(x, y.astype(float), fold != f))[fold == f]
        models.append(fit(np.c_[dense[:, masks[-1]], extra], y.astype(float), all_rows))
        extra = np.c_[extra, out]
    cuts = sorted(set(out))
    tried = [(2 * (toxic & (out >= c)).sum() / ((out >= c).sum() + toxic.sum()), i) for i, c in enumerate(cuts)]
    i = max(tried)[1]
    threshold = (cuts[i] + (cuts[i - 1] if i else cuts[0] - 2)) / 2
    used = [t for t, m in zip(everything, masks[-1]) if m]

    def run(s):
        x, extra = np.array([[t in s for t in used]], float).reshape(1, -1), np.zeros((1, 0))
        for w in models:
            extra = np.c_[extra, score(np.c_[x, extra], w)]
        return extra[0]

    threshold = max(threshold, 0)
    got = {d: run(tokens(t)) for d, t in docs}
    return {d: (*(1 / (1 + np.exp(-o - [w[-1] for w in models]))).tolist(), bool(o[-1] > threshold)) for d, o in got.items()}
