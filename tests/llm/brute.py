"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    words = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def simhash_groups(docs):
    fps = {d: simhash(t) for d, t in docs}
    ids = sorted(fps)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    comp = components(ids, linked)
    return {(d, f"{fps[d]:016x}", comp[d]) for d in ids}


def substrings(docs, window=20):
    first, out = {}, {}
    for d, t in sorted(docs):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in first:
                for k in range(i, i + window):
                    gone[k] = True
            else:
                first[w] = (d, i)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[d] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def cosine_links(vectors, threshold=0.9):
    ids = sorted(vectors)
    ok = {i for i in ids if vectors[i] and None not in vectors[i] and all(map(math.isfinite, vectors[i])) and any(vectors[i])}
    linked = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if a in ok and b in ok and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    linked.append((a, b))
    comp = components(ids, linked)
    return {(i, sum(i in p for p in linked), comp[i], comp[i] == i) for i in ids}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
