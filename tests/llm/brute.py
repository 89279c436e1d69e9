"""Plain second opinions, one document or pair at a time."""

import collections
import hashlib
import re

import numpy as np

LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles(text):
    w = ascii_words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def lowest(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_duplicates(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    low = lowest(ids, links)
    return {i: (len(sets[i]), low[i], low[i] == i) for i in ids}


def without_repeats(docs, length=50):
    first = {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        w = ascii_words(t)
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), i)
    out = {}
    for i, t in docs:
        w = ascii_words(t)
        gone = {
            k for s in range(len(w) - length + 1) if first[tuple(w[s : s + length])] < i for k in range(s, s + length)
        }
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def repeated_words(docs, length=50):
    holders = collections.defaultdict(set)
    for i, t in docs:
        w = ascii_words(t)
        for s in range(len(w) - length + 1):
            holders[tuple(w[s : s + length])].add(i)
    return {
        (i, k)
        for i, t in docs
        for w in [ascii_words(t)]
        for s in range(len(w) - length + 1)
        if len(holders[tuple(w[s : s + length])]) > 1
        for k in range(s, s + length)
    }


def passages(docs, items, length=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    found = collections.defaultdict(set)
    for i, t in items:
        w = pattern.findall((t or "").translate(LOWER))
        n = min(length, len(w))
        if i is not None and w:
            for s in range(len(w) - n + 1):
                found[tuple(w[s : s + n])].add(i)
    sizes = {len(k) for k in found}
    out = {}
    for i, t in docs:
        w = pattern.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in found:
                    hit |= set(range(s, s + n))
                    names |= found[k]
        out[i] = (len(w), len(hit), sorted(map(str, names)))
    return out


def near_vectors(rows, share=0.93):
    good = {i: (label, np.array(v, float)) for i, label, v in rows if label is not None and v and None not in v}
    good = {i: (s, v) for i, (s, v) in good.items() if np.isfinite(v).all() and v.any()}
    links = [
        (a, b) for a, (s, v) in good.items() for b, (t, w) in good.items()
        if a < b and s == t and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= share
    ]
    low = lowest([i for i, *_ in rows], links)
    degree = collections.Counter(x for link in links for x in link)
    return {i: (degree[i], low[i], low[i] == i) for i, *_ in rows}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
