"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = words((text or "").translate(ASCII))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(ids)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs}
    link = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    comp = components(sets, link)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def unrepeated(docs, window):
    """(n_bytes, n_removed, n_spans, sha) of each document in order."""
    seen, out = set(), []
    for text in docs:
        x = (text or "").encode()
        gone = bytearray(len(x))
        for s in range(len(x) - window + 1):
            w = x[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(w)
        runs = sum(1 for i in range(len(x)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
