"""Plain versions of the operators, row by row, to hold their results against."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def jaccard(rows, n=5, share=75):
    """{id: (size, component)} by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() if len(h) < 400 for k, a in enumerate(h) for b in h[:k]}
    big = {x for x, h in holders.items() if len(h) >= 400}
    assert not big or len(rows) > 2000
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def exact(rows):
    """{id: (keep, size, kept, sha)} for distinct ids."""
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    groups = {}
    for i, t in rows:
        groups.setdefault(norm[i], []).append((-len(t or ""), i))
    return {i: ((k := min(groups[norm[i]])[1]), len(groups[norm[i]]), k == i, hashlib.sha256(norm[i].encode()).hexdigest()) for i, _ in rows}


def _join(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def secrets(text):
    out = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    n = [sum(x[1] == k for x in out) for k in range(3)]
    return (*n, hashlib.sha256(_join(out, ("assign", "access", "hex")).encode()).hexdigest())


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    out = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    n = [sum(x[1] == k for x in out) for k in range(4)]
    return (*n, hashlib.sha256(_join(out, ("email", "ip", "card", "phone")).encode()).hexdigest())


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def packed(text, capacity=2048, tok=None):
    """[(start, length, crc)] of a document's pieces."""
    ids = tok.encode(text, add_special_tokens=False).ids + [0]
    n = len(ids)
    cuts = [0, n] if n <= capacity else ([0] if n % capacity else []) + list(range(n % capacity, n + 1, capacity))
    return [(a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in zip(cuts, cuts[1:])]


def nearest(ids, vectors, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((vectors - vectors[ids.index(q)]) ** 2).sum(1))
        out[q] = sorted((d[i], v) for i, v in enumerate(ids) if v != q)[:k]
    return out
