"""Plain Python versions of the corpus operators, for small fixtures."""

import collections
import hashlib
import re

import numpy as np

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text, lower=True):
    raw = (text or "").lower() if lower else text or ""
    return WORD.findall(raw.encode())


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def least(self, ids):
        out = {}
        for i, v in enumerate(ids):
            if v is not None:
                root = self.find(i)
                out[root] = min(out.get(root, v), v)
        return [out.get(self.find(i)) for i in range(len(ids))]


def jaccard(docs, n, similarity):
    """(id, class, links, kept) of rows (id, text)."""
    sets = []
    for _, text in docs:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    links, union = [0] * len(docs), Union(len(docs))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None and len(a & b) >= similarity * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    least = union.least([d for d, _ in docs])
    return sorted([(d, least[i], links[i], d == least[i]) for i, (d, _) in enumerate(docs)], key=repr)


def vectors(rows, cosine):
    """(id, links, component, kept) of rows (id, vector, label)."""
    good = [i is not None and label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, label in rows]
    links, union = [0] * len(rows), Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    union.join(i, j)
    least = union.least([r[0] for r in rows])
    return sorted([(r[0], links[i], least[i], r[0] == least[i]) for i, r in enumerate(rows)], key=repr)


def strings(docs, length):
    """(id, bytes, removed, spans, digest, mask) of rows (id, text)."""
    seen = collections.Counter(b[i : i + length] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if mask[i] and (not i or not mask[i - 1]))
        out.append((d, len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest(), bytes(mask)))
    return out


def worded(raw, mask, least):
    """`mask` without its runs that hold fewer than `least` whole words."""
    out, words = bytearray(len(raw)), [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    for run in re.finditer(rb"\x01+", bytes(mask)):
        if sum(1 for a, b in words if a >= run.start() and b <= run.end()) >= least:
            out[run.start() : run.end()] = b"\1" * (run.end() - run.start())
    return bytes(out)


def edits(pattern, text):
    """Least edit distance of `pattern` to any part of `text`."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        after = [i]
        for j, t in enumerate(text, 1):
            after.append(min(row[j - 1] + (p != t), row[j] + 1, after[-1] + 1))
        row = after
    return min(row)


def leaks(docs, items, rate, segment, stride, least):
    """{id: items} of which a segment occurs within the budget."""
    out = {}
    for d, text in docs:
        body, found = b" ".join(words(text)), set()
        for item, passage in items:
            whole = b" ".join(words(passage))
            if len(whole) < least:
                if whole and b" " + whole + b" " in b" " + body + b" ":
                    found.add(item)
                continue
            size = min(len(whole), segment)
            for at in {*range(0, len(whole) - size + 1, stride), len(whole) - size}:
                if edits(whole[at : at + size], body) <= int(rate * size):
                    found.add(item)
                    break
        out[d] = found
    return out
