"""Plain versions of the operators, for small fixtures."""

import hashlib
import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def dedup(texts, length):
    """n_bytes, n_removed, n_spans, sha of each text."""
    data = [(t or "").encode() for t in texts]
    count = {}
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] = count.get(b[i:i + length], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        out.append((len(b), len(b) - len(kept), spans, sha(kept)))
    return out


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, percent=75):
    """(doc_id, text) -> {row index: (size, component)}"""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(rows[i][0], len(sets[i]), least.get(find(i))) for i in range(len(rows))]


def contamination(text, items, n=13):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return token.findall((t or "").translate(LOW))

    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        k = min(n, len(b))
        wins = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1) if b else ():
            if tuple(w[i:i + k]) in wins:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)
