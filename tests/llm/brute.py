"""Plain definitions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def word_dedup(rows, n=50):
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text), sorted."""
    rank = lambda i: (i is None, i or 0)
    owner = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            owner[key] = min(owner.get(key, rank(i)), rank(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if owner[tuple(w[k:k + n])] < rank(i):
                gone[k:k + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return out


def byte_dedup(rows, n=200):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows (doc_id, text)."""
    from collections import Counter
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k:k + n] for k in range(len(b) - n + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k:k + n]] > 1:
                gone[k:k + n] = b"\x01" * n
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def shingle_set(text, n=4):
    w = words(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[k:k + n]) for k in range(len(w) - n + 1)])


def similar_components(rows, n=4, percent=85):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text) with distinct ids."""
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    at = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, s) in enumerate(sets):
        seen = {}
        for x in s:
            for j in at[x]:
                if j < k:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]
