"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []


def simhash(text, k):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def suffix_cut(rows, length):
    """rows: (key, bytes) in any order; what is left and removed by row, rows of one key not matching each other."""
    seen, out = set(), {}
    by_key = {}
    for i, (key, body) in enumerate(rows):
        by_key.setdefault(key, []).append((i, body))
    for key in sorted(by_key):
        new = set()
        for i, body in by_key[key]:
            grams = [body[j : j + length] for j in range(len(body) - length + 1)]
            dead = np.zeros(len(body), bool)
            for j, g in enumerate(grams):
                if g in seen:
                    dead[j : j + length] = True
            new.update(grams)
            kept = bytes(np.frombuffer(body, np.uint8)[~dead])
            spans = int((dead & ~np.r_[False, dead[:-1]]).sum()) if len(body) else 0
            out[i] = (len(body), int(dead.sum()), spans, hashlib.sha256(kept).hexdigest())
        seen |= new
    return out


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain_shingles(text, k):
    w = plain_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def counts(texts):
    return Counter(t for x in texts for t in [*words(x), None])


#: More columns than the operators know, named like those they use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp int, key string, node long, h long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "k", 2, 3) for i, t, lang in rows], SCHEMA)


def winnowed(text, k, w):
    """(hash, pos) of the chosen k-grams: the least of each window, the rightmost of equal ones."""
    prime, base = (1 << 31) - 1, 1_000_003
    hashes = [(xxhash.xxh64_intdigest(x.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63) for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    grams = [hashes[i : i + k] for i in range(len(hashes) - k + 1)] if len(hashes) >= k else [hashes] if hashes else []
    value = [sum(h % prime * pow(base, len(g) - 1 - j, prime) for j, h in enumerate(g)) % prime for g in grams]
    chosen = {min(range(i, min(i + w, len(value))), key=lambda p: (value[p], -p)) for i in range(max(1, len(value) - w + 1))} if value else set()
    return [(value[p], p) for p in sorted(chosen)]


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0
