"""Plain versions of what the text operators compute."""

import hashlib
import math
import zlib
from collections import Counter

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    out, cur = [], ""
    for c in text or "":
        if c in SPACES:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + [cur] if cur else out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_measures(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def shingle_set(text, width):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def components(rows, width, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t, width))
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def removed(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)} of unique ids."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def tokens(text):
    return [*words(lower(text)), None]


def base_scores(rows, learn):
    c = Counter(t for i, x in rows if learn(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return n, {i: (len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in rows}
