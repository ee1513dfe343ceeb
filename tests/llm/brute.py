"""Plain versions of the queries, straight from their definitions, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def joined_spans(kinds):
    return ",".join(f"{k}:{a}:{b}" for k, spans in kinds for a, b in sorted(spans))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m)] for k, (p, ok) in rules.items()}


def words6(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def contamination(docs, items):
    """docs: (id, text); items: (id, text). (n_words, n_hit, item ids)"""
    windows = defaultdict(set)
    for item, text in items:
        w = words6(text)
        if item is not None and text is not None:
            for i in range(max(1, len(w) - 12) if w else 0):
                windows[tuple(w[i : i + 13])].add(str(item))
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w = words6(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        yield doc, len(w), len(hit), sorted(found)


def fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(prints, radius=4):
    """Component number of each fingerprint of a list."""
    values = np.array(sorted(set(prints)), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None]) <= radius
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near]) if len(values) else label
        if (new == label).all():
            return {int(v): int(x) for v, x in zip(values, label)}
        label = new
