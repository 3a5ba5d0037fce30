"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def base_counts(text):
    found = words(text)
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    places = defaultdict(list)
    for i in range(len(found) - 4):
        places[tuple(found[i : i + 5])].append(i)
    inside = {i + j for where in places.values() if len(where) > 1 for i in where for j in range(5)}
    failed = len(found) < 10 or 100 * len(inside) > 20 * len(found)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(found), sum(map(len, found)), symbols, dup, len(inside), failed


def simhash(text):
    found = words(lower(text))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] if len(found) >= 4 else [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_classes(rows, radius=4):
    """{(doc_id, text): (fingerprint, component)}"""
    prints = [simhash(t) for _, t in rows]
    sets = Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                sets.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[sets.find(i)] = min(doc, least.get(sets.find(i), doc))
    return {row: (f"{p:016x}", least.get(sets.find(i))) for i, (row, p) in enumerate(zip(rows, prints))}


def paragraph_removals(rows, min_words=15, least=0.8):
    """{doc_id: {line: first doc}}; every doc_id has one text here."""
    found = []
    for doc, text in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        for line, content in enumerate(text.split("\n")):
            w = words(lower(content))
            if len(w) >= min_words:
                found.append((doc, line, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)), tuple(w)))
    sets, by_shingle, seen = Sets(len(found)), defaultdict(list), set()
    for i, p in enumerate(found):
        for shingle in p[2]:
            by_shingle[shingle].append(i)
    for members in by_shingle.values():
        for y, b in enumerate(members):
            for a in members[:y]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(found[a][2] & found[b][2])
                    if common / (len(found[a][2]) + len(found[b][2]) - common) >= least:
                        sets.join(a, b)
    out = defaultdict(dict)
    for i, p in enumerate(found):
        if sets.find(i) != i:
            out[p[0]][p[1]] = found[sets.find(i)][0]
    return out


def byte_removals(rows, length=100):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, kept_sha256)}, a null id before all others."""
    order = sorted({(doc, text or "") for doc, text in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for doc, text in order:
        data = text.encode()
        mark = bytearray(len(data))
        for p in range(len(data) - length + 1):
            piece = data[p : p + length]
            if piece in seen:
                mark[p : p + length] = b"\x01" * length
            seen.add(piece)
        kept = bytes(x for x, m in zip(data, mark) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out[doc, text] = (len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out
