"""Small inputs and plain re-computations the tests of this folder share."""

import hashlib
import random
import re

ODD = [None, "", " \n\t", "word", "a b", "a b", "x" * 3000, "é" * 150, "日本語 ½ ²", "a\0b", "<|endoftext|> a <|endoftext|>"]


def prose(seed: int, words: int) -> str:
    chance = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "ti"]
    return " ".join("".join(chance.choice(syllables) for _ in range(chance.randint(1, 4))) for _ in range(words))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


def plain_components(docs, n, percent):
    sets = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        k = min(n, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            ids.setdefault(root(i), []).append(doc)
    return [(d, len(sets[i]), min(ids[root(i)]) if root(i) in ids else None) for i, (d, _) in enumerate(docs)]


def plain_repeats(docs, length=100):
    seen, found = set(), {}
    for doc, text in sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            part = raw[i : i + length]
            if part in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        found[doc, text] = (doc, len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return [found[d] for d in docs]


def plain_contamination(docs, items):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for item, text in items:
        found = words(lower(text))
        n = min(10, len(found))
        for k in range(len(found) - n + 1 if n else 0):
            windows.setdefault(tuple(found[k : k + n]), set()).add(str(item))
    rows = []
    for doc, text in docs:
        found, hit, named = words(lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(found) - n + 1):
                if tuple(found[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    named |= windows[tuple(found[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        rows.append((doc, len(found), len(hit), len(named), digest, bool(hit)))
    return rows
