"""Plain single-process statements of what the corpus operators return, for small inputs."""

import hashlib
import random
import re

import xxhash

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def spaced(text):
    return SPACED.findall((text or "").encode())


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def print_of(text):
    words = SPACED.findall(lowered(text))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    prints = [print_of(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for (d, _), g in zip(docs, group):
        low[g] = min((x for x in (low.get(g), d) if x is not None), default=None)
    return [(d, f"{p:016x}", low[g]) for (d, _), p, g in zip(docs, prints, group)]


def decontaminate(docs, items, n=10):
    windows = {}
    for item, text in items:
        words = LETTERS.findall(lowered(text))
        for i in range(max(len(words) - n + 1, bool(words))):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    out = []
    for d, text in docs:
        words, hit, found = LETTERS.findall(lowered(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= {x for x in windows[w] if x is not None}
        listed = sorted(str(x) for x in found)
        out.append((d, len(words), len(hit), len(found), sha(",".join(listed).encode()), bool(hit)))
    return out


def substring(docs, n=13):
    first = {}
    for d, text in docs:
        words = spaced(text)
        for i in range(len(words) - n + 1):
            w = tuple(words[i : i + n])
            if d is not None:
                first[w] = min(d, first.get(w, d))
    out = []
    for d, text in docs:
        words, gone = spaced(text), set()
        for i in range(len(words) - n + 1):
            m = first.get(tuple(words[i : i + n]))
            if m is not None and (d is None or m < d):
                gone |= set(range(i, i + n))
        out.append((d, len(words), len(gone), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def suffixes(docs, n=100):
    """``docs`` with distinct, non-null ids."""
    seen, gone = set(), {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        raw, gone[d] = (text or "").encode(), set()
        for i in range(len(raw) - n + 1):
            if raw[i : i + n] in seen:
                gone[d] |= set(range(i, i + n))
            seen.add(raw[i : i + n])
    out = []
    for d, text in docs:
        raw = (text or "").encode()
        g = gone[d]
        out.append((d, len(raw), len(g), sum(i in g and i - 1 not in g for i in range(len(raw))), sha(bytes(b for i, b in enumerate(raw) if i not in g))))
    return out


def invented(seed=7, n=60, size=60, vocabulary=300):
    """Texts of invented words with copies, near copies, shared passages, repeats, empty and null texts."""
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "te", "ro", "é", "Ki", "sul", "o", "x,"]) for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
    passage = [r.choice(words) for _ in range(40)]
    texts = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(1, size))]
        kind = r.random()
        if kind < 0.2 and texts:
            w = (r.choice(texts) or "x").split()
        elif kind < 0.4 and texts:
            w = (r.choice(texts) or "x").split()
            w[r.randrange(len(w))] = r.choice(words)
        elif kind < 0.6:
            a = r.randrange(20)
            w[r.randrange(len(w)) : 0] = passage[a : a + r.randint(12, 40)]
        elif kind < 0.68:
            w = [r.choice(words), r.choice(words)] * r.randint(10, 40)
        texts.append(r.choice([" ", " ", "\n", "  "]).join(w))
    return texts + ["", None, "  \n", "one", "one two", passage and " ".join(passage), " ".join(passage[:9]), " ".join(passage) * 3, "ab" * 400]


def line_templates(line):
    """Template keys of one line, as the line operator defines them."""
    tokens = [None if re.search(rb"[0-9@]", t) else t for t in spaced(line)]
    if len(tokens) < 3 or 2 * tokens.count(None) >= len(tokens):
        return []
    lead, rest = tuple(tokens[:2]), tokens[2:]
    keys = [("whole", tuple(tokens))]
    if len(tokens) >= 6:
        edge = [len(rest) * j // 3 for j in range(4)]
        blocks = [tuple(rest[edge[j] : edge[j + 1]]) for j in range(3)]
        keys += [(len(tokens), lead, j, tuple(b for i, b in enumerate(blocks) if i != j)) for j in range(3)]
    return keys


def drop_lines(docs, least=6):
    whole = lambda line: tuple(None if re.search(rb"[0-9@]", t) else t for t in spaced(line))
    met, first = {}, {}
    for d, text in docs:
        rows, seen = (text or "").split("\n"), set()
        for i, line in enumerate(rows):
            for key in line_templates(line):
                if key not in seen:
                    seen.add(key)
                    met.setdefault(key, set()).add((whole(rows[i - 1]) if i else 0, whole(rows[i + 1]) if i + 1 < len(rows) else 0))
                    if d is not None:
                        first[key] = min(d, first.get(key, d))
    out = []
    for d, text in docs:
        rows = [] if text is None else text.split("\n")
        gone = {i for i, line in enumerate(rows) for k in line_templates(line) if len(met[k]) >= least and (d is None or first.get(k) != d)}
        out.append((d, len(rows), len(gone), sha("\n".join(x for i, x in enumerate(rows) if i not in gone).encode())))
    return out
