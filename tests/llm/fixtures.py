"""A small corpus with all the awkward cases, and brute-force versions of the operators."""

import hashlib
import random
import re

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "po", "ru", "sa", "ti", "vu", "xe") for b in ("ba", "da", "fo", "gu", "li", "mo", "na", "re", "si", "tu")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id long, _norm string, kept boolean, label string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(20, 120)) for _ in range(30)]
    base = texts[0]
    texts += [base, base.upper(), base, None, "", None, " \n\t ", "word", "word", "two words", "Müller straße ÀÉ", "ẞ İ ı ŉ"]
    words = base.split()
    for i in range(12):  # near copies of one document, each with another word changed
        changed = list(words)
        changed[rng.randrange(len(changed))] = f"new{i}"
        texts.append(" ".join(changed))
    passage = prose(rng, 60)  # a passage that documents share
    texts += [f"{prose(rng, 15)} {passage} {prose(rng, 15)}" for _ in range(8)]
    texts += ["ab" * 700, "x" * 1500, "0123456789" * 60, prose(rng, 6000)]
    rows = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or ""), 0.5, -1, "clash", False, "z") for i, t in enumerate(texts)]
    return [*rows, rows[5]]  # a row that repeats in full


def documents(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def shingle_set(text):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def near_classes(rows, threshold=0.8):
    """doc_id to smallest id that links connect; equal sets are linked, empty ones too."""
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            alike = a == b or (a and b and len(a & b) / len(a | b) >= threshold)
            if alike:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def repeats(rows, length=200):
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    count: dict[bytes, int] = {}
    for _, b in raw:
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] = count.get(b[s : s + length], 0) + 1
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii_base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and _luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15],
    }
    told = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
    return (*[len(s) for s in found.values()], hashlib.sha256(told.encode()).hexdigest())


def secrets_base(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    told = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return (*[sum(f[1] == n for f in found) for n in range(3)], hashlib.sha256(told.encode()).hexdigest())


def overlap_docs(rows, items, window=12, allowed=2, least=5):
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    found = set()
    for i, text, *_ in rows:
        w = split(text)
        for _, item in items:
            b = split(item)
            if len(b) < least:
                if b and b == w:
                    found.add(i)
                continue
            size = min(window, len(b))
            most = size * allowed // window
            for s in range(len(w) - size + 1):
                if any(sum(x != y for x, y in zip(w[s : s + size], b[j : j + size], strict=True)) <= most for j in range(len(b) - size + 1)):
                    found.add(i)
    return found
