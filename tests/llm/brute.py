"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lines(rows):
    key = lambda x: x.strip(WS).translate(FOLD)
    held = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 10:
                    held[key(x)].add(d)
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if d is None or len(key(x)) < 10 or d == min(held[key(x)])]
        out.append((d, len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out


def simhash(rows, width=4):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        if not w:
            return 0
        g = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
        bits = np.zeros(64, int)
        for h in (xxhash.xxh64_intdigest(x.encode(), 42) for x in g):
            bits += [(h >> i) & 1 for i in range(64)]
        return sum(1 << i for i in range(64) if bits[i] * 2 > len(g))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))]


def substrings(rows, n=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((d, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def secrets(rows):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    out = []
    for d, t in rows:
        t = t or ""
        a = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        k = [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        h = [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        order = ["assign", "access", "hex"]
        every = sorted(a + k + h, key=lambda x: (x[1], order.index(x[0])))
        out.append((d, len(a), len(k), len(h), sha(",".join(f"{x}:{s}:{e}" for x, s, e in every))))
    return out


def top_k(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q % 50 == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y, strict=False)), i) for b, (i, y) in enumerate(ok) if a != b)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out
