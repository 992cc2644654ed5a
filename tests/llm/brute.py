"""Plain counterparts of the operators, for comparison."""

from __future__ import annotations

import re

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, general matches first and failing ones dropped after."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m[0]) >= 24]
    return sorted(out)


def fingerprint(text: str, shingle: int = 4) -> int:
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def united(nodes, pairs) -> list[set]:
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[top(a)] = top(b)
    out: dict = {}
    for n in nodes:
        out.setdefault(top(n), set()).add(n)
    return list(out.values())


def classes(items, linked) -> list[set]:
    items = list(items)
    return united(items, [(a, b) for i, a in enumerate(items) for b in items[i + 1:] if linked(a, b)])


def targets(sizes: dict, weights: tuple, most: int) -> dict:
    """Share by weight, hold at the limit, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        whole = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / whole > most * sizes[s]]
        if not above:
            return target | {s: left * weight[s] / whole for s in free}
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def maximal_segments(scores: list[float]) -> list[tuple[int, int]]:
    """Best segment first, then those of what lies left and right of it; ties go to the shortest, then the first."""

    def within(lo: int, hi: int) -> list[tuple[int, int]]:
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 0 and (best is None or (total, i - j - 1) > best[:2]):
                    best = (total, i - j - 1, i, j + 1)
        if best is None:
            return []
        _, _, i, j = best
        return [*within(lo, i), (i, j), *within(j, hi)]

    return within(0, len(scores))


def png_filtered(samples, kind: int, step: int):
    import numpy as np

    out = np.zeros_like(samples)
    for y in range(samples.shape[0]):
        for x in range(samples.shape[1]):
            a = int(samples[y, x - step]) if x >= step else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - step]) if y and x >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x] = (int(samples[y, x]) - (0, a, b, (a + b) // 2, near)[kind]) % 256
    return out


def lcs_length(a, b) -> int:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def glob_fits(glob: str, text: str) -> bool:
    parts = re.findall(r"\*\*|.", glob)
    pattern = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
    return re.fullmatch(pattern, text, re.S) is not None


def vector_links(rows, least: float):
    import numpy as np

    pairs = []
    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        m = np.array([r[1] for r in own], dtype=float)
        norms = np.linalg.norm(m, axis=1)
        x, y = np.nonzero(np.triu(m @ m.T / np.outer(norms, norms) >= least, 1))
        pairs += [(own[i][0], own[j][0]) for i, j in zip(x, y)]
    links = {r[0]: 0 for r in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    component = {i: min(c) for c in united(links, pairs) for i in c}
    return links, component


def language_regression(rows, order, counted):
    """id -> (label, score): TF-IDF rows by dictionaries, follow-the-regularised-leader over all classes, best of many temperatures."""
    import math

    text_of, label_of = {i: t for i, t, _ in rows}, {i: lang for i, _, lang in rows}
    names = sorted(set(label_of.values()))
    frequency: dict[int, int] = {}
    for i in text_of:
        for b in counted[i][0].tolist():
            frequency[b] = frequency.get(b, 0) + 1
    idf = {b: math.log((1 + len(rows)) / (1 + n)) + 1 for b, n in frequency.items()}
    value = {}
    for i in text_of:
        at, times = (x.tolist() for x in counted[i])
        value[i] = {b: math.log1p(n) / math.sqrt(sum(times)) * idf[b] for b, n in zip(at, times)} | {"bias": 1.0}
    z, n = {}, {}

    def weight(key):
        zk, nk = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(zk) <= 0.02 else -(zk - math.copysign(0.02, zk)) / ((1 + math.sqrt(nk)) / 0.1 + 0.01)

    def logits(i):
        return [sum(v * weight((b, c)) for b, v in value[i].items()) for c in names]

    def soft(x, t=1.0):
        e = [math.exp((v - max(x)) / t) for v in x]
        return [v / sum(e) for v in e]

    for _ in range(3):
        for k, i in enumerate(order):
            if k % 5 == 4:
                continue
            p = soft(logits(i))
            for c, pc in zip(names, p):
                slope = pc - (c == label_of[i])
                for b, v in value[i].items():
                    g, w, old = v * slope, weight((b, c)), n.get((b, c), 0.0)
                    z[b, c] = z.get((b, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / 0.1 * w
                    n[b, c] = old + g * g
    held = [(logits(i), names.index(label_of[i])) for k, i in enumerate(order) if k % 5 == 4]
    loss = lambda t: -sum(math.log(max(soft(x, t)[y], 1e-12)) for x, y in held) / len(held) + 1e-4 * math.log(t) ** 2
    heat = min((math.exp(math.log(0.05) + k * math.log(400) / 800) for k in range(801)), key=loss)
    out = {}
    for i in text_of:
        p = soft(logits(i), heat)
        out[i] = (names[p.index(max(p))], max(p))
    return out
