"""Plain Python versions of the operators, shared by the tests of this folder."""
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}


def slow_repeat(ws):
    wins = defaultdict(list)
    for i in range(len(ws) - 7):
        wins[tuple(ws[i:i + 8])].append(i)
    return len({p + k for at in wins.values() if len(at) > 1 for p in at for k in range(8)})


def slow_rules(text):
    t = text or ""
    ws = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), slow_repeat(ws))


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (s or ""))


def slow_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    seen, out = Counter(), Counter()
    for i, t in rows:
        k = low(t)
        first = i == keep[k] and not seen[i, k]
        seen[i, k] += i == keep[k]
        out[i, keep[k], len(groups[k]), first, hashlib.sha256(k.encode()).hexdigest()] += 1
    return out


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


class Sets:
    """Union-find over ids."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def slow_components(rows, n, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(AZ))
        sets.append((i, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    uf = Sets()
    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if i is not None and j is not None and s and 100 * len(s & t) >= percent * len(s | t):
                uf.join(i, j)
    return Counter((i, len(s), None if i is None else uf.find(i)) for i, s in sets)
