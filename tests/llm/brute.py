"""Plain-Python versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def jaccard_components(rows, width, percent):
    """rows: (doc_id, text) -> {doc_id: (set size, component)}."""
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in sets.items():
        common = Counter(j for x in s for j in holders[x] if j < i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def top_k(rows, every, k):
    """rows: (vec_id, components) -> [(query_id, rank, vec_id, score)] for ids divisible by `every`."""
    import math

    ints = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in ints:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def _pour(budget, children):
    """children: (name, weight, capacity) -> {name: share}. The level of the water is raised from child to child."""
    open_ = {n: (Fraction(w).limit_denominator(10**6), c) for n, w, c in children if w > 0 and c > 0}
    budget = min(budget, sum(c for _, c in open_.values()))
    out = {n: 0 for n, _, _ in children}
    while open_:
        level = Fraction(budget) / sum(w for w, _ in open_.values())
        full = {n for n, (w, c) in open_.items() if level * w >= c}
        if not full:
            exact = {n: level * w for n, (w, _) in open_.items()}
            out |= {n: int(x) for n, x in exact.items()}
            spare = budget - sum(int(x) for x in exact.values())
            for n in sorted(exact, key=lambda n: (int(exact[n]) - exact[n], n))[:spare]:
                out[n] += 1
            break
        for n in full:
            out[n] = open_.pop(n)[1]
            budget -= out[n]
    return out


def tree_budgets(tokens, weights, default, share, epochs):
    """{(domain, language, source): tokens there} -> {path: tokens to draw}."""
    tree = {}
    for (d, lang, s), n in tokens.items():
        tree.setdefault(d, {}).setdefault(lang, {})[s] = n

    def held(node):
        return epochs * node if isinstance(node, int) else sum(map(held, node.values()))

    def down(path, node, budget):
        if isinstance(node, int):
            return {path: budget}
        out = {}
        for name, n in _pour(budget, [(k, weights.get((*path, k), default), held(v)) for k, v in node.items()]).items():
            out |= down((*path, name), node[name], n)
        return out

    return down((), tree, int(share * sum(tokens.values())))
