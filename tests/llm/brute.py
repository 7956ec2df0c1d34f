"""Plain counterparts of the operators, for small inputs."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW) if lower else text)


def shingles(text, size=5):
    w = words(text, True)
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([tuple(w)] if w else [])


def components(nodes, links):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(docs, percent=75):
    sets = collections.defaultdict(list)
    for i, t in docs:
        if i is not None:
            sets[i].append(set(shingles(t)))
    links = [(a, b) for a in sets for b in sets if a < b and any(s & t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b])]
    return components(sets, links)


def windows_removed(docs, window=50):
    first, found = {}, [(i, words(t)) for i, t in docs]
    for i, w in found:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in found:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def bytes_removed(docs, window=200):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = collections.Counter(t[p : p + window] for _, t in texts for p in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def contaminated(docs, items, similarity=0.75):
    out = {}
    for d, text in docs:
        w = words(text, True)
        for i, t in items:
            v = words(t, True)
            if not v:
                continue
            size = min(5, len(v))
            bag = collections.Counter(tuple(v[k : k + size]) for k in range(len(v) - size + 1))
            s = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
            n = len(v) - size + 1
            for start in range(max(1, len(s) - n + 1)):
                part = collections.Counter(s[start : start + n])
                shared = sum((part & bag).values())
                if shared and shared / (sum(part.values()) + sum(bag.values()) - shared) >= similarity:
                    out[d, i] = max(out.get((d, i), 0), shared / (sum(part.values()) + sum(bag.values()) - shared))
    return out


def vector_links(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = collections.Counter()
    links = []
    for k, (i, x) in enumerate(good):
        for j, (b, y) in enumerate(good):
            if k != j and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                near[i] += 1
                links.append((i, b))
    return near, components({i for i, _ in rows if i is not None}, links)


def audit(docs, labels):
    """(part, order, step) -> kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    first = {}
    for d, _, t in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for d, source, t in docs:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        rows.append((source or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out, total = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[part, f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def hard_negatives(rows, every=100):
    """All rows (anchor, positive, rank, negative, both scores); rows are (vec_id, label, vector)."""
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    tie = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (anchor, label, v) in enumerate(whole):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, other == label) for b, (i, other, w) in enumerate(whole) if a != b and len(v) == len(w)]
        for ps, positive, _ in sorted((s for s in scored if s[2]), key=tie)[:5]:
            hard = sorted((s for s in scored if not s[2] and 80 * ps <= 100 * s[0] <= 100 * ps), key=tie)[:5]
            out += [(anchor, positive, rank, i, ps, ns) for rank, (ns, i, _) in enumerate(hard, 1)]
    return out


def walk_ring(counts, nodes, shards):
    """Shard of each row (position, rank) with bounded loads, and the loads: rows walk clockwise one by one.

    Of a shard's own rows, the first in ring order stay, up to its bound; then the others walk from their node, those that have
    walked longest first, until a node's shard has room. Rows beyond the mean are allowed to the shards with most own rows.
    """
    home = {p: next((i for i, (at, _) in enumerate(nodes) if at >= p), 0) for p in counts}
    own = {s: sum(n for p, n in counts.items() if nodes[home[p]][1] == s) for s in range(shards)}
    total = sum(counts.values())
    bound = {s: total // shards for s in range(shards)}
    for s in sorted(bound, key=lambda s: (-own[s], s))[: total % shards]:
        bound[s] += 1
    ranked = sorted(((home[p], p, k) for p, n in counts.items() for k in range(n)))
    load, placed, waiting = dict.fromkeys(bound, 0), {}, {}
    for node, p, k in ranked:
        s = nodes[node][1]
        if load[s] < bound[s]:
            load[s] += 1
            placed[p, k] = s
        else:
            waiting.setdefault(node, []).append((p, k))
    walking = []
    for step in range(2 * len(nodes)):
        node = step % len(nodes)
        s = nodes[node][1]
        walking += waiting.pop(node, [])
        while walking and load[s] < bound[s]:
            load[s] += 1
            placed[walking.pop(0)] = s
    return placed, load
