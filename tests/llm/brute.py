"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def words(text):
    return (text or "").encode().split()


def components(rows, width, num, den):
    """{row number: smallest id reachable} of (id, text) rows; None for null ids."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width
                    else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None \
                    and (rows[i][0] == rows[j][0] or den * len(a & b) >= num * len(a | b)):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return [(doc, len(sets[i]), None if doc is None else min(least[find(i)])) for i, (doc, _) in enumerate(rows)]


def repeats_removed(rows, window):
    starts = defaultdict(list)
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            if doc is not None:
                starts[tuple(w[i:i + window])].append(doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and min(starts[tuple(w[i:i + window])]) < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x.decode() for i, x in enumerate(w) if i not in gone)))
    return out


def lines_deleted(rows, min_lines, min_words):
    """Texts of (id, text) rows of distinct ids, without later copies of repeated runs."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    kept_lines = {i: [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate((rows[i][1] or "").split("\n"))
                      if x.strip(" \t\n\x0b\x0c\r")] for i in order}
    seen, gone = set(), defaultdict(set)
    for size in {1, min_lines}:
        for i in order:
            run = kept_lines[i]
            for a in range(len(run) - size + 1):
                key = tuple(x for _, x in run[a:a + size])
                if size < min_lines and len(words(key[0])) < min_words:
                    continue
                if (size, key) in seen:
                    gone[i].update(k for k, _ in run[a:a + size])
                seen.add((size, key))
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
            for i, (_, t) in enumerate(rows)]


def top(vectors, queries, k):
    held = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for q, a in queries:
        found = sorted((-held(sum(x * y for x, y in zip(a, b, strict=True))), i)
                       for i, b in vectors if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def pfair(slots):
    """Sources slot by slot, earliest deadline first, of {source: slots a frame}."""
    frame, used, plan = sum(slots.values()), dict.fromkeys(slots, 0), []
    for t in range(frame):
        due = [(-(-(used[s] + 1) * frame // m), s) for s, m in sorted(slots.items())
               if used[s] < m and used[s] * frame // m <= t]
        plan.append(min(due)[1])
        used[plan[-1]] += 1
    return plan


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
