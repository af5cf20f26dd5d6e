"""Near-duplicate components by exact comparison of all pairs that share a rare shingle (prefix filter, no hashing)."""

from collections import Counter, defaultdict


def near_components(rows, words, percent):
    """{doc_id: (set size, smallest reachable id)} for (doc_id, text) rows with distinct ids."""
    parent, size, classes = {}, {}, {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    for i, text in rows:
        parent[i] = i
        w = (text or "").encode().lower().split()
        s = frozenset(b" ".join(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()
        size[i] = len(s)
        if s:
            classes.setdefault(s, []).append(i)
    for same in classes.values():
        for x in same[1:]:
            join(same[0], x)
    sets = [(m[0], s) for s, m in classes.items()]
    common = Counter(x for _, s in sets for x in s)
    listed = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        order = sorted(s, key=lambda x: (common[x], x))
        seen = set()
        for x in order[: len(order) + (-len(order) * percent // 100) + 1]:
            for j in listed[x]:
                if j not in seen:
                    seen.add(j)
                    t = sets[j][1]
                    c = len(s & t)
                    if 100 * c >= percent * (len(s) + len(t) - c):
                        join(i, sets[j][0])
            listed[x].append(k)
    return {i: (size[i], find(i)) for i, _ in rows}
