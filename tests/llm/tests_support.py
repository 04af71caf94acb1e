"""Plain Python versions that tests compare with."""

import re
from itertools import combinations


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def classes(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = {i: i for i in range(len(sets))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, (_, a)), (j, (_, b)) in combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), d if not s else least.get(root(i))) for i, (d, s) in enumerate(sets)), key=str)
