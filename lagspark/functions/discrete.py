"""Symbol sequences: Lempel-Ziv phrases. Entropies of counts are DataFrame aggregates."""

from __future__ import annotations

import math


def lempel_ziv(sequence, normalise: bool = False) -> float:
    """Phrases of the 1976 parsing: each is the shortest not yet seen in what comes before its end."""
    codes = {}
    s = [codes.setdefault(x, len(codes)) for x in sequence]
    n = len(s)
    if not n:
        return 0.0
    # A suffix automaton of all but the phrase's last symbol answers 'seen before' as it grows.
    nexts, link, length = [{}], [-1], [0]
    last = 0

    def extend(c: int) -> None:
        nonlocal last
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur

    phrases, i = 0, 0
    while i < n:
        state, j = 0, i
        while j < n and s[j] in nexts[state]:
            state = nexts[state][s[j]]
            extend(s[j])
            j += 1
        phrases += 1
        if j < n:
            extend(s[j])
        i = j + 1
    return phrases * math.log(n, max(2, len(codes))) / n if normalise and n > 1 else float(phrases)
