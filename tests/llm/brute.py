"""Brute force that tests hold operators against."""

import re
from collections import Counter, defaultdict


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_groups(texts, percent=85):
    sets = {d: shingles(t) for d, t in texts.items()}
    holders, groups = defaultdict(list), Groups(sets)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in holders[x] if e > d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                groups.link(d, e)
    return sets, groups
