"""Plain versions of what the operators compute."""

import re


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def groups(keys, linked):
    """Smallest key of each key's component; linked(i, j) over positions."""
    label = list(range(len(keys)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(keys):
        r = root(i)
        least[r] = k if r not in least else min(least[r], k)
    return [least[root(i)] for i in range(len(keys))]


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?ai:", "(?i:"), re.ASCII)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def targets(sizes):
    """Shares by weight, again and again among the sources that are not at their limit."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[x] for x in capped)
        total = sum(weight[x] for x in names if x not in capped)
        share = {x: 3.0 * sizes[x] if x in capped else left * weight[x] / total for x in names}
        over = {x for x in names if x not in capped and share[x] > 3 * sizes[x]}
        if not over:
            return share
        capped |= over
