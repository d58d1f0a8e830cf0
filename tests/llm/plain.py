"""Plain versions of the operators, one text at a time."""

import collections
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, size):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(texts, size, percent):
    """texts: {id: text}. Compares all pairs."""
    sets = {d: shingle_set(t, size) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def stripped(texts, window):
    """texts: list. Kept words of each."""
    seen = collections.Counter(tuple(w[i : i + window]) for w in map(words, texts) for i in range(len(w) - window + 1))
    out = []
    for w in map(words, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def near_lines(texts, least, distance):
    """texts: {id: text}; {(id, line): kept (id, line)}. From the earliest line on, one goes if a near line was kept."""
    lines = [(d, i, tuple(words(x))) for d, t in sorted(texts.items()) for i, x in enumerate((t or "").split("\n")) if words(x)]
    first = {}
    for d, i, w in lines:
        first.setdefault(w, (d, i))
    best, kept = {}, []
    for x, place in sorted(first.items(), key=lambda one: one[1]):
        near = [first[y] for y in kept if min(len(x), len(y)) >= least and distance(list(x), list(y)) < 2]
        best[x] = min(near, default=place)
        if not near:
            kept.append(x)
    return {(d, i): best[w] for d, i, w in lines if best[w] != (d, i)}


def base_counts(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(again)


def tiles(text, item, seed):
    """Greedy string tiling of two lists of words: (words covered, tiles)."""
    free_t, free_p = [True] * len(text), [True] * len(item)
    covered = count = 0
    while True:
        best = (0, 0, 0)
        for x in range(len(text)):
            for y in range(len(item)):
                n = 0
                while x + n < len(text) and y + n < len(item) and text[x + n] == item[y + n] and free_t[x + n] and free_p[y + n]:
                    n += 1
                best = max(best, (n, -x, -y))
        n, x, y = best[0], -best[1], -best[2]
        if n < seed:
            return covered, count
        free_t[x : x + n] = [False] * n
        free_p[y : y + n] = [False] * n
        covered, count = covered + n, count + 1
