"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = "[\x20\x09-\x0d]"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text or ""))


def exact(rows):
    """rows: (doc_id, text)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(BLANK, "", t or "")].append((-len(t or ""), d))
    out = []
    for d, t in rows:
        plain = re.sub(BLANK, "", t or "")
        size, best = min(groups[plain])
        out.append((d, best, len(groups[plain]), (size, best) == (-len(t or ""), d), sha(plain)))
    return sorted(out)


def lines(rows, least=10):
    def key(line):
        return low(re.sub(f"^{BLANK}+|{BLANK}+$", "", line))

    owner = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                owner[key(line)] = min(d, owner.get(key(line), d))
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if owner.get(key(x), d) == d]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out)


def contamination(docs, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                owners = windows.get(tuple(w[k : k + size]))
                if owners:
                    hit.update(range(k, k + size))
                    found |= owners
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def near(rows, width=5, up=4, down=5):
    sets = {}
    for d, t in rows:
        w = words(t)
        n = min(width, len(w))
        sets[d] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset([("alone", d)])
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    reps = sorted(first.values())
    links = {r: {o for o in reps if o != r and down * len(sets[r] & sets[o]) >= up * len(sets[r] | sets[o])} for r in reps}
    head = {}
    for r in reps:
        todo, seen = [r], {r}
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        head[r] = min(seen)
    count = Counter(first[s] for s in sets.values())
    return sorted((d, first[s], count[first[s]], head[first[s]], len(links[first[s]])) for d, s in sets.items())


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 16


def kneser_ney(labelled, order=6, discount=0.75, piece=32):
    """text -> (largest expression, whole document) under models of (text, toxic) rows."""
    top = (Counter(), Counter())
    for t, c in labelled:
        for w in words(t):
            s = b"^" + w.encode() + b"$"
            for i in range(1, len(s)):
                top[c][s[max(0, i - order + 1) : i + 1]] += 1
    full = set(top[0]) | set(top[1])
    levels, layer = {}, {g for g in full if len(g) == order}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in layer)
        layer = set(levels[n]) | {g for g in full if len(g) == n}

    def shared(g):
        if not g:
            return 1 / 256
        same = [x for x in levels[len(g)] if x[:-1] == g[:-1]]
        total = sum(levels[len(g)][x] for x in same)
        return max(levels[len(g)][g] - discount, 0) / total + discount * len(same) / total * shared(g[1:])

    def one(c, g):
        same = [x for x in top[c] if x[:-1] == g[:-1]]
        total = sum(top[c][x] for x in same)
        if not total:
            return 0.0, 1.0
        return max(top[c][g] - discount, 0) / total, discount * len(same) / total

    memo = {}

    def difference(g):
        if g not in memo:
            (a, x), (b, y) = one(1, g), one(0, g)
            memo[g] = math.log((a + x * shared(g[1:])) / (b + y * shared(g[1:]))) if g in full else math.log(x / y)
        return memo[g]

    def features(text):
        most, total, length = 0.0, 0.0, 0
        for w in words(text):
            s = b"^" + w.encode() + b"$"
            values = [difference(s[max(0, i - order + 1) : i + 1]) for i in range(1, len(s))]
            for k in range(0, len(values), piece):
                part = values[k : k + piece]
                most = max(most, sum(part) / len(part))
            total += sum(values)
            length += len(values)
        return most, total / length if length else 0.0

    return features
