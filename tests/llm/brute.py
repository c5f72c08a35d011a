"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(nodes, links):
    of = {n: n for n in nodes}

    def root(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        of[y] = x
    return {n: root(n) for n in nodes}


def near_duplicates(docs, percent=85):
    """docs: id -> text.  id -> (size of the set, component)."""
    sets = {k: shingles(t) for k, t in docs.items()}
    where = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    both = {}
    for ks in where.values():
        for a, b in combinations(ks, 2):
            both[a, b] = both.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, links)
    return {k: (len(s), comp[k]) for k, s in sets.items()}


def repeated(docs, window=50):
    """docs: id -> text.  id -> (bytes, removed bytes, runs, digest of the rest)."""
    raw = {k: (t or "").encode() for k, t in sorted(docs.items())}
    first = {}
    for k, b in raw.items():
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], k)
    out = {}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < k:
                gone[i : i + window] = b"\1" * window
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[k] = (len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_secrets(text):
    text = text or ""
    a = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    b = [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    c = [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    rank = ["assign", "access", "hex"]
    spans = sorted(a + b + c, key=lambda x: (x[1], rank.index(x[0])))
    return len(a), len(b), len(c), sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """sizes: source -> words.  Targets by sharing the excess again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: most * sizes[s] for s in order}
    goal, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in goal]
        left = total - sum(goal.values())
        if not free:
            return goal
        want = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if want[s] > cap[s]]
        if not over:
            return goal | want
        goal |= {s: cap[s] for s in over}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u3000-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal_line(line):
    out = []
    for c in line:
        o = ord(c)
        out.append(lower(c) if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c if o >= 128 or "a" <= c <= "z" else " ")
    return UNSPACED.sub(r" \g<0> ", "".join(out)).split(" ")


def dedup_lines(docs, similarity=0.8, min_words=5, near=lambda a, b: True):
    """docs: id -> text.  id -> text without repeated lines; lines are linked when alike and ``near``."""
    seen = {}
    for k, t in sorted(docs.items()):
        for i, line in enumerate((t or "").split("\n")):
            w = tuple(x for x in normal_line(line) if x)
            if len(w) >= min_words:
                seen.setdefault(w, []).append((k, i))
    ws = list(seen)
    bags = [Counter(w) for w in ws]
    links = []
    for a, b in combinations(range(len(ws)), 2):
        x, y = ws[a], ws[b]
        longest = max(len(x), len(y))
        most = int((1 - similarity) * longest + 1e-9)
        if min(len(x), len(y)) < longest - most or (bags[a] & bags[b]).total() < longest - most:
            continue  # an edit changes one word of the longer line at most
        if near(x, y) and edits(x, y) <= (1 - similarity) * longest + 1e-9:
            links.append((a, b))
    comp = components(range(len(ws)), links)
    groups = {}
    for a, w in enumerate(ws):
        groups.setdefault(comp[a], []).extend(seen[w])
    gone = {x for g in groups.values() for x in g if x != min(g)}
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in docs.items()}
