"""Plain single-machine versions of the corpus operators, straight from their definitions."""

import hashlib
import re
from collections import defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def low(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def op1(docs, length=100):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            if k in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(k)
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, r in zip(b, gone) if not r))))
    return out


def op4(docs):
    holders, lines = defaultdict(set), {}
    key = lambda line: low(line.strip(SPACE))
    for i, t in docs:
        lines[i] = (t or "").split("\n")
        for line in lines[i]:
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, own in sorted(lines.items()):
        stay = [x for x in own if not (len(h := holders.get(key(x), ())) >= 3 and max(h) != i)]
        out.append((i, len(own), len(own) - len(stay), sha("\n".join(stay))))
    return out


def simhash(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def op5(docs):
    docs = sorted(docs, key=lambda d: d[0])
    prints = [simhash(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(i, f"{p:016x}", docs[find(k)][0]) for k, ((i, _), p) in enumerate(zip(docs, prints))]


def op7(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in docs}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    return [(i, min(groups[t]), len(groups[t]), i == min(groups[t]), sha(t)) for i, t in sorted(norm.items())]


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def op9_base(t):
    t = t or ""
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s)]


def op10(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = []
    for i, t in sorted(docs, key=lambda d: d[0]):
        w, hit, found = word.findall(low(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def near_groups(docs):
    """(doc_id, smallest doc_id of its group) by all pairs with a Jaccard similarity of 0.8 or more on five-word shingles."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    of = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and of[a] != of[b] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                low, high = sorted((of[a], of[b]))
                of = {i: low if c == high else c for i, c in of.items()}
    return sorted(of.items())
