"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def substring_dedup(docs, width=35):
    split = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(docs, split):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), sha(kept.encode())))
    return out


def suffix_dedup(docs, length=50):
    first = {}
    order = lambda i: 2**63 - 1 if i is None else i
    for doc_id, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            first[key] = min(first.get(key, order(doc_id)), order(doc_id))
    out = []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < order(doc_id):
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), runs, sha(kept)))
    return out


def jaccard_groups(docs, k=4, num=85, den=100):
    sets = []
    for doc_id, text in docs:
        w = [re.sub(r"[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}
        sets.append((doc_id, grams if w else set()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(i)
    pairs = Counter((a, b) for h in holders.values() for x, a in enumerate(h) for b in h[x + 1 :])
    for (a, b), both in pairs.items():
        if den * both >= num * (len(sets[a][1]) + len(sets[b][1]) - both):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[root(i)].append(i)
    low = {}
    for g in groups.values():
        ids = [sets[i][0] for i in g if sets[i][0] is not None]
        for i in g:
            low[i] = min(ids) if ids else None
    return [(d, len(s), low[i]) for i, (d, s) in enumerate(sets)]


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)


def base_secrets(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)
