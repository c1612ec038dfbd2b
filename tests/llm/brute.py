"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    found |= windows[tuple(w[i:i + n])]
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def line_dedup(docs, size=50):
    """Every run of lines that is long enough, of whatever number of lines, is looked up."""
    first, rows = {}, []
    for doc, text in docs:
        lines = (text or "").split("\n")
        real = [i for i, line in enumerate(lines) if line.strip(" ")]
        found = [(real[a], real[b], tuple(lines[i] for i in real[a:b + 1])) for a in range(len(real)) for b in range(a, len(real))
                 if sum(len(lines[i].strip(" ")) for i in real[a:b + 1]) >= size]
        for a, _, key in found:
            first[key] = min(first.get(key, (doc, a)), (doc, a))
        rows.append((doc, lines, found))
    out = {}
    for doc, lines, found in rows:
        gone = {i for a, b, key in found if first[key] < (doc, a) for i in range(a, b + 1)}
        real = [i for i, line in enumerate(lines) if line.strip(" ")]
        gone |= {i for a, b in zip(real, real[1:]) if a in gone and b in gone for i in range(a, b)}  # blank lines between
        out[doc] = (len(lines), len(gone), "\n".join(line for i, line in enumerate(lines) if i not in gone))
    return out


def near_duplicates(docs, threshold=0.8):
    sets = []
    for doc, text in docs:
        w = words(text)
        sets.append((doc, frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    links, parent = collections.Counter(), {doc: doc for doc, _ in sets}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {doc: (top(doc), links[doc]) for doc, _ in sets}


def byte_dedup(docs, window=50):
    texts, first = sorted((d, (t or "").encode()) for d, t in docs), {}
    for doc, b in texts:
        for i in range(len(b) - window + 1):
            first.setdefault(b[i:i + window], doc)
    out = {}
    for doc, b in texts:
        gone = set()
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < doc:
                gone |= set(range(i, i + window))
        out[doc] = (len(b), len(gone), sum(i - 1 not in gone for i in gone), bytes(x for i, x in enumerate(b) if i not in gone))
    return out


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)
