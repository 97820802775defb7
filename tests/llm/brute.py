"""Plain versions of the contracts, over lists of (id, text)."""

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def substring(docs, length=20):
    seen, out = {}, {}
    for i, text in sorted(docs):
        w, hit = SPACED.findall(text or ""), set()
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if key in seen:
                hit.update(range(s, s + length))
            seen.setdefault(key, 1)
        kept = " ".join(x for j, x in enumerate(w) if j not in hit)
        out[i] = (len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest())
    return out


def contamination(docs, items, window=13):
    windows = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(i)
    out = []
    for i, text in docs:
        w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                key = tuple(w[s : s + n])
                if key in windows:
                    hit.update(range(s, s + n))
                    found |= windows[key]
        out.append((i, len(w), len(hit), sorted(found, key=str)))
    return out


def near(docs, length, percent):
    """(id, n_shingles, component) of each document, ids unique."""
    sets = []
    for _, text in docs:
        w = SPACED.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + length]) for i in range(len(w) - length + 1)} if len(w) >= length else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = len(a & b)
            if a and b and 100 * shared >= percent * (len(a) + len(b) - shared):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs)}


def licenses(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        places += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))
