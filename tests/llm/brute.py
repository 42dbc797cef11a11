"""The operators' definitions in plain Python, for small tables."""

import itertools
import re


def line_dedup(docs, min_words=8):
    """docs: [(id, text)] with unique ids. {id: text} after later copies of runs of lines are deleted; None: dropped."""
    word = re.compile(r"[^ \t\r\f\v]+")
    seqs = {}
    for i, t in docs:
        if i is not None and t is not None:
            seqs[i] = [x.strip(" \t\r\f\v") for x in t.split("\n") if x.strip(" \t\r\f\v")]
    places = [(i, p) for i in sorted(seqs) for p in range(len(seqs[i]))]
    out = {}
    for i, t in docs:
        if i is None or t is None:
            out[i] = t
            continue
        own, gone = seqs[i], set()
        for p in range(len(own)):
            best = 0
            for j, q in places:
                if (j, q) >= (i, p):
                    break
                n = 0
                while p + n < len(own) and q + n < len(seqs[j]) and own[p + n] == seqs[j][q + n]:
                    n += 1
                best = max(best, n)
            if best and sum(len(word.findall(x)) for x in own[p : p + best]) >= min_words:
                gone |= set(range(p, p + best))
        if not gone:
            out[i] = t
            continue
        if len(gone) == len(own):
            out[i] = None
            continue
        kept, drop, k = [], False, 0
        for x in t.split("\n"):
            if x.strip(" \t\r\f\v"):
                drop, k = k in gone, k + 1
            if not drop:
                kept.append(x)
        out[i] = "\n".join(kept)
    return out


def shingles(text, n=3):
    w = [x for x in re.split(r"[ \t\n\r\f\v]+", (text or "").lower()) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_pairs(docs, threshold=0.6):
    """{(a, b): similarity} of ids a < b, from [(id, text)]."""
    rows = [(i, shingles(t)) for i, t in docs if i is not None]
    out = {}
    for (i, x), (j, y) in itertools.combinations([r for r in rows if r[1]], 2):
        if i != j and len(x & y) >= threshold * len(x | y) - 1e-9:
            key = (min(i, j), max(i, j))
            out[key] = max(out.get(key, 0), len(x & y) / len(x | y))
    return out


def groups(ids, pairs):
    """The least id of each id's group."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def best_fit_bins(lengths, capacity):
    """Number of bins of best fit by falling length."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)
