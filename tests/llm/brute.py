"""Plain Python versions of the training-data queries, from their stated contracts."""

import collections
import hashlib
import math
import re

import numpy as np
import regex

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def order(doc_id):
    return -math.inf if doc_id is None else doc_id


def held_out(doc_id):
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def op1(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return out


def op2(rows, longest=4):
    """(doc_id, held_out, lang, score) with every word and n-gram known, so for small tables."""
    letters = regex.compile(r"\p{L}+")
    split = lambda t: letters.findall((t or "").lower())
    pieces = lambda w: [f"^{w}$"[i : i + n] for n in range(1, longest + 1) for i in range(len(w) + 3 - n)]
    words, grams = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if not held_out(i) and lang is not None:
            for w in split(t):
                words[lang][w] += 1
                grams[lang].update(pieces(w))
    langs = sorted(words)

    def logs(counts):
        known = sorted({w for c in counts.values() for w in c})
        total = np.array([sum(counts[x].values()) for x in langs], float)
        return {w: np.log((np.array([counts[x][w] for x in langs]) + 0.5) / (total + 0.5 * max(len(known), 1))) for w in known}

    words, grams = logs(words), logs(grams)

    def one(w):
        if w in words:
            return words[w]
        for n in range(longest, 0, -1):
            found = [grams[g] for g in (f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)) if g in grams]
            if found:
                return np.mean(found, 0)
        return np.zeros(len(langs))

    out = []
    for i, t, _ in rows:
        own = split(t)
        if not own or not langs:
            out.append((i, held_out(i), "und", 0.0))
            continue
        total = np.sum([one(w) for w in own], 0)
        best = int(total.argmax())
        out.append((i, held_out(i), langs[best], float(1 / np.exp(total - total[best]).sum())))
    return out


def op3(rows):
    out = []
    for i, t in rows:
        found = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in re.finditer(p, t or "") if len(m.group(g)) >= n)
        text = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in found)
        out.append((i, *(sum(k == n for _, k, _ in found) for n in range(3)), sha(text.encode())))
    return out


def op4(rows, length=50):
    words = [(i, SPACE_WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: order(x[0])):
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), order(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < order(i):
                gone[s : s + length] = [True] * length
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out


def shingles(text, k, lower=True):
    w = SPACE_WORD.findall((text or "").translate(LOWER) if lower else text or "")
    return {tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def op5(rows):
    """(n_chars, edited_sha256, likeness to the edited text, to the next one) by position, for distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: order(r[0]))
    kinds = lambda t: shingles(t, 5, False) or {("",)}
    out = {}
    for n, (i, t) in enumerate(rows):
        nxt, half = rows[(n + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        out[i] = (len(t), sha(edited.encode()), jaccard(kinds(t), kinds(edited)), jaccard(kinds(t), kinds(nxt)))
    return out


def kept_lines(rows, least=20, docs=3):
    """Each row's lines and whether each goes."""
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(order(i))
    bad = {k: max(v) for k, v in holders.items() if len(k) >= least and len(v) >= docs}
    return [[(x, bad.get(key(x), order(i)) != order(i)) for x in (t or "").split("\n")] for i, t in rows]


def op7(rows):
    return [(i, len(ls), sum(g for _, g in ls), sha("\n".join(x for x, g in ls if not g).encode())) for (i, _), ls in zip(rows, kept_lines(rows), strict=True)]


def components(rows, k, percent=80):
    """(sets, root row of each row): exact links of all pairs, joined."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return sets, [find(x) for x in range(len(rows))]


def op9(rows):
    sets, root = components(rows, 4)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, math.inf), order(i))
    best = [least[r] for r in root]
    return [(i, len(s), None if b == -math.inf else b, order(i) == b) for (i, _), s, b in zip(rows, sets, best, strict=True)]


def op10(rows, bench, size=10):
    held = collections.defaultdict(set)
    for item, t in bench:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - size + 1)) if w else ():
            held[tuple(w[s : s + size])].add(item)
    sizes = {len(w) for w in held}
    out = []
    for i, t in rows:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        hit, items = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (found := held.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    items |= found
        names = sorted({str(x) for x in items if x is not None})
        out.append((i, len(w), len(hit), len(names), sha(",".join(names).encode()), bool(hit)))
    return out
