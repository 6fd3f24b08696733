"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i + 65: i + 97 for i in range(26)}
SPACE = " \t\n\x0b\x0c\r"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near(docs, size, percent=80):
    """doc_id -> (shingles, smallest id of its group)"""
    sets = {i: shingle_set(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def passages(docs, length=100):
    """doc_id -> (bytes, removed, spans, kept bytes)"""
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def lines(docs, min_chars=20, min_docs=3):
    """doc_id -> (lines, dropped, kept text)"""
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(SPACE).translate(LOWER)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = {}
    for i, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if last.get(key(x), i) == i]
        out[i] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


def measures(text):
    x = text or ""
    w = WORD.findall(x)
    three = collections.Counter(zip(w, w[1:], w[2:]))
    again = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in x), "n_dup_lines": dup, "n_repeat_words": len(again)}


def quality(rows, line_docs=20, left_percent=20):
    """For each of the rows (doc_id, text, host): base_failed, kept, words of removed lines, text without them."""
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(SPACE).translate(LOWER)
    for i, t, h in rows:
        for x in (t or "").split("\n"):
            if WORD.search(x) and i is not None:
                holders[h, key(x)].add(i)
    out = []
    for i, t, h in rows:
        m = measures(t)
        failed = m["n_words"] < 50 or m["n_repeat_words"] * 100 > m["n_words"] * 50
        kept, gone = [], 0
        for x in (t or "").split("\n"):
            ids = holders.get((h, key(x)), ())
            if i is not None and WORD.search(x) and len(ids) > line_docs and min(ids) != i:
                gone += len(WORD.findall(x))
            else:
                kept.append(x)
        out.append((failed, not failed and (m["n_words"] - gone) * 100 >= m["n_words"] * left_percent, gone, "\n".join(kept)))
    return out


def code_length(texts, text, order=3):
    """Bits of a text by prediction by partial matching, method C, frozen after ``texts``: bytes one by one, with dictionaries."""
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        raw = b"\n" * order + t.encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                counts[raw[i - k : i]][raw[i]] += 1
    total, raw = 0.0, b"\n" * order + text.encode()
    for i in range(order, len(raw)):
        p = 1.0
        for k in range(order, -1, -1):
            seen = counts.get(raw[i - k : i])
            if seen and raw[i] in seen:
                p *= seen[raw[i]] / (sum(seen.values()) + len(seen))
                break
            if seen:
                p *= len(seen) / (sum(seen.values()) + len(seen))
        else:
            p /= 256
        total -= math.log2(p)
    return total


def spellings(docs):
    """Rows (word, form, root, n, n_near, form_n): every word beside every other that one edit of it may give."""
    n = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}
    gaps = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            gaps[w[:k] + w[k + 1 :], k].add(w)
    near = {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            near[w] |= gaps[short, k] - {w}
            if short in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]
