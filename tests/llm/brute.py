"""Plain versions of the operators, one text or pair at a time."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_words(text):
    return ASCII_WORD.findall((text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def fingerprint(text, n=4):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    """Smallest place reachable from each place."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def least_ids(ids, roots):
    groups = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            groups[r] = min(i, groups.get(r, i))
    return [groups.get(r) for r in roots]


def repeats(texts, n):
    """(words, covered) of each text."""
    docs = [WORD.findall(t or "") for t in texts]
    seen = {}
    for w in docs:
        for i in range(len(w) - n + 1):
            key = tuple(w[i:i + n])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in docs:
        covered = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i:i + n])] > 1:
                covered[i:i + n] = [True] * n
        out.append((w, covered))
    return out


def contamination(text, items, n):
    """(n_words, n_hit, sorted item ids as strings)."""
    words, hit, found = ascii_words(text), set(), set()
    for item, body in items:
        w = ascii_words(body)
        wins = [w[i:i + n] for i in range(max(1, len(w) - n + 1))] if w else []
        for win in wins:
            for i in range(len(words) - len(win) + 1):
                if words[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


def licenses(text, phrases, templates, threshold):
    """(n_words, places, base labels, labels, score)."""
    words = ascii_words(text)
    places = [(i, v) for p, v in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    score = 1.0 if places else 0.0
    labels = {v for _, v in places}
    for label, notice in templates.items():
        want, width = set(notice.split()), math.ceil(len(notice.split()) / threshold - 1e-9)
        for i in range(max(1, len(words) - width + 1)):
            have = want & set(words[i:i + width])
            if len(have) >= max(1, math.ceil(threshold * len(want) - 1e-9)):
                labels.add(label)
                score = max(score, len(have) / len(want))
    return len(words), sorted(i for i, _ in places), sorted({v for _, v in places}), sorted(labels), score


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))


def url(u, rules):
    """(host, path, rule, verdict) or verdict None."""
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, None)
    return host, path, best[2], best[3]


def negatives(rows, anchors, config):
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); rows are (id, vector, label)."""
    good = [(i, [math.floor(config.scale * x) for x in v], c, k) for k, (i, v, c) in enumerate(rows)
            if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i)
    out = []
    for a in good:
        if not anchors(a[0]):
            continue
        scored = [(sum(x * y for x, y in zip(a[1], b[1], strict=True)), b) for b in good if b[3] != a[3] and len(b[1]) == len(a[1])]
        scored.sort(key=lambda x: (-x[0], last(x[1][0]), x[1][3]))
        for p, pos in [x for x in scored if x[1][2] == a[2]][:config.positives]:
            fits = [x for x in scored if x[1][2] != a[2] and config.low * p <= 100 * x[0] <= config.high * p]
            out += [(a[0], pos[0], k + 1, neg[0], p, s) for k, (s, neg) in enumerate(fits[:config.negatives])]
    return out


def ranked(docs, items, config):
    """Rows (item_id, rank, doc_id, score)."""
    words = [(i, ascii_words(t)) for i, t in docs]
    n_docs, n_words = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, w in words:
            score = 0
            for t in set(ascii_words(text)) & set(w):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - config.length_share + config.length_share * len(w) * n_docs // n_words
                score += weight * (10 ** 9 * w.count(t) // (1000 * w.count(t) + config.saturation * m))
            if score > 0:
                found.append((-score, i is None, i, score))
        out += [(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:config.k])]
    return out
