"""Plain single-machine versions of the operators, to hold their results against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_Z = {c: c + 32 for c in range(65, 91)}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def token_rows(docs, encode):
    out, at = [], 0
    for d, t in sorted(docs):
        ids = [*encode(t or ""), 0]
        out.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def decontaminated(docs, items, size=10):
    pats = defaultdict(set)
    for name, t in items:
        w = WORD.findall((t or "").translate(A_Z))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            pats[tuple(w[i : i + size])].add(str(name))
    sizes = sorted({len(p) for p in pats})
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(A_Z))
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in pats:
                    hit.update(range(i, i + n))
                    names |= pats[p]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def exact(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    return sorted((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)


def simhash(text, size=4, seed=42):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), seed) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def component_of(nodes, links):
    """node -> smallest node that links reach."""
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_groups(docs, radius=4):
    fps = [(d, simhash(t)) for d, t in docs]
    a = np.array([f for _, f in fps], np.uint64)
    links = []
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius).tolist():
            links.append((fps[i][0], fps[i + 1 + j][0]))
    root = component_of([d for d, _ in fps], links)
    return sorted((d, f"{f:016x}", root[d]) for d, f in fps)


def chats(rows):
    convs = defaultdict(list)
    for c, n, r, t in rows:
        convs[c].append((n, r, t or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(A_Z), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def url_rule(url):
    host, path = url_parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def neighbours(a, b):
    """Edit distance of at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :] or a == b


def unigram(docs, train):
    """(n_tokens, n_known, N, base score) of each document."""
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(A_Z)), None]
    c = Counter(w for d, t in docs if train(d) for w in split(t))
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in docs:
        w = split(t)
        out[d] = (len(w), sum(c[x] > 0 for x in w), n, sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    return out


def language_sets(labelled, keep=20_000, least=3, size=4):
    """Per language the set of its commonest byte n-grams, by plain counting; and the most frequent language."""
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in labelled:
        if lang is not None:
            sizes[lang] += 1
            counts[lang].update(language_grams(text, size))
    top = {}
    for lang, c in counts.items():
        rows = sorted(((-n, int.from_bytes(g, "little"), g) for g, n in c.items() if n >= least))
        top[lang] = {g for _, _, g in rows[:keep]}
    for lang in sizes:
        top.setdefault(lang, set())
    return top, max(sorted(sizes), key=lambda x: sizes[x], default=None)


def language_grams(text, size=4):
    """n-grams of bytes of a text between blanks; what is no letter is a blank, and none spans two blanks."""
    raw = b" " + (text or "").encode().lower() + b" " * size
    raw = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in raw)
    return [g for k in range(len(raw) - size + 1) if b"  " not in (g := raw[k : k + size])]


def language(text, sets, default):
    """(language, score) with exact sets."""
    if not sets or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    g = language_grams(text)
    share = {lang: sum(x in s for x in g) / max(1, len(g)) for lang, s in sorted(sets.items())}
    best = max(share, key=lambda x: share[x])
    return (best, share[best]) if share[best] > 0 else (default, 0.0)
