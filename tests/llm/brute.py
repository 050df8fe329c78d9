"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def fingerprint(text, n=3):
    w = (text or "").translate(FOLD).encode().split()
    grams = [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def components(fps, bits=2):
    """[(id, fp)] -> {id: smallest id reachable}"""
    ids = sorted({i for i, _ in fps if i is not None})
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for n, (a, fa) in enumerate(fps):
        for b, fb in fps[n + 1:]:
            if a is not None and b is not None and (fa ^ fb).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def spans(docs, length):
    """[text bytes] -> [(removed, runs, kept)]"""
    c = Counter(b[i:i + length] for b in docs for i in range(len(b) - length + 1))
    out = []
    for b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if c[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def contamination(texts, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k:k + n])].add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k:k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def line_dedup(docs, min_chars=40, min_docs=5):
    """[(id, text)] -> [(lines, dropped, text)]"""
    def key(line):
        return line.strip(WS).translate(FOLD)
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    owner = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or owner.get(key(x), d) == d]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def base_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if x.strip(WS)]
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = set()
    for i in range(len(w) - 7):
        if c[tuple(w[i:i + 8])] > 1:
            again.update(range(i, i + 8))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)),
            len(lines) - len(set(lines)), len(again),
            len(w) < 20 or 100 * len(again) > 30 * len(w))
