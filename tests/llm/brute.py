"""Brute-force versions of the operators, in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

LETTERS = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate(LETTERS)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, n=3):
    words = WORD.findall(lower(text))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def jaccard(docs, n=3, percent=90):
    """doc_id -> (n_shingles, component_id)"""
    sets = {d: shingles(t, n) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    parts = components(ids, links)
    return {d: (len(sets[d]), parts[d]) for d in ids}


def decontaminate(docs, bench):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)"""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in bench:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k:k + n])].add(item)
    out = {}
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k:k + n]))):
                    items |= found
                    hit |= set(range(k, k + n))
        out[doc] = (len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit))
    return out


def luhn(s):
    digits = [int(c) for c in s if c in "0123456789"]
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return 12 <= len(digits) <= 19 and total % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def pii(text):
    """n_email, n_ip, n_card, n_phone, base_sha256"""
    found = [(m.start(), k, m.end(), name) for k, (name, pattern, good) in enumerate(KINDS)
             for m in re.finditer(pattern, text or "") if good(m.group())]
    listed = ",".join(f"{name}:{start}:{end}" for start, _, end, name in sorted(found))
    return (*(sum(f[1] == k for f in found) for k in range(4)), sha(listed))


def suffix_dedup(docs, span=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)"""
    texts = sorted((d, (t or "").encode()) for d, t in docs)
    first = {}
    for d, b in texts:
        for i in range(len(b) - span + 1):
            first.setdefault(b[i:i + span], d)
    out = {}
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i:i + span]] < d:
                gone[i:i + span] = b"\x01" * span
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out
