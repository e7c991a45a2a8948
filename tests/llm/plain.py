"""Brute-force versions that the operators are compared with."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile("[^ \t-\r]+")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append((kind, m.start(), m.end()))
    return spans


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(texts, window=50):
    """{doc_id: (n_words, n_removed, kept_sha256)} from {doc_id: text}."""
    words = {d: WORD.findall(t or "") for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i:i + window]), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i:i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))
    return out


def aligned_share(a, b, size=5):
    """Common subsequence of word runs over all runs, by the textbook table."""
    x, y = [tuple(a[i:i + size]) for i in range(len(a) - size + 1)], [tuple(b[i:i + size]) for i in range(len(b) - size + 1)]
    row = [0] * (len(y) + 1)
    for u in x:
        last = 0
        for j, v in enumerate(y):
            last, row[j + 1] = row[j + 1], last + 1 if u == v else max(row[j + 1], row[j])
    return row[-1] / max(1, len(x) + len(y) - row[-1])


def most_aligned(a, b, size=5):
    """No pair aligns more than this: runs of words in both, in any order, over all runs."""
    x, y = (Counter(tuple(t[i:i + size]) for i in range(len(t) - size + 1)) for t in (a, b))
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def near_classes(texts, enough=0.8):
    """Classes by aligning every pair that counts of runs do not rule out."""
    words = {d: tuple(WORD.findall(t or "")) for d, t in texts.items()}
    root = {d: d for d in words}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(words)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n, m = sorted((len(words[a]) - 4, len(words[b]) - 4))
            same = words[a] == words[b]
            near = n > 0 and n >= enough * m and most_aligned(words[a], words[b]) >= enough
            if same or near and aligned_share(words[a], words[b]) >= enough:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in ids}


def crc_of_ids(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
