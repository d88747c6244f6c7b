"""Brute-force versions of the operators' contracts, over lists of (doc_id, text)."""

import hashlib
import re

import numpy as np
import xxhash


def low(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def sha(data):
    return hashlib.sha256(data).hexdigest()


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), n, kind, m.end()) for n, (kind, r) in enumerate(PII.items()) for m in re.finditer(r, text or "") if good(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def repeated_words(docs):
    first, out = {}, {}
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    for d, t in docs:
        w = split(t)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    for d, t in docs:
        w = split(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = True
        out[d] = (len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def repeated_bytes(docs):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def contamination(docs, items):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[j : j + n]), set()).add(item)
    out = {}
    for d, t in docs:
        w = split(t)
        hit, found = np.zeros(len(w), bool), set()
        for n, m in windows.items():
            for j in range(len(w) - n + 1):
                if s := m.get(tuple(w[j : j + n])):
                    hit[j : j + n] = True
                    found |= s
        k = int(hit.sum())
        out[d] = (len(w), k, len(found), sha(",".join(sorted(map(str, found))).encode()), k > 0 and 20 * k >= len(w))
    return out


def simhash(docs, near=3):
    prints = {}
    for d, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", low(t))
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[d] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= near:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}
