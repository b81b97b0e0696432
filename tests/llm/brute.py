"""Plain single-process versions of the operators, for comparison."""

import hashlib
import re
import zlib

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def alnum_words(text):
    return ALNUM.findall((text or "").encode().lower())


def space_words(text):
    return (text or "").encode().split()


def contamination(docs, items, n=10):
    windows = {}
    for item_id, text in items:
        w = alnum_words(text)
        if item_id is None or not w:
            continue
        for i in range(max(1, len(w) - n + 1)):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item_id)
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w = alnum_words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                ids = windows.get(tuple(w[i:i + size]))
                if ids:
                    hit.update(range(i, i + size))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def repeated_words(docs, n=50):
    first = {}
    for doc_id, text in docs:
        w = space_words(text)
        for i in range(len(w) - n + 1):
            k = tuple(w[i:i + n])
            first[k] = min(first.get(k, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        w = space_words(text)
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < doc_id:
                gone.update(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_bytes(docs, n=100):
    first = {}
    for doc_id, text in docs:
        b = (text or "").encode()
        for i in range(len(b) - n + 1):
            k = b[i:i + n]
            first[k] = min(first.get(k, (doc_id, i)), (doc_id, i))
    out = []
    for doc_id, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i:i + n]] < (doc_id, i):
                gone[i:i + n] = b"\x01" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def pieces(docs, tokenizer, capacity=2048):
    out = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            p = ids[start:start + capacity]
            out.append((doc_id, k, start, len(p), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p))))
    return out


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard_components(docs, n=3, percent=90):
    """(doc_id, set size, component) for unique doc_ids; all pairs are compared."""
    docs = sorted(docs)
    sets = []
    for _, text in docs:
        w = space_words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = components(len(sets), links)
    return [(docs[i][0], len(sets[i]), docs[comp[i]][0]) for i in range(len(docs))]
