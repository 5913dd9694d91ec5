"""Plain Python versions of the operators' results, for small inputs."""

import hashlib
import math
import re
import struct
import zlib

import xxhash

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return WORDS.findall((text or "").encode().lower())


def decontaminated(docs, items, window=13):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)} of [(doc_id, text)], [(item_id, text)]."""
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(k) for k in wanted}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wanted:
                    hit.update(range(i, i + n))
                    found |= wanted[k]
        names = ",".join(sorted(found))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def licensed(text, phrases):
    """(n_words, n_base, first_word, last_word, base_labels)."""
    w, at, labels = [x.decode() for x in words(text)], [], set()
    for phrase, label in phrases:
        p = phrase.split()
        got = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += got
        labels |= {label} if got else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def duplicated(texts, length=400):
    """(n_removed, n_spans, kept bytes) of each text: bytes in a string of `length` that starts twice anywhere."""
    data, starts = [(t or "").encode() for t in texts], {}
    for d in data:
        for i in range(len(d) - length + 1):
            k = d[i : i + length]
            starts[k] = starts.get(k, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def shingle_set(text, n):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def components(docs, n, num, den):
    """{doc_id: (n_shingles, component_id)} of [(doc_id, text)]; linked at den * intersection >= num * union."""
    sets = {d: shingle_set(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def ring_shards(docs, n_shards, cells, nodes, slack):
    """{doc_id: (size, crc32, shard)} of [(doc_id, text)]: cells walk the ring clockwise, the largest first, to a shard with room."""
    owner, size = {}, {}
    for doc, text in docs:
        owner[doc] = xxhash.xxh64_intdigest(struct.pack("<q", doc), seed=42) % cells  # 2**64 is a multiple of cells
        size[owner[doc]] = size.get(owner[doc], 0) + len((text or "").encode()) + 1
    at = sorted((zlib.crc32(f"shard {s} node {v}".encode()) * cells // 2**32, s) for s in range(n_shards) for v in range(nodes))
    most, held, place = sum(size.values()) / n_shards * (1 + slack), [0] * n_shards, {}
    for cell in sorted(size, key=lambda c: (-size[c], c)):
        walk = [s for p, s in at if p >= cell] + [s for p, s in at if p < cell]
        fits = [s for s in walk if held[s] + size[cell] <= most]
        place[cell] = fits[0] if fits else min(range(n_shards), key=lambda s: (held[s], s))
        held[place[cell]] += size[cell]
    return {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), place[owner[d]]) for d, t in docs}


def language(text, names, codes, weights, bias, orders):
    """(language, score) of one text by plain sums over its n-grams and the loss of every codeword."""
    if not re.search(r"[^\W\d_]", text or ""):
        return "und", 0.0
    body = (" " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " ").encode()
    bits, features = len(bias), len(weights)
    margin = [0.0] * bits
    for order in orders:
        for i in range(len(body)):
            gram = int.from_bytes(body[i : i + order], "little")
            slot = ((gram ^ (order * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF) >> (33 - features.bit_length())
            margin = [m + float(w) for m, w in zip(margin, weights[slot], strict=True)]
    margin = [m / len(body) + b for m, b in zip(margin, bias, strict=True)]
    loss = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margin, code, strict=True)) for code in codes]
    best = min(range(len(loss)), key=lambda i: loss[i])
    return names[best], 1 / sum(math.exp(loss[best] - x) for x in loss)
