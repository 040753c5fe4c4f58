"""Brute-force versions of the registered queries, over rows held in memory."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACE.findall((text or "").translate(UPPER))


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def lm_base(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    from collections import Counter

    held = {i: bucket(i, 10) == 0 for i, _ in docs}
    c = Counter()
    for i, t in docs:
        if not held[i]:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in docs:
        ws = [*words(t), None]
        out[i] = (held[i], len(ws), sum(c[w] > 0 for w in ws), n, float(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return out


def lm_bigram(docs, discount=0.75, add=0.1):
    """doc_id -> log10 probability under absolute discounting, without quantisation."""
    from collections import Counter, defaultdict

    uni, pair, follow = Counter(), Counter(), defaultdict(set)
    starts = 0
    for i, t in docs:
        if bucket(i, 10) == 0:
            continue
        starts += 1
        before = "<s>"
        for w in [*words(t), None]:
            uni[w] += 1
            pair[before, w] += 1
            follow[before].add(w)
            before = w
    n, v = sum(uni.values()), len(uni)
    context = lambda w: starts if w == "<s>" else uni[w]
    out = {}
    for i, t in docs:
        total, before = 0.0, "<s>"
        for w in [*words(t), None]:
            low = (uni[w] + add) / (n + add * (v + 1))
            cv = context(before)
            p = low if not cv else max(0, pair[before, w] - discount) / cv + min(1.0, discount * len(follow[before]) / cv) * low
            total += np.log10(p)
            before = w
        out[i] = float(total)
    return out


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return _digest(sorted(found), [(k, e, s) for s, _, k, e in sorted(found)], ("assign", "access", "hex"))


def _digest(found, spans, kinds):
    joined = ",".join(f"{k}:{s}:{e}" for k, e, s in spans)
    return (*[sum(f[2] == k for f in found) for k in kinds], hashlib.sha256(joined.encode()).hexdigest())


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((0, m.start(), "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((1, m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and _luhn(d):
            found.append((2, m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((3, m.start(), "phone", m.end()))
    found.sort()
    return _digest(found, [(k, e, s) for _, s, k, e in found], ("email", "ip", "card", "phone"))


def fingerprint(text, width=3, seed=42):
    from xxhash import xxh64_intdigest

    ws = words(text)
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)] or [" ".join(ws)]
    ones = [0] * 64
    for g in grams:
        h = xxh64_intdigest(g.encode(), seed)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def simhash_components(docs):
    """doc_id -> (hex, smallest reachable id)."""
    fps = [fingerprint(t) for _, t in docs]
    a = np.asarray(fps, dtype=np.uint64)
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            up[root(int(j))] = root(i)
    low = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        low[r] = min(low.get(r, d), d)
    return {d: (f"{fps[i]:016x}", low[root(i)]) for i, (d, _) in enumerate(docs)}


def token_rows(docs, path, end_id):
    """doc_id -> (start, n_tokens, crc32)."""
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, {}
    for i, text in sorted(docs):
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def piece_rows(docs, path, end_id, capacity=2048):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(path), {}
    for i, text in docs:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out[i, k // capacity] = (k, len(part), zlib.crc32(part.tobytes()))
    return out


def exact(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in docs}
    groups = {}
    for i, t in docs:
        groups.setdefault(norm[i], []).append((-len(t or ""), i))
    return {i: (min(g := groups[norm[i]])[1], len(g), min(g)[1] == i, hashlib.sha256(norm[i].encode()).hexdigest()) for i, t in docs}


def jaccard_groups(rows, width=5, least=0.8):
    """Smallest id of each text's group: components of all pairs of shingle sets that are similar enough."""
    sets = {i: {" ".join(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))} for i, t in rows for ws in [words(t)]}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}
