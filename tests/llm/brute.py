"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

SPACE = re.compile("[^\x20\x09-\x0d]+")


def token_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def substring(docs, window=20):
    """{(doc_id, text): (n_words, n_removed, sha)}; docs: (doc_id, text), a null id last."""
    docs = sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0))
    words = [SPACE.findall(t or "") for _, t in docs]
    first = {}
    for (d, _), w in zip(docs, words):
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (d, s))
    out = {}
    for (d, t), w in zip(docs, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (d, s):
                gone |= set(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, t] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPACE.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """fps: (doc_id, fingerprint); {fingerprint: smallest doc_id reachable}."""
    distinct = sorted({f for _, f in fps})
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    smallest = defaultdict(list)
    for d, f in fps:
        smallest[root(f)].append(d)
    return {f: min((d for d in smallest[root(f)] if d is not None), default=None) for f in distinct}


def topk(vectors, k=20, every=20):
    """vectors: (vec_id, list); rows (query_id, rank, vec_id, score)."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def spans_of(text, kinds):
    """kinds: (name, compiled pattern, keep); leftmost non-overlapping matches of each by start, then kind."""
    found = []
    for rank, (name, pattern, keep) in enumerate(kinds):
        found += [(m.start(), rank, m.end(), name) for m in pattern.finditer(text or "") if keep(m)]
    return [f"{n}:{s}:{e}" for s, _, e, n in sorted(found)]


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m)) <= 15),
]
SECRETS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def digested(texts):
    """n_chars, edited_sha256 of texts in order."""
    out = []
    for text, following in zip(texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, following))
    return out
