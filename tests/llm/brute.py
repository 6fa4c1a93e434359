"""Plain Python versions of what the operators compute, and small tables."""

import re
from collections import defaultdict

import xxhash

#: Names that the operators use inside or return; documents may have them, too.
CLASHING = ("part", "spans", "score", "accepted", "lang_pred", "h", "th", "d", "x", "cuts", "of", "key", "kept_id", "fp", "rank", "run", "ids")


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); all columns of documents and clashing ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None if r[1] is None else len(r[1]), *(f"own {c}" for c in CLASHING)) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_classes(rows):
    """doc_id -> (fingerprint, component id); ids non-null and unique."""
    fp = {d: simhash(t) for d, t in rows}
    first = {}
    for d, f in fp.items():
        first[f] = min(d, first.get(f, d))
    fs = list(first)
    links = [(first[a], first[b]) for i, a in enumerate(fs) for b in fs[:i] if (a ^ b).bit_count() <= 3]
    root = components(first.values(), links)
    return {d: (f"{f:016x}", root[first[f]]) for d, f in fp.items()}


def repeated_words(rows, n=50):
    """(doc_id -> set of words to cut, doc_id -> words of originals, copies -> of); ids unique."""
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t in rows}
    stands = {}
    for d, t in rows:
        stands[t or ""] = min(d, stands.get(t or "", d))
    copies = {d: stands[t or ""] for d, t in rows if stands[t or ""] != d and len(words[d]) >= n}
    at = defaultdict(list)
    for d in stands.values():
        for x in range(len(words[d]) - n + 1):
            at[tuple(words[d][x: x + n])].append((d, x))
    later, first = defaultdict(set), defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for k, (d, x) in enumerate(sorted(places)):
                (later if k else first)[d].update(range(x, x + n))
    return {d: later[d] - first[d] for d in later if later[d] - first[d]}, dict(first), copies


BASE = (("assign", re.compile(r"""(?:(?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
        ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+")))


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if (kind == "assign" and len(m[1]) >= 8) or (kind == "access" and len(m[0]) >= 16) or (kind == "hex" and len(m[0]) >= 32):
                out.append((m.start(), k, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]
