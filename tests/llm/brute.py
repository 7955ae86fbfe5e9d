"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re
import zlib


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def edited_digests(docs):
    """{doc_id: (n_chars, sha256 of the edited text)} for distinct ids."""
    order = sorted(docs, reverse=True, key=lambda r: r[0])
    out = {}
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[doc_id] = (len(text), sha(text[: len(text) - half] + after[:half]))
    return out


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_bytes(docs, size=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            window = data[i : i + size]
            if window in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(window)
        rest = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc_id] = (len(data), sum(gone), spans, sha(rest))
    return out


def repeated_words(docs, size=13):
    """{doc_id: (n_words, n_removed, sha256 of the rest)}."""
    first, words = {}, {}
    for doc_id, text in docs:
        words[doc_id] = w = WORDS.findall(text or "")
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = {}
    for doc_id, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < doc_id:
                gone[i : i + size] = [True] * size
        out[doc_id] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def fingerprints(docs, words=3):
    import xxhash

    out = {}
    for doc_id, text in docs:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)] * bool(w)
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        out[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out


def components(prints, bits=3):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


KINDS = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
]


def secrets(text):
    """[(start, end, kind)] of the base kinds."""
    text, out = text or "", []
    for n, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text, re.ASCII):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), n, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def planted(doc_id, words):
    """The words of a document, of which one in ten repeats from some word on."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return list(words)
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic(words):
    """[(start, length, period)] of all runs, by trying every period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = 0
        for i in range(q, len(words) + 1):
            if i == len(words) or words[i] != words[i - q]:
                if i - start >= max(6, 4 * q):
                    found.setdefault((start, i - start), q)
                start = i - q + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def run_digests(docs):
    """{doc_id: the columns of the query} for distinct ids."""
    out = {}
    for doc_id, text in docs:
        words = planted(doc_id, WORDS.findall(text or ""))
        runs = periodic(words)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        out[doc_id] = {
            "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
        }
    return out


def manifest(rows):
    """Columns of the query in the order of the leaves, from (doc_id, source, lang, n_chars, text)."""

    def tree(nodes):
        """The root and for each node its siblings: (whether it is the left one, hash or '')."""
        proofs, below, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
        while len(level) > 1:
            for i, members in enumerate(below):
                other = level[i ^ 1] if i ^ 1 < len(level) else ""
                for m in members:
                    proofs[m].append((i % 2 == 1, other))
            level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
            below = [sum(below[i : i + 2], []) for i in range(0, len(below), 2)]
        return level[0], proofs

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    parts = []
    for lang in order:
        members = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        parts.append((members, *tree([leaf(r) for r in members])))
    root, above = tree([p[1] for p in parts])
    out = []
    for (members, subroot, proofs), more in zip(parts, above):
        for row, proof in zip(members, proofs):
            path, changed = proof + more, list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                changed[3] += 1
            now = leaf(changed)
            for left, other in path:
                now = sha(other + now if left else now + other)
            out.append((row[0], leaf(row), subroot, root, sha("".join(h for _, h in path)), now, now == root))
    return out


def nearest(rows, k=20, every=20):
    """[(query_id, rank, vec_id, score)] over all pairs; rows of one id don't find each other."""
    import math

    rows = sorted({
        (i, tuple(x + 0.0 for x in v)) for i, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }, key=str)
    out = []
    for q, a in rows:
        if q is None or q % every:
            continue
        found = sorted(
            ((-sum(x * y for x, y in zip(a, b)), i is None, i or 0, i) for i, b in rows if i != q and len(a) == len(b)),
        )[:k]
        out += [(q, r, f[3], -f[0]) for r, f in enumerate(found, 1)]
    return out
