"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from trellica.llm import _text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\v\f\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = components(ids, links)
    return sorted((i, len(sets[i]), of[i]) for i in ids)


def line_dedup(docs):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def fold(doc_id, parts):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def language_base(docs):
    tokens = {i: [*words(t), None] for i, t in docs}
    train = Counter(x for i, ts in tokens.items() if fold(i, 10) for x in ts)
    n, v = sum(train.values()), len(train)
    return {i: (fold(i, 10) == 0, len(ts), sum(train[x] > 0 for x in ts), n, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)) for i, ts in tokens.items()}


def deleted_interpolation(docs, order, levels=16, rounds=60):
    """(id, tokens, log10 probability) of every text; weights by expectation-maximisation over single tokens."""
    tokens = [(i, [*words(t), None]) for i, t in docs]

    def count(keep):
        found = Counter()
        for i, ts in tokens:
            if keep(fold(i, 10)):
                for at in range(len(ts)):
                    for k in range(1, order + 1):
                        found[gram(ts, at, k)] += 1
        return found

    def gram(ts, at, k):
        return (ts[at],) if k == 1 else (f"<start {k}>", ts[at]) if at == 0 else (*gram(ts, at - 1, k - 1), ts[at])

    def parts(counts, n, types, ts):
        seen = counts[(None,)]
        for at in range(len(ts)):
            one = counts[gram(ts, at, 1)]
            base, found, bucket = (one + 0.1) / (n + 0.1 * (types + 1)), [one / max(n, 1)], 0
            for k in range(2, order + 1):
                context = seen if at == 0 else counts[gram(ts, at - 1, k - 1)]
                found.insert(0, counts[gram(ts, at, k)] / context if context else 0.0)
                if context:
                    bucket = 1 + (k - 2) * levels + min(int(math.log2(context)), levels - 1)
            yield bucket, [*found, base]

    every, rest = count(lambda f: f), count(lambda f: f > 1)
    sums = lambda c: sum(v for g, v in c.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in every)
    usable = {b: range(order - (1 if b == 0 else 2 + (b - 1) // levels), order + 1) for b in range(1 + (order - 1) * levels)}
    weights = {b: [1 / len(u) if j in u else 0.0 for j in range(order + 1)] for b, u in usable.items()}
    held = [x for i, ts in tokens if fold(i, 10) == 1 for x in parts(rest, sums(rest), types, ts)]
    for _ in range(rounds if held else 0):
        found = {b: [float(j in u) for j in range(order + 1)] for b, u in usable.items()}
        for b, f in held:
            p = sum(w * x for w, x in zip(weights[b], f, strict=True))
            for j in range(order + 1):
                found[b][j] += weights[b][j] * f[j] / p
        weights = {b: [x / sum(v) for x in v] for b, v in found.items()}
    for i, ts in tokens:
        yield i, len(ts), sum(math.log10(sum(w * x for w, x in zip(weights[b], f, strict=True))) for b, f in parts(every, sums(every), types, ts))


def top_products(vectors, queries, k, scale):
    whole = lambda v: None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(scale * x) for x in v]
    base = [(i, w) for i, v in vectors if (w := whole(v)) is not None]
    out = []
    for q, w in {(i, tuple(w)) for i, v in queries if i is not None and (w := whole(v)) is not None}:
        found = sorted((-sum(a * b for a, b in zip(w, x, strict=True)), i is None, i or 0) for i, x in base if i != q and len(x) == len(w))
        out += [(q, n + 1, None if gone else i, -s) for n, (s, gone, i) in enumerate(found[:k])]
    return sorted(out, key=str)


def ranked(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, Counter(terms(t))) for i, t in docs]
    size = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for (i, c), s in zip(held, size, strict=True):
            m = 75 + 25 * s * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def lloyd(vectors, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=mark)[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centres)), key=lambda c: (apart(v, centres[c]), c))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        groups = {c: [v for (_, v), o in zip(kept, own, strict=True) if o == c] for c in set(own)}
        centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else z for c, z in enumerate(centres)]
    rows = [(i, near(v), apart(v, centres[near(v)])) for i, v in kept]
    within = Counter()
    for _, c, d in rows:
        within[c] += d
    return sorted(((i, c, d, within[c], sum(within.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in rows), key=str)


def hash_of(raw):
    """The library's hash of some bytes, from its position-free definition."""
    data = np.frombuffer(raw, np.uint8)
    return int(_text.span_hash(_text.prefix(data), np.array([0]), np.array([len(data)]))[0])


def toxic_score(text, lean, bias):
    """Sigmoid of the worst passage: 16 words, every 8, mean of the words' mean bucket values, repeats of the last three as zero."""
    ws = [w.encode() for w in words(text)]
    if not ws:
        return 1 / (1 + math.exp(-bias))

    def value(w):
        marked = b"\x01" + w + b"\x02"
        bags = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)] or [marked]
        return sum(lean[hash_of(g) % len(lean)] for g in bags) / len(bags)

    each = [0.0 if w in ws[max(0, i - 3) : i] else value(w) for i, w in enumerate(ws)]
    starts = range(0, max(1, -(-(len(ws) - 16) // 8) + 1) * 8, 8)
    return 1 / (1 + math.exp(-(max(sum(each[a : a + 16]) / 16 for a in starts) + bias)))


def graded(text, model):
    """Expected grade and probability of the highest grade under a cumulative-link model on hashed text."""
    raw, half, size = (text or "").translate(LOWER).encode(), len(model.weights) // 2, len(model.weights)
    mixed = lambda x: int(_text.mix(np.array([x], np.uint64))[0])
    counts = Counter(mixed(raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) % half for i in range(len(raw) - 2))
    ws = [w.encode() for w in words(text)]
    counts.update(half + hash_of(w) % half for w in ws)
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
    total = sum(model.weights[b] * math.log1p(n) / norm for b, n in counts.items())
    if ws:
        n = len(ws)
        levels = (math.log2(n), len(set(ws)) / n * 20, math.ceil(sum(a == b for a, b in zip(ws, ws[1:])) / n * 20), sum(map(len, ws)) / n * 2)
        total += sum(0.3 * model.weights[mixed(int(min(v, 60)) + 1000 * i) % size] for i, v in enumerate(levels))
    tails = [1 / (1 + math.exp(-(total - t))) for t in model.thresholds]
    return model.grades[0] + sum(p * (b - a) for p, a, b in zip(tails, model.grades, model.grades[1:])), tails[-1]
