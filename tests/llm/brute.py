"""Plain Python versions of the operators' contracts, for tables that fit in memory."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url(u):
    if not u or "://" not in u:
        host = path = ""
    else:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def minimax(sizes, shards):
    """Smallest capacity into which ordered sizes go contiguously."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, now = (low + high) // 2, 1, 0
        for s in sizes:
            if now + s > mid:
                used, now = used + 1, 0
            now += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def repeats(texts, width):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        seen.update(r[p : p + width] for p in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - width + 1):
            if seen[r[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=3):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(rows, least=90, number=3):
    """[(doc_id, text)] -> {doc_id: (n, component)}."""
    sets = [(d, shingles(t, number)) for d, t in rows]
    top = {d: d for d, _ in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * min(len(x), len(y)) >= least * max(len(x), len(y)) and 100 * len(x & y) >= least * len(x | y):
                a_, b_ = root(a), root(b)
                top[max(a_, b_)] = min(a_, b_)
    return {d: (len(x), root(d)) for d, x in sets}


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    rep = set()
    for k in range(len(w) - 4):
        if grams[tuple(w[k : k + 5])] > 1:
            rep.update(range(k, k + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def crc(text):
    return zlib.crc32((text or "").encode())


def toxic(text, grammar):
    """Whether a grammar's score reaches 0.5, from a plain reading of each clause."""
    import numpy as np

    from veriskill.llm import toxicity as t

    sums = dict.fromkeys(t.PATTERNS, 0.0)
    told = False
    for clause in re.findall(r"[^.!?;:\n]*[.!?;:\n]?", (text or "").lower() + "."):
        if not clause:
            continue
        strength = {"insult": 0, "threat": 0}
        aimed, weight, denied_until = False, 0.0, -1
        for k, word in enumerate(re.findall(r"[^\W_]+", clause)):
            weights = [grammar.words[word]] if word in grammar.words else [w for x, w in grammar.stems.items() if word.startswith(x)]
            kind = "insult" if weights else "threat" if word in t.THREAT else None
            if kind:
                strength[kind] = max(strength[kind], 1 if k <= denied_until else 2 if told else 3)
                weight += max(weights) if weights else 1.0
            elif word in t.NEGATION:
                denied_until = k + t.SCOPE
            elif word in t.REPORT:
                told = True
            elif word in t.TARGET:
                aimed = True
        if strength["insult"]:
            sums[("", "insult_denied", "insult_told", "insult_aimed" if aimed else "insult")[strength["insult"]]] += weight
        elif strength["threat"] and aimed:
            sums["threat_aimed" if strength["threat"] == 3 else "threat_denied_or_told"] += weight
        if clause[-1] != ":":
            told = False
    x = sum(np.log1p(v) * w for v, w in zip(sums.values(), grammar.weights)) + grammar.bias
    return 1 / (1 + np.exp(-x)) >= 0.5


def secrets(spark, rows, model):
    """[(key, text, path)] -> {key: (candidates, confirmed matches, masked text)}, a plain scan with the same forest."""
    from pyspark.ml.linalg import Vectors

    from veriskill.llm import secrets as s

    found = defaultdict(list)
    for key, text, path in rows:
        for m in re.finditer(s.CANDIDATE, text or ""):
            found[m[0], text[max(0, m.start() - s.NEAR) : m.start()], text[m.end() : m.end() + s.NEAR], path].append(key)
    sure, held = defaultdict(set), defaultdict(set)
    if found:
        for r in s.with_features(spark.createDataFrame(list(found), "match string, before string, after string, path string")).collect():
            value = re.sub(rf"^(?i:{s.GIVEN}\s?[\"']?)", "", r.match)
            yes = model.predictProbability(Vectors.dense([r[c] for c in s.FEATURES]))[1] >= 0.5
            for key in found[r.match, r.before, r.after, r.path]:
                held[key].add((r.match, value))
                if yes:
                    sure[key].add(value)
    out = {}
    for key, text, _ in rows:
        want = sorted(m for m, v in held[key] if v in sure[key])
        masked = text
        for m in sorted(want, key=lambda m: (-len(m), m)):
            masked = masked.replace(m, s.MASK)
        out[key] = (len(held[key]), want, masked)
    return out


def resample(rows, items, percent=25, least_words=20):
    """[(doc_id, text)] and target texts -> {doc_id: (n_features, weight, score, rank)}."""
    import math

    def grams(text):
        w = ALNUM.findall((text or "").translate(LOWER))
        return len(w), w + [" ".join(p) for p in zip(w, w[1:])]

    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    docs = [(d, *grams(t)) for d, t in rows]
    s, t = Counter(bucket(g) for _, _, gs in docs for g in gs), Counter(bucket(g) for x in items for g in grams(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = {}
    for d, n, gs in docs:
        weight = sum(gain[bucket(g)] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n]
    able = sorted((d for d, v in out.items() if v[4] >= least_words), key=lambda d: (-out[d][2], d))
    for k, d in enumerate(able[: percent * len(able) // 100]):
        out[d][3] = k + 1
    return {d: tuple(v[:4]) for d, v in out.items()}


def spelling(rows):
    """[(doc_id, text)] -> {word: (n, n_near, form, form_n, root)}."""
    count = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    gone = defaultdict(set)  # words that agree but for one place
    for w in words:
        gone[w].add(w)
        for k in range(len(w)):
            gone[w[:k] + w[k + 1 :]].add(w)
    nears = defaultdict(set)
    for group in gone.values():
        for a in group:
            nears[a].update(b for b in group if near(a, b))
    form = {}
    for w, n in words.items():
        best = min(nears[w], key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(nears[w]), form[w], words[form[w]] if form[w] else None, root)
    return out
