"""Plain versions of the operators, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
import zstandard

WHITE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact(rows):
    """doc_id, text -> doc_id: (keep_id, group_size)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[WHITE.sub(" ", t or "")].append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def fingerprint(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(prints, distance):
    """doc_id: fingerprint -> doc_id: smallest doc_id reachable."""
    ids = sorted(prints)
    p = np.array([prints[i] for i in ids], dtype=np.uint64)
    seen, out = set(), {}
    for k, i in enumerate(ids):
        if k in seen:
            continue
        seen.add(k)
        todo = [k]
        while todo:
            j = todo.pop()
            out[ids[j]] = i
            for m in np.flatnonzero(np.bitwise_count(p ^ p[j]) <= distance).tolist():
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked),
            n < 50 or 100 * len(marked) > 50 * n)


def pieces(tokenizer, text, capacity=4096):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    for k, low in enumerate(range(0, len(ids), capacity)):
        own = ids[low:low + capacity]
        yield k, low, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())


def url(text, lists):
    rest = text.split("://", 1)[1] if text and "://" in text else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule in lists:
        name, slash, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + tail):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def schedule(quotas, period):
    """Earliest deadline first over one period, slot by slot: the source of each slot."""
    done = dict.fromkeys(quotas, 0)
    out = []
    for t in range(period):
        free = [(-(-(done[s] + 1) * period // q), s) for s, q in quotas.items() if done[s] * period // q <= t]
        s = min(free)[1]
        done[s] += 1
        out.append(s)
    return out


def with_periods(doc_id, text):
    """The words of a document, repeated from a word on where the contract of op13 says so."""
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs(w, least=6, exponent=4):
    """(start, length, period) of every run, period by period."""
    smallest = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                smallest.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((i, j - i, q) for (i, j), q in smallest.items() if j - i >= max(least, exponent * q))


def collapse(w, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def whitening(vectors, k=8):
    """n, deviations, values, whitened (rows by components, up to sign) and trace of the usable vectors."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    covariance = centred.T @ centred / n
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviations, e, centred @ u / np.sqrt(e), float(np.trace(covariance))


def without_repeats(rows, window=13):
    """doc_id, text -> for each row (doc_id, n_words, removed spans, kept text)."""
    last = float("inf")
    own = [(last if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for o, _, w in own:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, last), o)
    for o, i, w in own:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < o:
                gone[s:s + window] = [True] * window
        marked = "".join("x" if g else "." for g in gone)
        spans = [m.span() for m in re.finditer("x+", marked)]
        yield i, len(w), spans, " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def toxicity(text, model, window=16, level=3):
    """The score of a text by a plain loop over its windows."""
    w = [x.lower() for x in WORD.findall(text or "")]
    key = lambda x, n: xxhash.xxh64_intdigest((x[:n] if n else x).encode(), n).to_bytes(8, "little")
    windows = [b"".join(key(x, n) for x in w[i:i + window] for n in (3, 5, 0)) for i in range(0, max(1, len(w)), window)]
    size = []
    for content in (model.ordinary, model.ordinary + model.toxic):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        made = zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)
        size.append([len(made.compress(x)) for x in windows])
    saved = [a - b for a, b in zip(*size, strict=True)]
    best = sorted(saved)[-3:]
    x = [best[-1], sum(best) / len(best), sum(saved) / len(saved), sum(v >= 4 for v in saved) / len(saved), sum(v >= 8 for v in saved) / len(saved)]
    z = model.weights[0] + sum(c * (v - m) / s for c, v, m, s in zip(model.weights[1:], x, model.means, model.scales, strict=True))
    return 1 / (1 + math.exp(-z))
