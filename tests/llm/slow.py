"""Plain Python versions of the training-data operators, written for tests alone."""

import calendar
import datetime
import math
import re
from hashlib import sha256

import numpy as np
import xxhash


def words7(text):
    return [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]


def contaminated(text, items):
    ws = words7(text)
    hit = set()
    for item in items:
        iw = words7(item)
        n = min(13, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[i : i + n]) in wins:
                hit |= set(range(i, i + n))
    return len(hit) > 0 and 20 * len(hit) >= len(ws)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(fps):
    """Label of each fingerprint's group: links at 3 bits or fewer, followed to the end."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            low = min(label[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3)
            if low < label[i]:
                label[i], changed = low, True
    return label


BLANK = re.compile(r"[ \t\n\x0b\f\r]*\Z")


def lines(rows, least=2, passage=50):
    """rows: (key, text) that differ, in order. (lines, removed, longest run, kept text) of each, by every run of every length."""
    split = [(t or "").split("\n") for _, t in rows]
    spots = [[i for i, x in enumerate(ls) if not BLANK.match(x)] for ls in split]
    longest, gone, n = [0] * len(rows), [set() for _ in rows], 1
    while True:
        runs = {}
        for d, ls in enumerate(split):
            for i in range(len(spots[d]) - n + 1):
                runs.setdefault(tuple(ls[p] for p in spots[d][i : i + n]), []).append((d, i))
        runs = {k: v for k, v in runs.items() if len(v) > 1}
        if not runs:
            break
        for run, places in runs.items():
            for d, i in places:
                if n >= least:
                    longest[d] = max(longest[d], n)
                long = n == 1 and len(re.findall(r"[^ \t\n\x0b\f\r]+", run[0])) >= passage
                if (n == least or long) and (d, i) != min(places):
                    gone[d] |= set(spots[d][i : i + n])
        n += 1
    return [(0 if t is None else len(ls), len(g), m, None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in g)) for (_, t), ls, g, m in zip(rows, split, gone, longest, strict=True)]


TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^\sA-Za-z0-9_\x80-\xff]+")
MASK = 2**64 - 1


def h64(word):
    return xxhash.xxh64_intdigest(word)


def pair(a, b):
    x = (a * 0x9E3779B97F4A7C15 + b) & MASK
    return ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & MASK


def toxic_sentences(text):
    """(start, end, features) in bytes of each sentence."""
    out = []
    for m in re.finditer(rb"[^.!?\n]+[.!?]*", text):
        ws = TOKEN.findall(m[0].lower())
        if not m[0].strip(b" .!?\t\r\f\v"):
            continue
        hs = [h64(w) for w in ws]
        f = {h >> 44 for h in hs} | {pair(a, b) >> 44 for a, b in zip(hs, hs[1:])}
        for n in (4, 5):
            f |= {((h64(w[:n]) * (2 * n + 1)) & MASK) >> 44 for w in ws}
        out.append((m.start(), m.end(), f))
    return out


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def toxic_score(text, w):
    miss = 0.0
    for _, _, f in toxic_sentences((text or "").encode()):
        s = sum(float(w[x]) for x in f) + float(w[-1])
        miss += math.log1p(math.exp(s)) if s < 30 else s
    return -math.expm1(-miss)


def quality_features(text):
    hs = [h64(w) for w in TOKEN.findall((text or "").encode())]
    count = {}
    for h in hs + [pair(a, b) for a, b in zip(hs, hs[1:])]:
        count[h >> 46] = count.get(h >> 46, 0) + 1
    v = {k: math.log1p(c) for k, c in count.items()}
    length = math.sqrt(sum(x * x for x in v.values())) or 1e-12
    return {k: x / length for k, x in v.items()}


def ftrl(rows, epochs=4, seed=7, alpha=0.5, beta=1.0, l1=0.05, l2=0.1):
    """rows: (y, features) in order. Weights by index, with the bias at None."""
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[k]) - z[k]) / ((beta + math.sqrt(n[k])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            y, f = rows[i]
            f = f | {None: 1.0}
            w = {k: weight(k) for k in f}
            g0 = sigmoid(sum(w[k] * v for k, v in f.items())) - y
            for k, v in f.items():
                g = g0 * v
                new = n.get(k, 0.0) + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(new) - math.sqrt(n.get(k, 0.0))) / alpha * w[k]
                n[k] = new
    return {k: weight(k) for k in z}


def spark_hash(key):
    """xxhash64() of a bigint, as signed."""
    x = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
    return x - 2**64 if x >= 2**63 else x


def feistel(values, radices, key, tweak):
    v, half = list(values), len(values) // 2
    for r in range(8):
        left = r % 2 == 0
        seed = "|".join([key, tweak, str(r), ",".join(map(str, v[half:] if left else v[:half]))])
        v = [(x + int(sha256(f"{seed}|{i}".encode()).hexdigest()[:12], 16)) % radices[i] if (i < half) == left else x for i, x in enumerate(v)]
    return v


def refill(form, new, kind):
    at = [i for i, c in enumerate(form) if re.fullmatch(kind, c)]
    out = list(form)
    for i, c in zip(at[len(at) - len(new) :], new, strict=True):
        out[i] = c
    return "".join(out)


def luhn(ds):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(ds)))


def _card(m, key):
    ds = [int(c) for c in m if c.isdigit()]
    if luhn(ds) % 10 or not ds[0]:
        return None
    new = ds[:1] + feistel(ds[1:-1], [10] * (len(ds) - 2), key, "card")
    return refill(m, [str(d) for d in [*new, -luhn([*new, 0]) % 10]], "[0-9]")


def _phone(m, key):
    ds = [int(c) for c in m if c.isdigit()][-10:]
    low = [2 if i in (0, 3) and d > 1 else 0 for i, d in enumerate(ds)]
    radix = [(8 if d > 1 else 2) if i in (0, 3) else 10 for i, d in enumerate(ds)]
    return refill(m, [str(x + b) for x, b in zip(feistel([d - b for d, b in zip(ds, low)], radix, key, "phone"), low)], "[0-9]")


def _ip(m, key):
    v = [int(x) for x in m.split(".")]
    return ".".join(map(str, feistel(v, [256] * 4, key, "ip"))) if max(v) < 256 else None


def _ssn(m, key):
    area, group, serial = map(int, m.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    a, g, s = feistel([area - (2 if area > 666 else 1), group - 1, serial - 1], [898, 99, 9999], key, "ssn")
    return f"{a + (2 if a >= 665 else 1):03}-{g + 1:02}-{s + 1:04}"


def _date(m, key):
    kind = "-" if "-" in m else "." if "." in m else "/"
    a, b, c = m.split(kind)
    y, mo, d = map(int, (a, b, c) if kind == "-" else (c, b, a) if kind == "." else (c, a, b))
    if not (1600 <= y <= 2399 and 1 <= mo <= 12 and 1 <= d <= calendar.monthrange(y, mo)[1]):
        return None
    n = (datetime.date(y, mo, d) - datetime.date(1600, 1, 1)).days
    if n >= 378 * 773:
        return None
    p, q = feistel([n // 773, n % 773], [378, 773], key, "date")
    t = (datetime.date(1600, 1, 1) + datetime.timedelta(p * 773 + q)).isoformat()
    y, mo, d = t.split("-")
    return {"-": t, ".": f"{d}.{mo}.{y}", "/": f"{mo}/{d}/{y}"}[kind]


def _mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _iban(m, key):
    s = m.replace(" ", "")
    ds = [int(c) for c in s[4:] if c.isdigit()]
    if not 15 <= len(s) <= 34 or len(ds) < 2 or _mod97(s[4:] + s[:4]) != 1:
        return None
    body = refill(s[4:], [str(d) for d in feistel(ds, [10] * len(ds), key, "iban")], "[0-9]")
    return refill(m, list(f"{s[:2]}{98 - _mod97(body + s[:2] + '00'):02}{body}"), "[A-Z0-9]")


def _email(m, key):
    local, host = m.rsplit("@", 1)
    local = local.lower()
    cs = [c for c in local if re.fullmatch("[a-z0-9]", c)]
    if not cs:
        return None
    base = [48 if c.isdigit() else 97 for c in cs]
    new = feistel([ord(c) - b for c, b in zip(cs, base)], [10 if b == 48 else 26 for b in base], key, "email")
    return refill(local, [chr(x + b) for x, b in zip(new, base)], "[a-z0-9]") + "@" + host


RULES = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def private(text, key, candidates):
    """(text with pseudonyms, how many, kinds). candidates: patterns by kind, in order."""
    n, kinds = 0, set()

    def put(m):
        nonlocal n
        for kind, pattern in candidates.items():
            if re.fullmatch(pattern, m[0], re.ASCII) and (new := RULES[kind](m[0], key)) is not None:
                n += 1
                kinds.add(kind)
                return new
        return m[0]

    return re.sub("|".join(candidates.values()), put, text, flags=re.ASCII), n, kinds
