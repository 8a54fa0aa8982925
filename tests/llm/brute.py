"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def raw(text):
    return (text or "").encode()


def words(text):
    return WORD.findall(raw(text))


def repeats(docs, width=400):
    """Operator 9 by counting every string: doc_id -> digest columns."""
    count = Counter(b[i:i + width] for b in (raw(t) for _, t in docs) for i in range(len(b) - width + 1))
    out = {}
    for d, t in docs:
        b = raw(t)
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def later_repeats(docs, width=20):
    """Operator 10 in document order."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        ws = words(t)
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            k = tuple(ws[i:i + width])
            if k in seen:
                gone[i:i + width] = [True] * width
            seen.add(k)
        kept = b" ".join(x for x, g in zip(ws, gone, strict=True) if not g)
        out[d] = (len(ws), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k=5):
    ws = WORD.findall(raw(text).translate(_LOWER))
    if len(ws) >= k:
        return frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    return frozenset([tuple(ws)]) if ws else frozenset()


def near_copies(docs, k=5, percent=80):
    """Operator 4 over all pairs: doc_id -> (set size, component)."""
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def base_metrics(text):
    """The base columns of operator 8."""
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    again = [False] * len(ws)
    for i in range(len(ws) - 2):
        if windows[tuple(ws[i:i + 3])] > 1:
            again[i:i + 3] = [True] * 3
    rep = sum(again)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, rep,
            len(ws) < 50 or 100 * rep > 50 * len(ws))


def fair_targets(sizes, share=1.5, cap=2, weights=(3, 1, 2)):
    """Targets of operator 1 by repeated resharing: source -> target."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = float(cap * sizes[s])
        left -= sum(target[s] for s in over)
        free -= over
    return target


def spelling(docs, drop_one_in=97, min_length=5, min_count=3):
    """Operator 11 by comparing deletions of all words: word -> the other columns."""
    count = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % drop_one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}
    near = {w: set() for w in words}
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1:]].add(w)
            if (u := w[:i] + w[i + 1:]) in words:
                near[w].add(u)
                near[u].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def chat_digests(rows):
    """The contract's columns of operator 12 from the source rows: conv_id ->
    (n_turns, turns digest, loss_chars, loss digest)."""
    def key(r):
        return (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    out = {}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def hard_negatives(rows, every=50, n_pos=5, n_neg=3):
    """Operator 13 over all pairs; rows: (vec_id, vector, label), labels as moved."""
    def codes(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]
    used = [(i, q, lab) for i, v, lab in rows if i is not None and lab is not None and (q := codes(v)) is not None
            and sum(x * x for x in q) <= 2 ** 62]
    out = []
    for at, (a, q, lab) in enumerate(used):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p, strict=True)), i, other)
                  for k, (i, p, other) in enumerate(used) if k != at and len(p) == len(q)]
        scored.sort(key=lambda x: x[:2])
        for s, i, _ in [x for x in scored if x[2] == lab][:n_pos]:
            hard = [(n, -t) for t, n, other in scored if other != lab and 50 * -s <= 100 * -t <= 95 * -s][:n_neg]
            out += [(a, i, k + 1, n, -s, t) for k, (n, t) in enumerate(hard)]
    return sorted(out)


def verdicts(docs, labels, hashes, bits=14, scale=1 << 16, prior=1000.0):
    """Operator 8's model counted word by word: doc_id -> kept.

    docs: (doc_id, text); labels: (doc_id, good, fits); hashes(words) -> (64-bit
    hashes of the words, of their pairs)."""
    size = 1 << bits
    grams_of = {}
    for d, t in docs:
        one, two = hashes(words(t))
        grams_of[d] = [int(h) >> (64 - bits) for h in (*one, *two)]
    trusted = {d for d, good, fits in labels if good and fits}
    if not trusted:
        return {d: not base_metrics(t)[5] for d, t in docs}
    raw = Counter(g for d in grams_of for g in grams_of[d])
    fine = Counter(g for d in trusted if d in grams_of for g in grams_of[d])
    n_raw, n_fine = sum(raw.values()), sum(fine.values())
    weight = {}
    for g in raw:
        p = (raw[g] + 1) / (n_raw + size)
        weight[g] = round(math.log((fine[g] + prior * p) / (n_fine + prior) / p) * scale)
    total = {d: sum(weight[g] for g in gs) for d, gs in grams_of.items()}
    held = [(good, total[d] // len(grams_of[d])) for d, good, fits in labels if not fits and grams_of.get(d)]
    good, bad = ([s for g, s in held if g is x] for x in (True, False))
    if good and bad:
        cuts = sorted({*good, *(s + 1 for s in bad)})
        worth = {c: sum(s >= c for s in good) / len(good) + sum(s < c for s in bad) / len(bad) for c in cuts}
        best = min(c for c in cuts if worth[c] == max(worth.values()))
        below = [s for s in bad if s < best]
        low = max(below) if below else best - 1
        cut = (low + best) // 2 + 1 if best > low + 1 else best
    else:
        cut = None
    return {d: not base_metrics(t)[5] and (cut is None or total[d] >= cut * len(grams_of[d])) for d, t in docs}
