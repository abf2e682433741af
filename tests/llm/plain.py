"""Plain versions of the operators over Python lists, and the odd rows that every operator must take."""

from __future__ import annotations

import collections
import hashlib
import re

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EXTRA = "id long, row long, size string, value string, covered int, node string, signature string, score string, label int"

#: doc_id, text, lang, source: null in any column, empty, blank and very long texts, ties, a repeated row, one id with two texts.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "the cat sat on the mat and the dog", "en", "b"),
    (4, "the cat sat on the mat and the dog", "en", "b"), (5, "The CAT sat on the mat and the dog", None, "b"), (6, "one", "en", None), (7, "é ñ ß 𝄞  x́", "de", "c"),
    (8, "1 " * 30_000, "en", "c"), (9, "x" * 50_000, "en", "c"), (10, "word " * 20_000, "en", "c"), (None, "a row without an id and some more words here", "en", "a"),
    (11, "a.b" * 5_000 + "@x.y" + ".z" * 5_000, "en", "a"), (12, "+1" + "-" * 20_000 + "2", "en", "a"), (12, "another text under the same id as the row before", "en", "a"),
    (13, "<|endoftext|> don't <|startoftext|> 's '", "fr", "d"), (14, "\x00\x1c\x85 nul and controls", "fr", "d"),
]


def odd(spark, rows=ODD):
    """The odd rows with further columns whose names clash with those that operators use inside."""
    extra = [(i, i, "s", "v", 1, "n", "g", "c", 0) for i in range(len(rows))]
    return spark.createDataFrame([r + e for r, e in zip(rows, extra, strict=True)], "doc_id long, text string, lang string, source string, " + EXTRA)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return BLANK_WORD.findall(text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii_spans(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def secret_spans(text):
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text or "") if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16])


def span_text(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    w = words(lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows):
    """doc_id -> (shingles, component) of distinct ids, all pairs compared."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = collections.Counter()
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(text, items):
    """n_words, n_hit, ids found; items: (id, text)."""
    w = BENCH_WORD.findall(lower(text))
    windows = collections.defaultdict(set)
    for i, t in items:
        x = BENCH_WORD.findall(lower(t))
        for k in range(max(1, len(x) - 12) if x else 0):
            windows[tuple(x[k : k + 13])].add(str(i))
    hit, found = set(), set()
    for size in {len(k) for k in windows}:
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in windows:
                found |= windows[tuple(w[k : k + size])]
                hit |= set(range(k, k + size))
    return len(w), len(hit), sorted(found)


def longest_match(text, items):
    """Words of the longest run shared with an item: 13 or more, or a whole shorter item; 0 without one."""
    w, best = BENCH_WORD.findall(lower(text)), 0
    for _, t in items:
        x = BENCH_WORD.findall(lower(t))
        runs = {}
        for i, a in enumerate(w):
            runs = {j: runs.get(j - 1, 0) + 1 for j, b in enumerate(x) if a == b}
            best = max([best, *(n for n in runs.values() if n >= min(13, len(x)))])
    return best


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if BLANK_WORD.search(x)]
    counts = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k + d for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if counts[g] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def targets(sizes):
    """source -> words in the mix; sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        rest, by = total - sum(out.values()), sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] / by > 2 * sizes[s]]
        if not above:
            return out | {s: rest * weight[s] / by for s in free}
        for s in above:
            out[s] = 2 * sizes[s]
            free.discard(s)
    return out
