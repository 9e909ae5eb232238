"""Plain versions of the operators, by definition, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\r\x0b\x0c"


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def base_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words, seen, twins = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twins += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twins, len(covered)


#: Characters of each class but the last two, which hold all other ASCII and what is beyond it.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:'\"?-", "()[]{}", "#*$%&|<>!~^=+_@\\/`")
EDGES = ".,;:'\"?!-()[]{}#*$%&|<>"


def quality_histograms(text: str | None, common: list[str]) -> tuple[list[int], list[int]]:
    text = text or ""
    chars = [sum(c in s for c in text) for s in CLASSES]
    beyond = sum(ord(c) > 127 for c in text)
    chars += [len(text) - sum(chars) - beyond, beyond]
    words, found = WORD.findall(text), Counter()
    for w in words:
        bare = w
        while len(bare) > 1 and bare[0] in EDGES:
            bare = bare[1:]
        while len(bare) > 1 and bare[-1] in EDGES:
            bare = bare[:-1]
        found[lowered(bare) if lowered(bare) in common else "\0mark" if bare in EDGES else "\0other"] += 1
    return chars, [found[w] for w in [*common, "\0mark", "\0other"]]


def jensen_shannon(counts: list[float], reference: list[float]) -> float:
    from math import log2, sqrt

    n, m = sum(counts), sum(reference)
    if not n:
        return 0.0
    total = 0.0
    for a, b in zip(counts, reference, strict=True):
        p, q = a / n, b / m
        total += sum(x * log2(2 * x / (p + q)) for x in (p, q) if x)
    return sqrt(max(0.0, total / 2))


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(lowered(text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    holders: dict[tuple, list[int]] = {}
    for i, s in sorted(sets.items()):
        for j, k in Counter(j for x in s for j in holders.get(x, ())).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for x in s:
            holders.setdefault(x, []).append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def deduped_lines(rows: list[tuple[int | None, str | None]], least: int) -> dict[int, str]:
    lines = {i: [(k, x.strip(BLANKS)) for k, x in enumerate(t.split("\n")) if x.strip(BLANKS)] for i, t in rows if i is not None and t is not None}
    places: dict[str, list] = {}
    for i, own in lines.items():
        for p, (_, x) in enumerate(own):
            places.setdefault(x, []).append((i, p))
    out = {}
    for i, text in rows:
        if i is None or text is None:
            continue
        gone, own = set(), lines[i]
        for a in range(len(own)):
            for j, b in places[own[a][1]]:
                if (j, b) < (i, a):
                    n = size = 0
                    while a + n < len(own) and b + n < len(lines[j]) and own[a + n][1] == lines[j][b + n][1]:
                        size += len(WORD.findall(own[a + n][1]))
                        n += 1
                    if size >= least:
                        gone.update(range(own[a][0], own[a + n - 1][0] + 1))
        out[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def base_scores(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    texts = [(i, [*WORD.findall(lowered(t or "")), "\0end"]) for i, t in rows]
    out_of = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in texts]
    train = Counter(w for (_, ws), held in zip(texts, out_of, strict=True) if not held for w in ws)
    n, v = sum(train.values()), len(train)
    return [(held, len(ws), sum(train[w] > 0 for w in ws), n, sum(log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (_, ws), held in zip(texts, out_of, strict=True)]


def strong_secrets(text: str) -> list[tuple[str, int, int]]:
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, "assign", m.end()))
    for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)), 1):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def pitman_yor_scores(rows: list[tuple[int | None, str | None]], discounts: tuple[float, float], strength: float, sweeps: int, burn_in: int, seed: int) -> list[float]:
    """log10 probability of each text by a hierarchical Pitman-Yor model of pairs whose customers are removed and reseated one by one."""
    import random

    rng = random.Random(seed)
    texts = [(zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0, [*WORD.findall(lowered(t or "")), "\0end"]) for i, t in rows]
    types = len({w for held, ws in texts if not held for w in ws})
    tables: dict[tuple, list[int]] = {}  # (context, or None for the parent, word) -> customers of each table
    totals, opened = Counter(), Counter()

    def probability(context: str | None, word: str) -> float:
        base = 1 / (types + 1) if context is None else probability(None, word)
        d = discounts[context is None]
        own = tables.get((context, word), ())
        return (sum(own) - d * len(own) + (strength + d * opened[context]) * base) / (strength + totals[context])

    def sit(context: str | None, word: str) -> None:
        d, own = discounts[context is None], tables.setdefault((context, word), [])
        base = 1 / (types + 1) if context is None else probability(None, word)
        at = rng.choices(range(len(own) + 1), [*(k - d for k in own), (strength + d * opened[context]) * base])[0]
        totals[context] += 1
        if at < len(own):
            own[at] += 1
        else:
            own.append(1)
            opened[context] += 1
            if context is not None:
                sit(None, word)

    def leave(context: str | None, word: str) -> None:
        own = tables[context, word]
        at = rng.choices(range(len(own)), own)[0]
        own[at] -= 1
        totals[context] -= 1
        if not own[at]:
            del own[at]
            opened[context] -= 1
            if context is not None:
                leave(None, word)

    customers = [pair for held, ws in texts if not held for pair in zip(["\0start", *ws], ws, strict=False)]
    for pair in customers:
        sit(*pair)
    pairs = {pair for _, ws in texts for pair in zip(["\0start", *ws], ws, strict=False)}
    mean = dict.fromkeys(pairs, 0.0)
    for k in range(sweeps):
        rng.shuffle(customers)
        for pair in customers:
            leave(*pair)
            sit(*pair)
        if k >= burn_in:
            for pair in pairs:
                mean[pair] += probability(*pair) / (sweeps - burn_in)
    return [sum(log10(mean[pair]) for pair in zip(["\0start", *ws], ws, strict=False)) for _, ws in texts]
