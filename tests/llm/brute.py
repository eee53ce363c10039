"""Plain Python versions of the operators."""

import hashlib
import re
from collections import Counter, defaultdict

SOLID = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def gram_set(text, n):
    w = SOLID.findall(lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_groups(docs, n, percent):
    """{id: least id of its component} for (id, text) pairs with distinct ids."""
    sets = {i: gram_set(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    seen = set()
    for own in by.values():
        for k, a in enumerate(own):
            for b in own[:k]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def base_counts(text):
    text = text or ""
    words = SOLID.findall(text)
    lines = [x for x in text.split("\n") if SOLID.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def quality(docs, max_docs, max_share, min_left, always=1000):
    """[(kept, text without boilerplate)] of (id, source, text) rows."""
    norm = lambda x: " ".join(SOLID.findall(lower(x)))
    hosts, lines = Counter(s for _, s, _ in set(docs)), Counter()
    for _, s, t in set(docs):
        lines.update((s, x) for x in {norm(x) for x in (t or "").split("\n")} if x)
    gone = {k for k, n in lines.items() if n > max_docs and (n > max_share * hosts[k[0]] or n > always)}
    out = []
    for _, s, t in docs:
        n, _, _, _, repeat = base_counts(t)
        left = [x for x in (t or "").split("\n") if (s, norm(x)) not in gone]
        words = sum(len(SOLID.findall(x)) for x in left)
        out.append((not (n < 10 or 100 * repeat > 20 * n) and words >= 10 and words >= min_left * n, "\n".join(left)))
    return out


def duplicate_lines(docs, min_words=5):
    """{(id, line): (id, line) of the earliest line within one word edit (of fewer words: that is equal)} of (id, text) pairs with distinct ids."""
    first, wild, shorter, out = {}, {}, {}, {}
    for i, text in sorted(docs):
        for k, line in enumerate((text or "").split("\n")):
            w = tuple(SOLID.findall(lower(line)))
            if len(w) < min_words:
                if w and w in first:
                    out[i, k] = first[w]
                first.setdefault(w, (i, k))
                continue
            cut = [w[:j] + w[j + 1 :] for j in range(len(w))]
            found = [first.get(w), shorter.get(w), *(first.get(v) for v in cut if len(v) >= min_words), *(wild.get((j, v)) for j, v in enumerate(cut))]
            if found := [x for x in found if x is not None]:
                out[i, k] = min(found)
            if w not in first:
                first[w] = (i, k)
                for j, v in enumerate(cut):
                    wild.setdefault((j, v), (i, k))
                    shorter.setdefault(v, (i, k))
    return out


def contamination(text, items, window=8):
    """(words, hit word numbers, items) of a text."""
    w = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for name, item in items:
        q = ALNUM.findall(lower(item))
        for i in range(max(1, len(q) - window + 1) if q else 0):
            g = q[i : i + window]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    found.add(str(name) if name is not None else "")
    return w, hit, found


def decontaminate(text, items, coverage=0.5):
    """The text without hit spans, None if too much is hit."""
    w, hit, _ = contamination(text, items)
    if len(hit) > coverage * len(w):
        return None
    spans = [m.span() for m in ALNUM.finditer(lower(text))]
    ends = [s for s, _ in spans[1:]] + [len(text or "")]
    out, at = [], 0
    for k, (s, _) in enumerate(spans):
        if k in hit:
            out.append(text[at:s])
            at = ends[k]
    return "".join([*out, (text or "")[at:]])


def repeated_words(texts, length):
    """Words of each text that are covered by a sequence of ``length`` words that also starts anywhere else."""
    words = [SOLID.findall(lower(t)) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    return [len({j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}) for w in words]


def repeated_bytes(texts, length):
    """[(bytes left, spans, sha256)] of whole texts."""
    data = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


def best_fit(lengths, window):
    """Bins of best-fit decreasing, piece by piece."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(window - x)
    return sorted(rooms)


def pieces(n, window):
    return [n] if n <= window else [n % window] * bool(n % window) + [window] * (n // window)


