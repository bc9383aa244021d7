"""Plain-Python versions of the operators' rules."""
import re
from collections import Counter, defaultdict


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(x))


def shingles(x, width):
    w = words(x)
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_components(rows, width, percent=80):
    """id -> smallest id reachable; rows: (id, text)."""
    sets = [(i, shingles(x, width)) for i, x in rows if i is not None]
    par = {i: i for i, _ in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    at = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            at[g].append(k)
    for k, (i, s) in enumerate(sets):
        same = Counter(m for g in s for m in at[g] if m > k)
        for m, n in same.items():
            j, t = sets[m]
            if 100 * n >= percent * (len(s) + len(t) - n):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return {i: find(i) for i in par}


def repeats(texts, length):
    """Per text: (bytes, removed, runs, kept bytes)."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                mark[k:k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((len(b), sum(mark), runs, bytes(x for x, m in zip(b, mark) if not m)))
    return out


def bench_words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))


def contaminated(texts, items, window=13):
    """Per text: (words, hit words, sorted item ids)."""
    win = defaultdict(set)
    for i, x in items:
        w = bench_words(x)
        for k in range(max(len(w) - window + 1, 1 if w else 0)):
            win[tuple(w[k:k + window])].add("" if i is None else str(i))
    sizes = {len(w) for w in win}
    out = []
    for x in texts:
        w, hit, found = bench_words(x), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in win:
                    hit.update(range(k, k + n))
                    found |= win[tuple(w[k:k + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


SECRETS = [("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 1, 12),
           ("access", r"(AKIA[A-Z0-9]+)", 0, 1, 18), ("hex", r"([0-9a-f]+)", 0, 1, 16)]


def secret_spans(x):
    """(start, kind number, kind, end, value)."""
    out = []
    for k, (kind, pattern, flags, group, least) in enumerate(SECRETS):
        out += [(m.start(), k, kind, m.end(), m[group]) for m in re.finditer(pattern, x or "", flags)
                if len(m[group]) >= least]
    return sorted(out)
