"""Plain versions of the operators' contracts."""

import hashlib
import re
from collections import Counter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = r"[^\x20\x09-\x0D]+"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def repeated(units, k):
    """(flags of removed units) by document: windows of k units that a smaller document also has."""
    least = {}
    for i in sorted(units):
        for j in range(len(units[i]) - k + 1):
            least.setdefault(tuple(units[i][j : j + k]), i)
    out = {}
    for i, u in units.items():
        g = [0] * len(u)
        for j in range(len(u) - k + 1):
            if least[tuple(u[j : j + k])] < i:
                g[j : j + k] = [1] * k
        out[i] = g
    return out


def windows(texts, k=50):
    w = {i: re.findall(BLANK, t or "") for i, t in texts.items()}
    g = repeated(w, k)
    return {i: (len(w[i]), sum(g[i]), sha(" ".join(x for x, y in zip(w[i], g[i], strict=True) if not y))) for i in w}


def byte_strings(texts, k=50):
    b = {i: (t or "").encode() for i, t in texts.items()}
    g = repeated(b, k)
    runs = lambda f: sum(1 for j, x in enumerate(f) if x and not (j and f[j - 1]))
    return {i: (len(b[i]), sum(g[i]), runs(g[i]), sha(bytes(x for x, y in zip(b[i], g[i], strict=True) if not y))) for i in b}


def contaminated(texts, items, k=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    found = {}
    for name, t in items:
        w = words(t)
        n = min(k, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            found.setdefault(tuple(w[j : j + n]), set()).add(str(name))
    sizes, out = {len(x) for x in found}, {}
    for i, t in texts.items():
        w = words(t)
        g, its = [0] * len(w), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if x := found.get(tuple(w[j : j + n])):
                    its |= x
                    g[j : j + n] = [1] * n
        out[i] = (len(w), sum(g), sorted(its), bool(sum(g) and 20 * sum(g) >= len(w)))
    return out


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            n = [int(c) for c in d][::-1]
            return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(n)) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if good(k, m[0])] for k, p in KINDS.items()}


def shingles(text, k=4):
    w = re.findall(BLANK, (text or "").translate(LOW))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts):
    s = {i: shingles(t) for i, t in texts.items()}
    top = {i: i for i in s}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(s[i]), root(i)) for i in s}


def rules(text):
    text = text or ""
    w = re.findall(BLANK, text)
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    g = [0] * len(w)
    for j in range(len(w) - 7):
        if c[tuple(w[j : j + 8])] > 1:
            g[j : j + 8] = [1] * 8
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(g), len(w) < 20 or 100 * sum(g) > 30 * len(w)


def bootstrap(texts):
    """Spans of each text: fixed patterns, then rounds of pattern scoring in plain loops (all words under 64 characters)."""
    import math
    from collections import defaultdict

    order = ["email", "ip", "card", "phone"]
    edge, stop = ".,;:!?()[]{}<>\"'", ".,;:!?\"'"
    rows, uses = [], Counter()  # (text, start, end, kind, value, single, patterns)
    for i, t in enumerate(texts):
        toks = [m.span() for m in re.finditer(BLANK, t)]
        words = [t[a:b].translate(LOW) for a, b in toks]
        for n in (1, 2, 3):
            uses.update(" ".join(words[k : k + n]) for k in range(len(words) - n + 1))
        base = [(a, b, k, True) for k, x in personal(t).items() for a, b in x]
        inst = list(base)
        for k, (a, b) in enumerate(toks):
            core = t[a:b].strip(edge)
            if core and re.search("[0-9@]", core) and not any(x < b and y > a for x, y, _, _ in base):
                inst.append((a + t[a:b].index(core), a + t[a:b].index(core) + len(core), None, True))
            for n in (2, 3, 4):
                run = toks[k : k + n]
                parts = [t[x:y] for x, y in run]
                whole = t[a : run[-1][1]]
                plain = [re.fullmatch(r"[+(]*[0-9][0-9().+-]*", p.rstrip(stop)) for p in parts]
                if len(run) == n and all(plain) and " ".join(parts) == whole and all(p == p.rstrip(stop) for p in parts[:-1]):
                    end = a + len(whole.rstrip(stop))
                    if 8 <= len(re.findall("[0-9]", t[a:end])) <= 19 and not any(x < run[-1][1] and y > a for x, y, _, _ in base):
                        inst.append((a, end, None, False))
        for a, b, kind, single in inst:
            f = max(k for k, x in enumerate(toks) if x[0] <= a)
            g = min(k for k, x in enumerate(toks) if x[1] >= b)
            p = ["=" + re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]", "9", t[a:b]))]
            if not t[toks[f][0] : a].strip(edge):
                p += ["<" + " ".join(words[f - n : f]) for n in (1, 2, 3) if f - n >= 0]
            if not t[b : toks[g][1]].strip(edge):
                p += [">" + " ".join(words[g + 1 : g + 1 + n]) for n in (1, 2, 3) if g + n < len(words)]
            rows.append((i, a, b, kind, t[a:b].lower(), single, p))

    def shape(v):
        if "@" in v:
            return "email"
        if re.fullmatch(r"[0-9]+([.][0-9]+){3}", v):
            return "ip"
        if re.search("[^0-9+() ./-]", v):
            return None
        return "card" if len(re.findall("[0-9]", v)) >= 16 else "phone"

    values, hits = defaultdict(set), Counter()
    for *_, v, single, p in rows:
        for x in p:
            values[x].add(v)
            hits[x] += single
    may = {x for x in values if len(values[x]) >= 3 and (x[0] == "=" or hits[x] >= 0.5 * uses[x[1:]])}
    seeds = {(r[4], r[3]) for r in rows if r[3]}
    seen = {v for v, _ in seeds}
    known, new = {s: 1.0 for s in seeds}, None
    while True:
        score = {}
        for x in may:
            for kind in order:
                own = [known[v, kind] for v in values[x] if (v, kind) in known]
                rest = [v for v in values[x] if v not in seen and shape(v) in (None, kind) and (v, kind) not in known]
                if len(own) >= 3 and sum(own) / (len(own) + len(rest)) >= 0.3:
                    score[x, kind] = sum(own) / (len(own) + len(rest)) * math.log2(sum(own))
        score = {k: min(s, 1.0) for k, s in score.items() if s >= 0.8}
        best = {}
        for (x, kind), s in score.items():
            for v in values[x] - seen:
                if shape(v) in (None, kind):
                    best[v] = max(best.get(v, (0, "")), (s, kind))
        if len(best) == new:
            break
        new = len(best)
        known = {s: 1.0 for s in seeds} | {(v, k): s for v, (s, k) in best.items()}
    out = {i: {(order.index(k), a, b) for j, a, b, k, *_ in rows if j == i and k} for i in range(len(texts))}
    added = defaultdict(list)
    for i, a, b, kind, v, _, p in rows:
        if not kind and v in best and (len(re.findall("[0-9]", v)) >= 5 or "@" in v or any((x, best[v][1]) in score for x in p)):
            added[i].append((order.index(best[v][1]), a, b))
    for i, spans in added.items():
        out[i] |= {s for s in spans if not any(o != s and o[0] == s[0] and o[1] <= s[1] and o[2] >= s[2] for o in spans)}
    return {i: ",".join(f"{order[k]}:{a}:{b}" for k, a, b in sorted(x)) for i, x in out.items()}


def repeated_rows(ids, units, key, k=50):
    """Flags of removed units for each row: windows that also start in a row with a smaller id; null ids are never compared."""
    least = {}
    for i, u in zip(ids, units, strict=True):
        if i is not None:
            for j in range(len(u) - k + 1):
                x = key(u, j)
                least[x] = min(i, least.get(x, i))
    out = []
    for i, u in zip(ids, units, strict=True):
        g = [0] * len(u)
        if i is not None:
            for j in range(len(u) - k + 1):
                if least[key(u, j)] < i:
                    g[j : j + k] = [1] * k
        out.append(g)
    return out
