"""Plain versions of the corpus operators: slow, small, and written without the operators' code."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
INK = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(fold(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return fold(host), re.match(r"[^?#]*", rest[len(host):]).group()


def url_rule(host, path, rules):
    best = None
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def token_counts(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def byte_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def benchmark_hits(text, items):
    """(n_words, n_hit, item ids) with items as {id: text}."""
    own, hit, found = words(text), set(), set()
    for item, other in items.items():
        w = words(other)
        if not w:
            continue
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(own) - k + 1):
            if tuple(own[i : i + k]) in windows:
                hit.update(range(i, i + k))
                if item is not None:
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def base_counts(text):
    text = text or ""
    w = INK.findall(text)
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if times[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if INK.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def rule_verdicts(rows):
    """Whether the quality rules keep each (text, lang, source), with quartiles of sorted lists."""
    def bucket(count, size, top):
        rate = (count + 0.5) / (size + 1)
        rate = rate if top is None else rate / (top - rate) if rate < top else None
        return 10_000 if rate is None else math.ceil(math.log(rate) / math.log(1.02))

    facts = []
    for text, _, _ in rows:
        n, _, symbols, again, repeats = base_counts(text)
        text = text or ""
        lines = sum(1 for line in text.split("\n") if INK.search(line))
        upper = len(re.findall("[A-Z]", text))
        letters = len(re.findall("[A-Za-z]", text)) + sum(ord(c) > 127 for c in text)
        parts = [(symbols, n, None), (again, lines, 1.0), (repeats, n, 0.2), (upper, letters, 1.0)]
        facts.append((n >= 10 and 100 * repeats <= 20 * n, [(p[0], bucket(*p)) for p in parts]))

    def limits(keep):
        seen = {row[0] or "": f[1] for row, f in zip(rows, facts, strict=True) if f[0] and keep(row)}
        out = []
        for k in range(4):
            values = sorted(f[k][1] for f in seen.values())
            at = lambda q: values[max(math.ceil(q * len(values)), 1) - 1]
            out.append(at(0.75) + 3 * (at(0.75) - at(0.25)) if values else None)
        return len(seen), out

    out = []
    for (_, lang, source), (good, parts) in zip(rows, facts, strict=True):
        for keep in (lambda r: r[1:] == (lang, source), lambda r: r[1] == lang, lambda r: True):  # noqa: B023
            size, fences = limits(keep)
            if size >= 200:
                break
        out.append(good and all(c == 0 or b <= f for (c, b), f in zip(parts, fences, strict=True)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    """(start, kind index, end) in order."""
    return sorted(
        (m.start(), i, m.end()) for i, (p, good) in enumerate(PATTERNS.values()) for m in re.finditer(p, text or "") if good(m.group()))


def show(spans):
    names = [*PATTERNS, "term"]
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def entities(kind, value):
    """(entity, texts a term must share with it) of a value: itself and its recurring parts."""
    value = fold(value)
    digits = re.sub("[^0-9]", "", value)
    if kind == 0:
        local, domain = value.split("@", 1)[0], value.rsplit("@", 1)[1]
        return {(("email", value), 2), (("domain", domain), 3), *[(("name", n), 3) for n in re.findall("[a-z]{3,}", local)]}
    if kind == 1:
        return {(("ip", value), 2), (("network", value.rsplit(".", 1)[0]), 3)}
    return {(("card", digits), 2), (("issuer", digits[:6]), 3)} if kind == 2 else {(("phone", digits), 2), (("exchange", digits[:-7]), 3)}


def all_spans(texts, limit=0.9):
    """Base and term spans of each text, with the disclosure worked out in dictionaries over the different texts."""
    raw = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    base, places, held = {}, {}, {}
    for t in set(texts):
        base[t] = base_spans(t)
        blank = t
        for s, _, e in base[t]:
            blank = blank[:s] + " " * (e - s) + blank[e:]
        places[t] = [(fold(m.group()), m.start(), m.end()) for m in raw.finditer(blank)]
        held[t] = {x for s, k, e in base[t] for x in entities(k, t[s:e])}
    n, frequency = len(base), Counter(w for t in base for w in {fold(m) for m in raw.findall(t)})
    of, both = Counter(e for t in base for e in held[t]), Counter()
    for t in base:
        both.update((e, w) for e in held[t] for w in {w for w, _, _ in places[t]})
    telling = set()
    for (e, w), k in both.items():
        ic = math.log(n / of[e])
        if k >= e[1] and ic > 1e-9 and math.log(n * k / (of[e] * frequency[w])) / ic >= limit - 1e-9:
            telling.add((e, w))
    return [sorted([*base[t], *{(a, 4, b) for w, a, b in places[t] if any((e, w) in telling for e in held[t])}]) for t in texts]


def shingle_bags(texts):
    out = []
    for t in texts:
        w = words(t)
        out.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    return out


def near_classes(ids, texts, frequent=1 << 18, similar=0.8):
    """Class of each row (smallest id), from all pairs."""
    bags = shingle_bags(texts)
    df = Counter(s for b in bags for s in b)
    n, total = sum(1 for b in bags if b), sum(df.values())
    least = max(1, -(-total // frequent))
    weight = lambda s: 1 + math.log(n / min(max(df[s], least), n)) / math.log(max(n, 2))
    heavy = [{s: (1 + math.log(k)) * weight(s) for s, k in b.items()} for b in bags]
    where = defaultdict(list)
    for i, b in enumerate(heavy):
        for s in b:
            where[s].append(i)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, b in enumerate(heavy):
        for j in {j for s in b for j in where[s] if j < i}:
            both = sum(min(w, heavy[j].get(s, 0)) for s, w in b.items())
            if both >= (similar - 1e-9) * (sum(b.values()) + sum(heavy[j].values()) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(i)
    out = {}
    for members in groups.values():
        known = [ids[i] for i in members if ids[i] is not None]
        for i in members:
            out[i] = min(known) if bags[i] and known else ids[i]
    return [out[i] for i in range(len(ids))]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
