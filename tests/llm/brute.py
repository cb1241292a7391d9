"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def words(text):
    return WORDS.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(texts, width):
    """(n_words, n_removed, digest of the rest) of each text."""
    lists = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for w in lists:
        gone = {k for i in range(len(w) - width + 1) if seen[tuple(w[i:i + width])] > 1 for k in range(i, i + width)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def base_rules(text):
    w, lines, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in lines
            lines.add(line)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeat = {k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat), len(w) < 10 or 100 * len(repeat) > 20 * len(w)


def hits(text, items, window=13):
    """(n_words, n_hit, item ids) of a text."""
    windows = defaultdict(set)
    for k, t in items:
        w = ITEM_WORDS.findall(lower(t))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i:i + window])].add(k)
    w, hit, found = ITEM_WORDS.findall(lower(text)), set(), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if got := windows.get(tuple(w[i:i + n])):
                hit.update(range(i, i + n))
                found |= got
    return len(w), len(hit), found


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    """kind:start:end of the base matches."""
    def fits(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text or "") if fits(k, m.group())]


def near_classes(rows, least=0.8):
    """Least id of each row's class, by all pairs of the multisets of five-word shingles."""
    bags = {}
    for k, t in rows:
        w = words(t)
        bags[k] = Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)) if w)
    parent = {k: k for k in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    keys = sorted(bags)
    for n, a in enumerate(keys):
        for b in keys[n + 1:]:
            shared = sum((bags[a] & bags[b]).values())
            if shared and shared >= least * sum((bags[a] | bags[b]).values()):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def unigram(rows):
    """(n_tokens, n_known, train_tokens, base score) of each row."""
    def held(k):
        return zlib.crc32(str(k).encode()) % 10 == 0
    training = [words(lower(t)) for k, t in rows if not held(k)]
    count = Counter(w for x in training for w in x)
    total, kinds = sum(count.values()) + len(training), len(count) + 1
    scale = total + 0.1 * (kinds + 1)
    out = {}
    for k, t in rows:
        w = words(lower(t))
        out[k] = (len(w) + 1, sum(count[x] > 0 for x in w) + 1, total,
                  sum(math.log10((count[x] + 0.1) / scale) for x in w) + math.log10((len(training) + 0.1) / scale))
    return out


def dedup_lines(rows):
    """Text of each row without the lines of two neighbouring lines with words that occur before, blank lines between them too."""
    seen, out = set(), {}
    for k, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        worded = [i for i, line in enumerate(lines) if WORDS.search(line)]
        for i, j in zip(worded, worded[1:]):
            if (lines[i], lines[j]) in seen:
                gone.update(range(i, j + 1))
            seen.add((lines[i], lines[j]))
        out[k] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out
