"""Plain single-machine versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- personal data ------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_pii(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"\D", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return out


# -- language model -----------------------------------------------------------------------------------------------------

def crc_held_out(doc_id):
    import zlib

    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def lm_scores(rows, order, mu, add=0.1):
    """rows: (doc_id, text). Recursive definition of the model, straight from the counts."""
    texts = [("", *(WORD.findall((t or "").translate(LOWER))), "") for _, t in rows]
    counts = Counter()
    for (doc_id, _), seq in zip(rows, texts):
        if not crc_held_out(doc_id):
            for i in range(1, len(seq)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        counts[seq[i - k + 1 : i + 1]] += 1
    total = sum(v for g, v in counts.items() if len(g) == 1)
    types = sum(1 for g in counts if len(g) == 1)

    def chance(history, word):
        if not history:
            return (counts[(word,)] + add) / (total + add * (types + 1))
        c = counts[history]
        shorter = chance(history[1:], word)
        return (counts[(*history, word)] + mu * shorter) / (c + mu) if c else shorter

    out = []
    for (doc_id, _), seq in zip(rows, texts):
        score = base = 0.0
        known = 0
        for i in range(1, len(seq)):
            history = seq[max(0, i - order + 1) : i]
            score += math.log10(chance(history, seq[i]))
            base += math.log10(chance((), seq[i]))
            known += counts[(seq[i],)] > 0
        out.append((doc_id, crc_held_out(doc_id), len(seq) - 1, known, total, base, score))
    return out


# -- near duplicates ----------------------------------------------------------------------------------------------------

def shingle_counts(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def jaccard(a, b, weighted=False):
    keys = a.keys() | b.keys()
    if not keys:
        return 0.0
    if not weighted:
        return len(a.keys() & b.keys()) / len(keys)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def near_classes(rows, threshold=0.8, weighted=False):
    """{doc_id: class_id}: all pairs that share a shingle, equal texts always."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = {d: shingle_counts(t) for d, t in rows}
    by, same, seen = defaultdict(list), {}, set()
    for d, t in rows:
        find(d)
        first = same.setdefault(t or "", d)
        if first != d:
            a, b = sorted((find(first), find(d)))
            parent[b] = a
            continue
        for s in sets[d]:
            for e in by[s]:
                if (e, d) not in seen:
                    seen.add((e, d))
                    if jaccard(sets[d], sets[e], weighted) >= threshold:
                        a, b = sorted((find(e), find(d)))
                        if a != b:
                            parent[b] = a
            by[s].append(d)
    return {d: find(d) for d, _ in rows}


# -- repeated lines -----------------------------------------------------------------------------------------------------

def drop_repeats(rows, min_words=50):
    """{doc_id: text}: every line of a run of at least ``min_words`` words that has an earlier copy goes.

    Runs are looked for from each line on, and from each line back, in order of (doc_id, line)."""
    first, docs = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        docs[d] = [(i, line, len(WORD.findall(line))) for i, line in enumerate(lines) if WORD.search(line)]
    runs = defaultdict(list)
    for d, lines in docs.items():
        for i in range(len(lines)):
            for step in (1, -1):
                j, words = i, 0
                while 0 <= j < len(lines):
                    words += lines[j][2]
                    if words >= min_words:
                        a, b = min(i, j), max(i, j)
                        runs[d].append((a, b))
                        key = tuple(x[1] for x in lines[a : b + 1])
                        first[key] = min(first.get(key, (d, a)), (d, a))
                        break
                    j += step
    out = {}
    for d, t in rows:
        gone = set()
        for a, b in runs[d]:
            if first[tuple(x[1] for x in docs[d][a : b + 1])] != (d, a):
                gone |= {docs[d][k][0] for k in range(a, b + 1)}
        out[d] = t if not gone else "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)
    return out
