"""Plain versions of the operators, one text or pair at a time, to compare results with."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(docs, percent=80):
    """{row number: (n_shingles, component id)} of (id, text) rows, comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(docs)]


def one_of_each(docs):
    """One row of each group of linked rows: the smallest id, null last; rows without words stay."""
    names = [(i, t) for i, (_, t) in enumerate(docs)]
    best = {}
    for i, n, c in components(names):
        if n:
            key = (docs[i][0] is None, docs[i][0] or 0, i)
            best[c] = min(best.get(c, key), key)
    return [docs[k[2]] for k in best.values()] + [docs[i] for i, n, _ in components(names) if not n]


def covered(docs, size=50):
    """For each (id, text) row, which of its words are covered by a window that a smaller id has too."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def without(text, gone):
    """The text without the marked words and what follows each up to the next word."""
    if not any(gone):
        return text
    keep, k = [], -1
    starts = {m.start() for m in WORD.finditer(text)}
    for i, c in enumerate(text):
        k += i in starts
        if not gone[max(k, 0)]:
            keep.append(c)
    return "".join(keep)


def base_statistics(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def more_statistics(text):
    text = text or ""
    w = words(text)
    letter = lambda c: c.isascii() and c.isalpha() or ord(c) > 127
    return {
        "n_lines": sum(bool(words(x)) for x in text.split("\n")), "n_letter_words": sum(any(map(letter, x)) for x in w), "n_fresh_words": sum(len(set(w[i : i + 200])) for i in range(0, len(w), 200)),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_letters": sum(len(c.encode()) for c in text if letter(c)), "n_marks": sum(c in ".,;:!?" for c in text),
    }


def votes(s):
    """The rules' votes on a document, in their order: 0 bad, 1 good, -1 abstain."""
    share = lambda a, b: s[a] / max(1, s[b])
    symbols, lettered, size, upper, marked = share("n_symbols", "n_words"), share("n_letter_words", "n_words"), share("word_chars", "n_words"), share("n_upper", "n_letters"), share("n_marks", "n_words")
    dense, repeated, fresh, twice = share("n_symbols", "word_chars"), share("n_repeat_words", "n_words"), share("n_fresh_words", "n_words"), share("n_dup_lines", "n_lines")
    many = s["n_lines"] > 4
    bad = [s["n_words"] < 60, symbols > 0.1, dense > 0.05, repeated > 0.15, many and twice > 0.15, lettered < 0.9, not 3.5 <= size <= 6.5, upper > 0.1, not 0.05 <= marked <= 0.3, fresh < 0.5, symbols > 0.3 or lettered < 0.8 or upper > 0.3 or marked > 0.6]
    good = [s["n_words"] >= 100, symbols <= 0.02, dense <= 0.005, repeated < 0.05, many and twice < 0.05, lettered > 0.97, 4 <= size <= 6, upper < 0.05, 0.08 <= marked <= 0.22, fresh > 0.65, symbols <= 0.02 and lettered > 0.95 and 0.05 <= marked <= 0.3 and 3.5 <= size <= 8 and upper < 0.1]
    return [0 if b else 1 if g else -1 for b, g in zip(bad, good)]


def statistics(text):
    return dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), base_statistics(text))) | more_statistics(text)


def base_failed(s):
    return s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]


def estimate(cast, rounds=500, pull=0.01):
    """(share of good, {(rule, vote): (rate on good, rate on bad)}) by expectation maximisation over single documents, in plain arithmetic."""
    n, kinds = len(cast), (0, 1, -1)
    usual = {0: (0.02, 0.45), 1: (0.58, 0.15), -1: (0.4, 0.4)}
    p = [0.1 if sum(v == 0 for v in row) >= 2 else 0.9 for row in cast]
    for _ in range(rounds):
        good = sum(p)
        prior = min(0.99, max(0.01, (good + 0.5) / (n + 1)))
        rates = {}
        for j in range(11):
            sides = []
            for side in (0, 1):
                mass = {v: sum((x, 1 - x)[side] for x, row in zip(p, cast) if row[j] == v) + pull * max(n, 1) * usual[v][side] for v in kinds}
                sides.append({v: m / sum(mass.values()) for v, m in mass.items()})
            for v in kinds:
                rates[j, v] = (sides[0][v], sides[1][v])
        new = [chance(prior, rates, row) for row in cast]
        moved = max((abs(a - b) for a, b in zip(new, p)), default=0)
        p = new
        if moved < 1e-9:
            break
    return prior, rates


def chance(prior, rates, row):
    good, bad = prior, 1 - prior
    for j, v in enumerate(row):
        good *= rates[j, v][0]
        bad *= rates[j, v][1]
    return good / (good + bad)


def verdicts(texts, threshold=0.5):
    """Whether each text is kept."""
    found = [statistics(t) for t in texts]
    prior, rates = estimate([votes(s) for s in found if not base_failed(s)])
    return [not base_failed(s) and chance(prior, rates, votes(s)) >= threshold for s in found]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), list(PATTERNS).index(kind), kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


WEIGHTS = {"email": (0.9, "e-?mail|mail|contact|write"), "ip": (0.6, "ip|host|server|address|login"), "card": (0.7, "card|credit|debit|visa|payment|karte|carte|tarjeta"), "phone": (0.6, "tel|phone|call|mobile|fax|telefon|téléphone|teléfono"), "iban": (0.8, "iban|bank|account|konto|compte|cuenta"), "ssn": (0.3, "ssn|social|security"), "routing": (0.3, "routing|aba"), "key": (0.9, "aws|access|key"), "secret": (0.3, None)}


def all_spans(text):
    """(kind, start, end, score) by the rules in words: each kind's pattern, its check, and the words within 48 characters."""
    text = text or ""
    found = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in base_spans(text)]
    inner = lambda i: 0 <= i < len(text) and text[i] in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    at = 0
    while at < len(text):  # bank accounts: a capital pair and two digits, then 11 to 30 more with single spaces between
        m = None if inner(at - 1) else re.compile(r"[A-Z][A-Z][0-9][0-9]( ?[A-Z0-9]){11,30}").match(text, at)
        done = at + 1
        if m:
            for end in range(at + 15, m.end() + 1):
                code = text[at:end].replace(" ", "")
                if text[end - 1] != " " and not inner(end) and len(code) >= 15 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                    found.append(("iban", at, end))
                    done = end
                    break
        at = done
    for m in re.finditer(r"(?<![0-9-])(\d{3})-(\d{2})-(\d{4})(?![0-9-])", text, re.A):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            found.append(("ssn", *m.span()))
    for m in re.finditer(r"(?<![0-9-])\d{9}(?![0-9-])", text, re.A):
        if m[0] != "0" * 9 and (3 * sum(map(int, m[0][::3])) + 7 * sum(map(int, m[0][1::3])) + sum(map(int, m[0][2::3]))) % 10 == 0:
            found.append(("routing", *m.span()))
    found += [("key", *m.span()) for m in re.finditer(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])", text)]
    for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        if len(m[0]) >= 16 and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            found.append(("secret", *m.span()))
    out = []
    for kind, a, b in found:
        base, words_ = WEIGHTS[kind]
        near = re.compile(rf"(?i)\b(?:{words_})\b" if words_ else r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|credential)s?(?![a-z])")
        score = base + 0.3 * bool(near.search(text[max(0, a - 48) : a]) or near.search(text[b : b + 48]))
        if kind in PATTERNS or score >= 0.5:
            out.append((kind, a, b, round(min(1.0, score), 3)))
    return sorted(out, key=lambda s: (s[1], list(WEIGHTS).index(s[0]), s[2]))


def pieces(ids, capacity=2048):
    """(piece, start, length, crc) of a document's ids, then id 0."""
    ids = [*ids, 0]
    return [(i, a, len(ids[a : a + capacity]), zlib.crc32(struct.pack(f"<{len(ids[a : a + capacity])}I", *ids[a : a + capacity]))) for i, a in enumerate(range(0, len(ids), capacity))]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
