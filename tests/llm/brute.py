"""Brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import hashlib
import re

PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii_spans(text: str | None) -> list[tuple[int, int, int]]:
    """Valid base matches as (start, position of the kind, end)."""
    found = []
    for i, (kind, pattern) in enumerate(PII.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if ok:
                found.append((m.start(), i, m.end()))
    return sorted(found)


def pii_digest(spans) -> str:
    listed = ",".join(f"{list(PII)[k]}:{a}:{b}" for a, k, b in spans)
    return hashlib.sha256(listed.encode()).hexdigest()


def terms(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start() - 1, m.end() - 1) for m in re.finditer(r"(?<=[\W_])[^\W\d_]{3,24}(?=[\W_])", f" {text} ")]


WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingle_set(text: str | None, size: int) -> frozenset:
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def components(rows: list[tuple[int | None, str | None]], size: int, percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingle_set(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return out


def quality(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    seen: dict[tuple, list[int]] = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
        len(w) < 20 or 100 * len(hit) > 30 * len(w),
    )


def line_key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def dedup_lines(rows, least: int = 40, repeats: int = 5) -> list[tuple]:
    """(doc_id, text, n_lines, n_dropped) of each row."""
    held: dict[str, set] = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= least:
                held.setdefault(line_key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [
            len(ids := held.get(line_key(x), ())) >= repeats and doc_id != max(i for i in ids if i is not None) for x in lines
        ]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc_id, kept if any(gone) else text, len(lines), sum(gone)))
    return out


def contamination(rows, items, size: int = 13, of: int = 20) -> list[tuple]:
    """(doc_id, n_words, n_hit, items, contaminated) of each row."""
    split = lambda t: ITEM_WORD.findall((t or "").translate(LOWER))
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                owners = windows.get(tuple(w[i : i + n]))
                if owners:
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and of * len(hit) >= len(w)))
    return out
