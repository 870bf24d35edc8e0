"""Brute-force versions in plain Python, and rows with every kind of edge case."""

from __future__ import annotations

import collections
import hashlib
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, at int, digest string"


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, copies, and further columns whose names clash with inner ones."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "x30")
    texts = [None, "", " \t\n", "One two", "ONE TWO", "one  two", long, long.upper(), base, base, near, base + " tail", "É é", "é É", "a\nb\na\n\n a", "x " * 40, "$$$ ### " * 30]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or ""), "r", i, "d") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], rows[0], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def exact(rows: list[tuple]) -> collections.Counter:
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[lowered(text)].append(doc_id)
    out: collections.Counter = collections.Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out[(i, keep, len(ids), kept, hashlib.sha256(text).hexdigest())] += 1
    return out


def shingles(text: str | None, n: int) -> set:
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def near(rows: list[tuple], n: int, percent: int = 80) -> dict:
    """doc_id -> (size of each of its sets, component); rows that share an id are one document."""
    sets = [(r[0], shingles(r[1], n)) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def base_figures(text: str | None) -> tuple:
    text = text or ""
    word = r"[^\x20\x09-\x0D]+"
    words = re.findall(word, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(word, line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed
