"""License scans against plain Python: every rule at every word, every pair of detections."""

from __future__ import annotations

import random
import re

from tests.llm import brute
from vellum.llm import licenses as L


def words_of(text: str | None) -> list[str]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text: str | None, table: tuple[L.Rule, ...] = L.RULES) -> tuple:
    words = words_of(text)
    seen = []
    for i in range(len(words)):
        ahead = " ".join(words[i : i + L.SPAN])
        for n, r in enumerate(table):
            if words[i] == r.anchor and r.keyword in ahead and r.keyword in words and (m := re.match(f"(?:{r.pattern})(?= |$)", ahead)):
                seen.append((i, i + len(m[0].split(" ")), r.priority, n, r.label, r.base))

    def hides(e: tuple, d: tuple) -> bool:
        inside = e[0] <= d[0] and d[1] <= e[1] and e[2] <= d[2]
        return inside and (e[0], -e[1], e[2], e[3]) < (d[0], -d[1], d[2], d[3])

    kept = [d for d in seen if d[5] or not any(hides(e, d) for e in seen)]
    places = []
    for phrase, label in L.BASE:  # counted on the words themselves
        p = phrase.split(" ")
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    joined = lambda labels: ",".join(sorted(set(labels)))
    score = max((L.CONFIDENCE[d[2]] for d in kept), default=0.0)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), joined(x for _, x in places), joined(d[4] for d in kept), score


FIXED = [
    "Released under the MIT License.", "under  the-MIT\nlicense", "UNDER THE MİT LICENSE", "Licensed under the Apache License, Version 2.0.", "apache license version 20",
    "CC BY-NC-SA 4.0 and cc by nc", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0", "gplv3 or GPL v2 or lgpl-2.1, AGPLv3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Neither the name of the Foo Bar nor the names of its contributors may be used to endorse",
    "mit", "the mit licensed", "licensed under the licence", "public domain", "under the mit license " * 3000, "license " * 5000, "gnu " * 400 + "gpl 3",
]


def check(spark, texts: list[tuple]) -> None:
    rows = L.license_scan(spark.createDataFrame(texts, "doc_id long, text string, words string, _keys int")).collect()
    want = sorted(repr((i, *plain(t))) for i, t, *_ in texts)
    assert sorted(repr(tuple(r)) for r in rows) == want


def test_fixed_texts_and_edge_rows(spark):
    texts = [r[1] for r in brute.edge_rows()] + FIXED
    check(spark, [(i, t, "w", 1) for i, t in enumerate(texts)] + [(None, "cc by nc", None, None), (1, None, None, None), (1, None, None, None)])


def test_random_words_of_the_rules(spark):
    r = random.Random(5)
    parts = sorted({w for rule in L.RULES for w in re.findall(r"[a-z0-9]+", rule.pattern)})
    pieces = [p for p, _ in L.BASE] + [re.sub(r"\(\?:[^()]*\)\??|\[sc\]|[?\\^$]", lambda m: "c" if m[0] == "[sc]" else "", x.pattern) for x in L.RULES[::7]]
    texts = [" ".join(r.choice(parts if r.random() < 0.5 else pieces) for _ in range(r.randint(0, 40))) for _ in range(150)]
    check(spark, [(i, t, None, None) for i, t in enumerate(texts)])


def test_spans_of_an_operator_run(spark):
    docs = spark.createDataFrame([(1, "It is licensed under the MIT license, see gpl-3.0.")], "doc_id long, text string")
    row = L.scan(docs).first()
    assert [(d.start, d.end, d.label, d.base) for d in row.kept] == [(2, 7, "mit", False), (3, 7, "mit", True), (8, 11, "gpl-3", False)]
    assert {(d.start, d.end, d.label) for d in row.found} > {(5, 7, "mit"), (8, 9, "gpl")}
    assert L.license_scan(docs.limit(0)).count() == 0


def test_rules_are_bounded():
    assert len(L.RULES) > 300
    for r in L.RULES:
        assert re.match(r"[a-z0-9]+$", r.anchor) and re.match(re.escape(r.anchor) + r"(?![a-z0-9])", r.pattern), r
        longest = re.sub(r"\(\?:\\S\+ \)\{1,8\}", "x " * 8, r.pattern)
        assert len(re.findall(r"[^ ()|?:\\]+", longest)) <= L.SPAN, r
