"""Operators that SQL can't express, against plain Python."""

from __future__ import annotations

import collections
import math
import random

from pyspark.sql import functions as F

from vellum.functions import geometry as G, text as T, wrapping
from vellum.operators.graph import connected_components
from vellum.operators.ordering import insertion_order
from vellum.operators.regions import line_components, regions, split_shared
from vellum.sources.config import config
from vellum.sources.scratch import Scratch, clean
from vellum.sources.tables import read_dictionary
from vellum.streaming.limits import over_limit

BOXES = "page_id long, line_id long, x long, y long, w long, h long"


def components(nodes, edges):
    near = {n: {n} for n in nodes}
    for u, v in edges:
        near[u].add(v), near[v].add(u)
    out = {}
    for n in sorted(nodes):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += near[x]
    return out


def test_components_of_chains_stars_and_random_graphs(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)] + [(7, 7), (None, 3)]
    with Scratch(spark, "test") as scratch:
        got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == components({n for e in real for n in e}, real)


def test_no_edges_no_components(spark):
    with Scratch(spark, "test") as scratch:
        assert connected_components(spark.createDataFrame([], "u long, v long"), scratch).count() == 0


def test_shortest_period(spark):
    rows = [("abcabca", "abc"), ("aaaa", "a"), ("abc", "abc"), ("", ""), ("abab", "ab")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", T.shortest_period(F.col("t")))
    assert [r.got for r in df.collect()] == [r[1] for r in rows]


def test_cleaned(spark):
    rows = [("hello there", "Hi ,you!Yes", "Hi, you! Yes"), ("a long query text", "ha ha ha", "ha " * 5), ("q", "", ""), ("abcdefghijkl", "ababab", "ab" * 6), ("x y", "a  b", "a b")]
    df = spark.createDataFrame(rows, "q string, t string, want string").withColumn("got", T.cleaned(F.col("q"), F.col("t")))
    assert [r.got for r in df.collect()] == [r[2] for r in rows]


def test_joined_text_leaves_no_space_at_dense_letters(spark):
    df = spark.createDataFrame([(["日本", "語", "a", "b"],)], "t array<string>")
    assert df.select(T.joined(F.col("t"))).first()[0] == "日本語a b"


def test_regions_of_a_page(spark):
    lines = [(1, 1, 0, 0, 40, 10), (1, 2, 0, 12, 40, 10), (1, 3, 300, 300, 40, 10), (1, 4, 0, 24, 40, 10)]
    with Scratch(spark, "test") as scratch:
        got = {r.line_id: r.region_id for r in regions(spark.createDataFrame(lines, BOXES), scratch).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 3: 3}


def gap_of(a, b):
    return math.hypot(max(b[0] - a[0] - a[2], a[0] - b[0] - b[2], 0), max(b[1] - a[1] - a[3], a[1] - b[1] - b[3], 0))


def merges(a, b):
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    fa, fb, d = min(aw, ah), min(bw, bh), gap_of(a, b)
    size = min(fa, fb)
    if d > 2 * size or max(fa, fb) / size > 2 or d >= size:
        return False
    if (aw / ah > 1.3 and bw / bh < 1 / 1.3) or (bw / bh > 1.3 and aw / ah < 1 / 1.3):
        return False
    if abs(ax + aw // 2 - bx - bw // 2) < 3:
        return True
    wide, tall = lambda w, h: w > 1.9 * h, lambda w, h: h > 1.9 * w
    if (wide(aw, ah) and tall(bw, bh)) or (wide(bw, bh) and tall(aw, ah)):
        return False
    if wide(aw, ah) or wide(bw, bh):
        return min(abs(ax - bx), abs(ax + aw - bx - bw)) < 3 * size
    if tall(aw, ah) or tall(bw, bh):
        return min(abs(ay - by), abs(ay + ah - by - bh)) < 3 * size
    return False


def spanning(nodes, boxes):
    """Prim's tree: (weight, u, v), heaviest first."""
    inside, edges = [nodes[0]], []
    while len(inside) < len(nodes):
        edges.append(min((gap_of(boxes[u], boxes[v]), min(u, v), max(u, v), v) for u in inside for v in nodes if v not in inside))
        inside.append(edges[-1][3])
    return sorted(([e[:3] for e in edges]), key=lambda e: (-e[0], e[1], e[2]))


def split(nodes, boxes):
    font = {k: min(boxes[k][2:]) for k in nodes}
    if len(nodes) == 1:
        return [nodes]
    if len(nodes) == 2:
        u, v = nodes
        return [nodes] if gap_of(boxes[u], boxes[v]) < 1.5 * max(font[u], font[v]) else [[u], [v]]
    edges = spanning(nodes, boxes)
    far = [e[0] for e in edges]
    mean, spread = sum(far) / len(far), math.sqrt(sum((x - sum(far) / len(far)) ** 2 for x in far) / len(far))
    size = sum(font.values()) / len(font)
    _, u, v = edges[0]
    centre = lambda k: (boxes[k][0] + boxes[k][2] / 2, boxes[k][1] + boxes[k][3] / 2)
    aligned = min(abs(p - q) for p, q in zip(centre(u), centre(v)))
    if (far[0] <= mean + 2 * spread or far[0] <= 1.5 * size) and (spread < max(0.3 * size + 5, 5) or (far[0] == 0 and aligned < 5)):
        return [nodes]
    groups = {}
    for n, c in components(nodes, [e[1:] for e in edges[1:]]).items():
        groups.setdefault(c, []).append(n)
    return [x for g in groups.values() for x in split(sorted(g), boxes)]


def test_regions_equal_brute_force(spark):
    r = random.Random(9)
    rows = []
    for page in range(60):
        for line in range(1, r.randrange(2, 16)):
            wide = r.random() < 0.7
            a, b = r.uniform(60, 100), r.uniform(14, 22)
            # places and sizes have no two equal gaps, so trees are the same whatever their ties
            rows.append((page, line, round(r.uniform(0, 160), 3), round(r.uniform(0, 160), 3), round(a if wide else b, 3), round(b if wide else a, 3)))
    with Scratch(spark, "test") as scratch:
        got = {(x.page_id, x.line_id): (x.region_id, round(x.tree_weight, 6)) for x in regions(spark.createDataFrame(rows, "page_id long, line_id long, x double, y double, w double, h double"), scratch).collect()}
    want = {}
    for page in {x[0] for x in rows}:
        boxes = {x[1]: x[2:] for x in rows if x[0] == page}
        groups = {}
        for n, c in components(list(boxes), [(u, v) for u in boxes for v in boxes if u < v and merges(boxes[u], boxes[v])]).items():
            groups.setdefault(c, []).append(n)
        for nodes in map(sorted, groups.values()):
            weight = round(sum(e[0] for e in spanning(nodes, boxes)), 6)
            for part in split(nodes, boxes):
                want |= {(page, k): (min(part), weight) for k in part}
    assert got == want and len({v for v in want.values()}) < len(want)


def test_a_page_of_many_lines_has_its_own_components(spark):
    """5,000 lines of one page, in rows of overlapping pairs, beside another page."""
    rows = [(1, k, (k % 2) * 20, (k // 2) * 100, 30, 10) for k in range(5000)] + [(2, k, 0, k * 100, 30, 10) for k in range(3)]
    with Scratch(spark, "test") as scratch:
        got = line_components(spark.createDataFrame(rows, BOXES), scratch).groupBy("page_id", "component").count().collect()
    assert collections.Counter((x.page_id, x["count"]) for x in got) == {(1, 2): 2500, (2, 1): 3}


def test_insertion_order_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(page, line, r.randrange(200), r.randrange(120), r.randrange(5, 60), r.randrange(5, 60)) for page in range(50) for line in range(1, r.randrange(2, 14))]
    for right_to_left in (True, False):
        want = {}
        for page in {x[0] for x in rows}:
            placed = []
            for _, k, x, y, w, h in sorted((b for b in rows if b[0] == page), key=lambda b: (b[3] + b[5] / 2, b[1])):
                cx, cy = x + w / 2, y + h / 2
                for at, (_, px, py, pw, ph) in enumerate(placed):
                    if cy > py + ph:
                        continue
                    if cy < py or (cx > px + pw / 2 if right_to_left else cx < px + pw / 2):
                        placed.insert(at, (k, x, y, w, h))
                        break
                else:
                    placed.append((k, x, y, w, h))
            want |= {(page, b[0]): n for n, b in enumerate(placed, 1)}
        got = insertion_order(spark.createDataFrame(rows, BOXES), right_to_left).collect()
        assert {(b.page_id, b.line_id): b.place for b in got} == want


def test_vertical_wrap_equals_brute_force(spark):
    r = random.Random(6)
    texts = ["", " ", "   a b", "字字字字", "a" * 30] + ["".join(r.choice("ab 字、(") for _ in range(r.randrange(1, 60))) for _ in range(30)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.wrapped_columns(F.col("t"), F.lit(50), F.lit(20), F.lit(12)).alias("c"))
    forms = dict(zip(T.HORIZONTAL_MARKS, T.VERTICAL_MARKS))
    for row in df.collect():
        lines, line, height = [], "", 0
        for c in texts[row.k]:
            if height == 0 and c == " ":
                continue
            tall = 12 if ord(c) < 128 else 20
            if height + tall > 50:
                lines.append((line, height))
                line, height = "", 0
            line, height = line + forms.get(c, c), height + tall
        assert [(x.text, x.height) for x in row.c] == [*lines, (line, height)]


def test_horizontal_wrap():
    W = wrapping
    size = 20  # letters 11 wide, spaces 6, hyphens 7
    assert W.wrap("", size, 300, 200) == []
    assert W.wrap("one two three", size, 300, 200) == [("one two three", 11 * 11 + 2 * 6)]
    assert [t for t, _ in W.wrap("one two three", size, 60, 200)] == ["one", "two", "three"]
    assert [t for t, _ in W.wrap("aaaaaaaaaaaaaaaaaa bb", size, 70, 400)] == ["aaaaaa", "aaaaaa", "aaaaaa", "bb"]
    assert [t for t, _ in W.wrap("字字字字字 字", size, 60, 200, "ja_JP")] == ["字字字", "字字 字"]
    r = random.Random(4)
    for _ in range(300):
        words = ["".join(r.choice("abei字") for _ in range(r.randrange(1, 24))) for _ in range(r.randrange(1, 14))]
        w, h = r.randrange(20, 300), r.randrange(20, 300)
        lines = W.wrap(" ".join(words), size, w, h)
        assert "".join(t for t, _ in lines).replace(" ", "") == "".join(words)
        assert all(n == W.width(t, size) for t, n in lines)
        wide, _ = W.grown(words, size, max(w, 2 * size), h)
        assert all(n <= wide + W.width("-", size) + size for _, n in lines)  # a line may take a fragment under the font size
        # no line could have taken the next one's first word whole
        for (a, n), (b, _) in zip(lines, lines[1:]):
            first = b.split(" ")[0]
            if first in words and a.split(" ")[-1] in words:
                assert n + W.width(" ", size) + W.width(first, size) > wide or W.width(first, size) <= size


def test_largest_font_equals_a_search_over_all_sizes(spark):
    """In lines and in columns; of all sizes that may be tried the largest that fits, laid out anew for each."""
    W = wrapping
    texts = [("some words to set", 200.0, 100.0), ("a", 60.0, 60.0), ("long text " * 40, 400.0, 300.0), ("字字字 字字字字字", 90.0, 140.0), ("", 50.0, 50.0), ("one more line of text here", 300.0, 900.0), ("x" * 60, 70.0, 240.0)]
    rows = [(f"{k}{c}{wide}", t, w, h, 24, "en_US", c, float(len(t)), wide) for k, (t, w, h) in enumerate(texts) for c in (0.2, 0.6) for wide in (True, False)]
    df = spark.createDataFrame([*rows, ("none", None, 9.0, 9.0, 24, "en_US", 0.5, 1.0, True)], "k string, t string, w double, h double, first int, lang string, c double, places double, wide boolean")
    got = {r.k: r.font for r in W.fitted_font(df, "t", "w", "h", "first", "lang", "c", "places", horizontal=F.col("wide")).collect()}
    assert got.pop("none") is None and len(got) == len(rows)
    for k, t, w, h, first, lang, c, places, wide in rows:
        side = min(w, h)
        dense, unsure = max(0.0, min(1.0, (places / side - 0.22) / 0.35)), c < 0.45
        margin = max(4, int(side * (max(0.02, min(0.10, 7 / side)) * (0.85 if unsure else 1.0) * (1 + 0.2 * dense))))
        most = min(int(side * 0.56), 40) if side < 80 else int(40 + (side - 80) * 0.30) if side < 200 else min(int(side * 0.44), 168)
        most = max(min(round(most * (1 - 0.12 * dense)), int(max(first * (3.2 if unsure else 2.6), 18))), 16)
        across, along = (max(1.0, base + (0.03 if unsure else 0) - 0.03 * dense) for base in (1.01, 1.02))
        fit = [10]
        for size in range(10, most + 1):
            if wide:
                lines = [n for _, n in W.wrap(t, size, max(2 * margin, w - 2 * margin), max(2 * margin, h - 2 * margin))]
                gap, down, over = max(int(size * 0.15), 3), h, w
            else:
                lines, room = [0], max(2 * margin, h - 2 * margin)
                for ch in t:
                    n = math.floor(size * 0.6) if ord(ch) < 128 else size
                    if lines[-1] == 0 and ch == " ":
                        continue
                    lines = [*lines, n] if lines[-1] + n > room else [*lines[:-1], lines[-1] + n]
                gap, down, over = max(int(size * 0.10), 2), w, h
            if size * len(lines) + gap * max(0, len(lines) - 1) + 2 * margin <= down * across and max(lines, default=0) + 2 * margin <= over * along:
                fit.append(size)
        assert got[k] == max(fit), k


def plain_breaks(word, patterns, left=2, right=3):
    """Every pattern at every place."""
    marked, best = f".{word.lower()}.", {}
    for p in patterns:
        letters = "".join(c for c in p if not c.isdigit())
        for start in range(len(marked) - len(letters) + 1):
            if marked[start : start + len(letters)] == letters:
                at = start
                for c in p:
                    if c.isdigit():
                        best[at] = max(best.get(at, 0), int(c))
                    else:
                        at += 1
    cuts = [k for k in range(left, len(word) - right + 1) if best.get(k + 1, 0) % 2]
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]


def test_hyphenator_equals_every_pattern_at_every_place():
    r = random.Random(9)
    patterns = ["a1b", "1ba", "ab2b", ".ab3c", "c1c", "2c1a.", "b1c", "a3a1b", "1c2b", "b4b"] + ["".join(r.choice("abc") + r.choice(["", "", "1", "2", "3"]) for _ in range(r.randrange(1, 5))) for _ in range(40)]
    held = wrapping.Patterns(patterns)
    for _ in range(400):
        word = "".join(r.choice("abcABd") for _ in range(r.randrange(3, 30)))
        assert held.breaks(word) == plain_breaks(word, patterns)
        n = len(word)
        assert wrapping.parts_of(word, "en", held) == (held.breaks(word) if 10 <= n <= 100 else wrapping.parts_of(word, "en"))
        assert wrapping.parts_of(word, "ja", held) == [word]


def test_hyphenated_lines_are_filled_from_those_after_them():
    W, size = wrapping, 20
    held = W.Patterns(["a1b", "b1a", "e1i", "i1b"])
    r = random.Random(10)
    fewer = 0
    for _ in range(300):
        words = ["".join(r.choice("abei") for _ in range(r.randrange(1, 24))) for _ in range(r.randrange(2, 14))]
        w, h = r.randrange(60, 300), r.randrange(20, 80)
        lines, without = W.wrap(" ".join(words), size, w, h, "en", held), W.wrap(" ".join(words), size, w, h, "en")
        shown = "".join(t[:-1] if t.endswith("-") else t + " " for t, _ in lines)
        assert shown.replace(" ", "") == "".join(words)
        assert all(n == W.width(t, size) for t, n in lines)
        for word in shown.split(" "):
            assert word == "" or word in words or len(word) > 9
        fewer += len(lines) < len(without)
    assert fewer >= 1
    # parts go back while they leave room, the join of one word takes no space, an emptied line goes
    lines = [[(0, 0, 1)], [(1, 0, 3)], [(2, 0, 1)]]
    W.filled_back(lines, [[30], [20, 20, 20], [10]], 5, 100)
    assert lines == [[(0, 0, 1), (1, 0, 3), ], [(2, 0, 1)]]
    lines = [[(0, 0, 1)], [(1, 0, 3)], [(2, 0, 1)]]
    W.filled_back(lines, [[30], [20, 20, 20], [10]], 5, 76)
    assert lines == [[(0, 0, 1), (1, 0, 2)], [(1, 2, 3), (2, 0, 1)]]  # 76 - 60 leaves 11 beside the space
    lines = [[(0, 0, 1)], [(1, 0, 3)], [(2, 0, 1)]]
    W.filled_back(lines, [[30], [20, 20, 20], [12]], 5, 76)
    assert lines == [[(0, 0, 1), (1, 0, 2)], [(1, 2, 3)], [(2, 0, 1)]]


def test_parts_agree_with_the_column_form(spark):
    r = random.Random(7)
    words = ["".join(r.choice("aeioubcdst") for _ in range(r.randrange(1, 20))) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.syllables(F.col("w"), F.lit("en")).alias("s"))
    assert all(x.s == wrapping.parts_of(x.w, "en") for x in df.collect())

    def plain(word):
        out, now = [], ""
        for i, c in enumerate(word):
            now += c
            if len(now) >= 2 and c in "aeiou" and i + 1 < len(word) and word[i + 1] not in "aeiou":
                out.append(now)
                now = ""
        return [*out, now] if now else out

    for w in words:
        if 4 <= len(w) <= 9:
            assert wrapping.parts_of(w, "en") == (plain(w) if 2 <= len(plain(w)) <= 4 else [w])


def test_overflow_and_nudged_font(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    along, across = wrapping.overflow_scales(*lit(3, 130, 1, 100.0))
    assert tuple(round(x, 6) for x in spark.range(1).select(along, across).first()) == (1.7, 2.5)
    fonts = [wrapping.nudged_font(F.lit(20), 0, 10, F.lit(x)) for x in (0.5, 2.0, 9.0)] + [wrapping.nudged_font(F.lit(0), -3, 10, F.lit(1.0))]
    assert tuple(spark.range(1).select(*fonts).first()) == (20, 24, 27, 10)


def test_shared_ground_equals_brute_force(spark):
    r = random.Random(12)
    rows = [(page, line, r.randrange(40), r.randrange(40), r.randrange(30, 60), r.randrange(30, 60)) for page in range(40) for line in range(1, r.randrange(2, 8))]
    bubbles = spark.createDataFrame(rows, BOXES).selectExpr("page_id", "line_id", "x + w / 2 cx", "y + h / 2 cy", "x", "y", "w", "h")
    want = {}
    for page in {x[0] for x in rows}:
        held = {b[1]: b[2:] for b in rows if b[0] == page}
        centre = {k: (x + w / 2, y + h / 2) for k, (x, y, w, h) in held.items()}
        for i in sorted(held):
            for j in sorted(held):
                if i >= j:
                    continue
                (x, y, w, h), (p, q, s, t) = held[i], held[j]
                both = max(0, min(x + w, p + s) - max(x, p)) * max(0, min(y + h, q + t) - max(y, q))
                if both / (w * h + s * t - both) < 0.5:
                    continue
                (ax, ay), (bx, by) = centre[i], centre[j]
                if abs(ax - bx) > abs(ay - by):
                    cut = max(x + 10, min(int((ax + bx) / 2), x + w - 10))
                    halves = (x, y, cut - x, h), (cut, y, x + w - cut, h)
                    held[i], held[j] = halves if ax <= bx else halves[::-1]
                else:
                    cut = max(y + 10, min(int((ay + by) / 2), y + h - 10))
                    halves = (x, y, w, cut - y), (x, cut, w, y + h - cut)
                    held[i], held[j] = halves if ay <= by else halves[::-1]
        want |= {(page, k): v for k, v in held.items()}
    got = {(b.page_id, b.line_id): (b.x, b.y, b.w, b.h) for b in split_shared(bubbles).collect()}
    assert got == want and got != {b[:2]: b[2:] for b in rows}


def test_mask_kernels_equal_brute_force():
    import numpy as np

    from vellum.operators import masks as M

    r = random.Random(3)
    for _ in range(40):
        h, w = r.randrange(1, 9), r.randrange(1, 9)
        grey = np.array([[r.choice((10, 40, 60, 200)) for _ in range(w)] for _ in range(h)])
        x, y = r.randrange(w), r.randrange(h)
        reached, todo = set(), [(x, y)]
        while todo:
            a, b = todo.pop()
            if (a, b) in reached or not (0 <= a < w and 0 <= b < h) or abs(int(grey[b, a]) - int(grey[y, x])) > 35:
                continue
            reached.add((a, b))
            todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        mask = M.flood_fill(grey, x, y)
        assert {(int(a), int(b)) for b, a in zip(*np.nonzero(mask))} == reached
        label = M.labelled(grey > 50)
        cells = {(a, b) for b in range(h) for a in range(w) if grey[b, a] > 50}
        touching = [(p[1] * w + p[0], q[1] * w + q[0]) for p in cells for q in cells if p != q and max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1]
        roots = components([b * w + a for a, b in cells], touching)
        names = {c: n for n, c in enumerate(sorted(set(roots.values())), 1)}
        assert all(label[b, a] == names[roots[b * w + a]] for a, b in cells) and (label > 0).sum() == len(cells)
        for padding in (1, 3, 5):
            left = M.eroded(mask, x, y, padding)
            for p in [*range(padding, 1, -2), 0]:
                keep = np.array([[all(mask[j, i] for j in range(max(0, b - p), min(h, b + p + 1)) for i in range(max(0, a - p), min(w, a + p + 1))) for a in range(w)] for b in range(h)])
                if keep[y, x]:
                    break
            assert (left == keep).all()
        assert M.eroded(mask, -1, 0, 3) is None


def test_settings_fill_in_and_report(spark):
    rows = ["", None, "{}", '{"detector": {"detection_size": 1024, "box_threshold": 0.5}, "translator": {"target_lang": "CHS"}, "inpainter": {"inpainter": "none"}, "render": {"direction": "horizontal"}, "kernel_size": 5}', "[1]", '{"ocr": ', '{"render": {"alignment": "up"}}', '{"detector": {"detection_size": "wide"}}']
    got = [r.c for r in spark.createDataFrame(list(enumerate(rows)), "k int, t string").select("k", config(F.col("t")).alias("c")).orderBy("k").collect()]
    assert [c.error for c in got] == [None, None, None, None, "json", "json", "render.alignment", "json"]
    assert (got[0].detector.detection_size, got[0].detector.box_threshold, got[0].translator.target_lang, got[0].ocr.prob, got[0].kernel_size) == (1536, 0.7, "ENG", None, 3) and got[0] == got[1] == got[2]
    full = got[3]
    assert (full.detector.detection_size, full.detector.box_threshold, full.detector.text_threshold, full.translator.target_lang, full.inpainter.inpainter, full.render.direction, full.kernel_size) == (1024, 0.5, 0.5, "CHS", "none", "horizontal", 5)


def test_stages_are_kept_or_unloaded(spark):
    from vellum.operators import stages

    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "page_id long, line_id long, text string")
    for keep in (True, False):
        assert {r.translation for r in stages.dispatch("identity translator", df, keep).collect()} == {"a", "b"}
    stage = stages.prepare("identity translator")
    assert stage.reload() is str and stage.key() in stages._loaded
    stage.drop()
    assert stage.key() not in stages._loaded
    try:
        stages.prepare("none such")
    except ValueError as wrong:
        assert "identity translator" in str(wrong)
    else:
        raise AssertionError("an unknown stage was prepared")


def test_quad_gap_equals_sampled_distance(spark):
    r = random.Random(10)

    def quad():
        t, w, h, cx, cy = r.uniform(-0.7, 0.7), r.uniform(5, 40), r.uniform(5, 40), r.uniform(0, 80), r.uniform(0, 80)
        return [(cx + a * w * math.cos(t) - b * h * math.sin(t), cy + a * w * math.sin(t) + b * h * math.cos(t)) for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))]

    def edges(q):
        return list(zip(q, q[1:] + q[:1]))

    def inside(v, q):
        return all((b[0] - a[0]) * (v[1] - a[1]) - (b[1] - a[1]) * (v[0] - a[0]) >= 0 for a, b in edges(q))

    def points(q):
        return [(a[0] + (b[0] - a[0]) * k / 200, a[1] + (b[1] - a[1]) * k / 200) for a, b in edges(q) for k in range(200)]

    pairs = [(quad(), quad()) for _ in range(60)] + [([(0, 0), (40, 0), (40, 40), (0, 40)], [(10, 10), (20, 10), (20, 20), (10, 20)])]
    df = spark.createDataFrame([(k, p, q) for k, (p, q) in enumerate([([(float(x), float(y)) for x, y in p], [(float(x), float(y)) for x, y in q]) for p, q in pairs])], "k int, p array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>")
    meet = 0
    for row in df.select("k", G.quad_gap(F.col("p"), F.col("q")).alias("gap")).collect():
        p, q = pairs[row.k]
        if any(inside(v, q) for v in points(p)) or any(inside(v, p) for v in points(q)):
            assert row.gap < 0.25
            meet += 1
        else:
            want = min(math.dist(a, b) for a in points(p)[::2] for b in points(q)[::2])
            assert abs(row.gap - want) < 0.5
    assert 5 < meet < 55


def test_syllables(spark):
    rows = [("cat", "en", "cat"), ("medium", "en", "me|diu|m"), ("banana", "en", "ba|na|na"), ("strength", "en", "stre|ngth"), ("undefined", "en", "unde|fi|ne|d"), ("babababab", "en", "babababab"), ("a" * 17, "en", "aaa|aaa|aaa|aaa|aaa|aa"), ("hyphenation", "en", "hyphenation"), ("medium", "ja_JP", "medium"), ("easy", "en", "ea|sy"), ("unit", "en", "uni|t")]
    df = spark.createDataFrame(rows, "w string, l string, want string").select("want", F.array_join(T.syllables(F.col("w"), F.col("l")), "|").alias("got"))
    assert [(r.got, r.want) for r in df.collect() if r.got != r.want] == []


def test_kept_tables_go_when_cleaned(spark):
    clean(spark)
    with Scratch(spark, "test") as scratch:
        kept, gone = (scratch.write(spark.range(3), n, keep=k) for n, k in (("kept", True), ("gone", False)))
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept._vellum_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda df: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._vellum_path))
    assert kept.count() == 3 and there(kept) and not there(gone)
    assert clean(spark) == 1 and not there(kept) and clean(spark) == 0


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a\n b \n\nc\n")
    assert [tuple(r) for r in read_dictionary(spark, str(tmp_path / "d.txt")).collect()] == [(0, "a"), (1, " b "), (2, ""), (3, "c")]


def test_colour_difference_of_known_colours(spark):
    rows = [((255, 255, 255), (255, 255, 255), 0.0), ((255, 255, 255), (0, 0, 0), 255 * 0.392), ((255, 0, 0), (0, 255, 0), math.sqrt((0.392 * 88) ** 2 + 166**2 + 16**2))]
    for a, b, want in rows:
        c = lambda x: [F.lit(v) for v in x]
        assert abs(spark.range(1).select(G.color_difference(c(a), c(b))).first()[0] - want) < 0.01


def test_insertion_order_goes_right_to_left(spark):
    boxes = [(1, 1, 0, 0, 10, 10), (1, 2, 50, 1, 10, 10), (1, 3, 20, 40, 10, 10)]
    got = insertion_order(spark.createDataFrame(boxes, BOXES)).collect()
    assert [r.line_id for r in sorted(got, key=lambda r: r.place)] == [2, 1, 3]


def test_limits_take_a_stream(spark, tmp_path):
    spark.sql("SELECT 1 AS user_id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts FROM range(70)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id int, ts timestamp").parquet(str(tmp_path / "in"))
    run = over_limit(stream, limit=20, late="10 seconds").writeStream.format("memory").queryName("over").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [r.n for r in spark.table("over").collect()] == [60]


def test_inscribed_rectangles():
    import numpy as np

    from vellum.operators.masks import inscribed_rectangle

    mask = np.zeros((20, 20), np.uint8)
    mask[4:16, 5:15] = 255
    assert inscribed_rectangle(mask) == (5, 4, 10, 12)
    large = np.zeros((100, 100), np.uint8)
    large[20:80, 30:90] = 255
    assert inscribed_rectangle(large) == (30, 20, 60, 60)
    assert inscribed_rectangle(np.zeros((3, 3), np.uint8)) == (0, 0, 0, 0) == inscribed_rectangle(np.zeros((0, 0), np.uint8))
    r = random.Random(4)
    for _ in range(60):
        small = np.array([[r.random() < 0.7 for _ in range(9)] for _ in range(7)], np.uint8)
        x, y, w, h = inscribed_rectangle(small)
        areas = [(d - b) * (c - a) for a in range(9) for c in range(a + 1, 10) for b in range(7) for d in range(b + 1, 8) if small[b:d, a:c].all()]
        assert w * h == max(areas, default=0) and small[y : y + h, x : x + w].all()
