"""Classifiers, WARC bundles, url rules and sampled segmentations."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import pytest

from tests.llm import brute
from vellum.llm import labelled, pieces as P, quality_classifier as C, toxicity as X, url_filter as U, warc as W
from vellum.llm.hash_table import HashTable
from vellum.sources.scratch import Scratch
from vellum.sources.tables import read_table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("module", "label", "least"), [(C, "quality", (0.6, 0.9)), (X, "toxic", (0.9, 0.6))])
def test_held_out_recall_of_both_labels(spark, module, label, least):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    got = module.classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    for k in (0, 1):
        assert np.mean([r.predicted == k for r in rows if r[label] == k]) >= least[k]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.PREDICTED_FROM) for r in rows)


def test_compression_scores_equal_plain_compression():
    """Blocks compressed one by one with either dictionary, and the fit's own formula."""
    import zstandard

    r = np.random.Generator(np.random.PCG64(3))
    good, bad = ([" ".join(f"{c}{i}" for i in r.integers(0, 60, 80)).encode() for _ in range(60)] for c in ("good", "junk"))
    texts, y = good + bad, np.array([1] * 60 + [0] * 60)
    model = C.fit(texts, y)

    def size(data: bytes, text: bytes) -> int:
        shared = zstandard.ZstdCompressionDict(data)
        squeeze = zstandard.ZstdCompressor(level=C.LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(squeeze.compress(text[k : k + 512])) for k in range(0, len(text), 512))

    asked = [*good[:5], *bad[:5], b"", b"good1 " * 400, b"x"]
    scores = model.scores(asked)
    for text, score in zip(asked, scores):
        difference = (size(model.bad, text) - size(model.good, text)) / max(1, len(text))
        assert score == pytest.approx(1 / (1 + np.exp(-(model.weights[0] * difference + model.weights[1]))))
    assert scores[:5].min() > 0.5 > scores[5:10].max()


def test_long_labelled_texts_are_in_the_sample(spark):
    docs = spark.createDataFrame([(1, "ab " * 50_000), (2, "é" * 30_000), (3, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, label int")
    texts, y = labelled.labelled_sample(docs, labels, "label", 10, 32_768)
    held = [i for i in (1, 2, 3) if __import__("zlib").crc32(str(i).encode()) % 5]
    assert len(texts) == len(held) and all(len(t) <= 32_768 for t in texts) and sum(len(t) in (8_192, 16_384) for t in texts) == len([i for i in held if i < 3])


@pytest.mark.parametrize(("module", "label"), [(C, "quality"), (X, "toxic")])
def test_classifiers_take_edge_cases(spark, module, label):
    docs = spark.createDataFrame(brute.edge_rows(), brute.DOCS)
    labels = spark.createDataFrame([(6, 1), (8, 0), (3, None), (None, 1), (10, 1), (10, 0), (14, 0), (15, 1), (15, 1)], f"doc_id long, {label} int")
    got = module.classify(docs, labels).collect()
    assert len(got) == len(brute.edge_rows()) and all(0 <= r.score <= 1 for r in got)
    alone = module.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in alone} == {0.5}
    assert module.classify(docs.limit(0), labels).count() == 0


def test_held_out_rows_are_never_fitted_on(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    texts, _ = labelled.labelled_sample(docs, labels, "label", 100, 1000)
    import zlib

    assert sorted(texts) == sorted(f"text {i}".encode() for i in range(60) if zlib.crc32(str(i).encode()) % 5)


def test_hash_table():
    r = np.random.Generator(np.random.PCG64(2))
    keys = np.unique(r.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    t = HashTable(keys[::2])
    assert (t.get(keys[::2]) == np.arange(len(keys[::2]))).all() and (t.get(keys[1::2]) == -1).all()
    assert (HashTable(np.empty(0, np.uint64)).get(keys[:3]) == -1).all()


PAGES = "page_id bigint, url string, html string, digest string, payload string"


def page_rows() -> list[tuple]:
    body = "<p>" + "same words " * 20 + "</p>"
    return [
        (1, "http://a.com/", body, "x", "y"), (2, None, body, "x", "y"), (0, "http://b\r\nc", body + "é", "x", "y"), (3, "u", None, None, None), (4, "u", "", "x", "y"), (5, "u", "short", "x", "y"), (6, "u", "short", "x", "y"),
        (7, "u", body + "é", "x", "y"), (None, "u", body, "x", "y"), (1, "u", body, "x", "y"), (8, "u", "\r\n\r\nWARC/1.1" * 30, "x", "y"), (9, "u", "long " * 60_000, "x", "y"),
    ]


def test_warc_round_trip_equals_brute_force(spark):
    rows = page_rows()
    first = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    want = collections.Counter()
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        refers = first[b] if b in first and first[b] != i else None
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "response" if refers is None else "revisit", refers)] += 1
    got = W.warc_round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert W.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_records_are_fetched_by_identifier_and_bundles_are_files(spark, tmp_path):
    import zstandard

    with Scratch(spark, "test") as scratch:
        bundles = W.write_bundles(spark.createDataFrame(page_rows(), PAGES), scratch)
    index = W.record_index(bundles).collect()
    assert len(index) == len(page_rows())
    assert any(r.frame_offset > 0 for r in index) and any(r.frame > 0 for r in index)  # records share frames, and bundles hold several
    asked = spark.createDataFrame([(r.record_id,) for r in index[:3]], "record_id string")
    for r in W.fetch(bundles, asked).collect():
        headers, _ = W.parse_record(bytes(r.record))
        assert headers["WARC-Record-ID"] == f"<{r.record_id}>"
    for r in W.export_bundles(bundles, str(tmp_path)).collect():
        data = open(r.path, "rb").read()
        whole = b"".join(W.read_frame(data, k) for k in range(len(W.read_seek_table(data))))
        # a reader that knows nothing of seek tables sees the same frames
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == whole and len(data) == r.bytes


def plain_rule(url: str | None) -> tuple:
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules_equal_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com/en", "http://www.example.com/en/", "x://b.www.example.com/en/1", "http://com", "http://com/", "http://notcom/", "http://xcom/en/",
        "http://a.net/es/1", "http://a.net/fr/#q", "http://a.net/de/", "http://net/es/", "http://É.net/fr/", "a://b://c.com/", "http://a.com?x=/en/", "http://a.org/x\ny/z?q\n#", "http://" + "a" * 70_000 + ".com/",
    ]
    rows = [(k, u, "h", "v") for k, u in enumerate(urls)] + [(None, urls[4], "h", "v"), (3, urls[3], "h", "v")]
    got = U.url_filter(spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict string")).collect()
    want = collections.Counter((k, *plain_rule(u)[:3]) for k, u, *_ in rows)
    assert collections.Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    ruled = {u: plain_rule(u)[3] for u in urls}
    by_id = dict(enumerate(urls)) | {None: urls[4]}
    assert all(r.verdict == (ruled[by_id[r.page_id]] or r.verdict) and r.verdict in ("allow", "block") for r in got)
    assert U.url_filter(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_url_trees_learn_what_labels_say(spark):
    urls = [(f"http://{'win-casino' if i % 2 else 'news'}{i % 7}.org/{'x' * (i % 5)}/{i if i % 2 else ''}", float(i % 2)) for i in range(600)]
    model = U.fit(spark.createDataFrame(urls[:400], "url string, label double"))
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id long, url string").where("page_id >= 400")
    got = U.judge(pages, model, rules=()) if False else U.judge(pages, model)
    assert np.mean([(r.verdict == "block") == (r.page_id % 2 == 1) for r in got.collect()]) > 0.95


@pytest.fixture(scope="module")
def lattices():
    return P.Lattices(P.Vocabulary(P.MODEL))


def every_segmentation(t: P.Lattices, text: str) -> dict[tuple, float]:
    chunks = P.chunks_of(text)
    starts = t.nodes_of(chunks).tolist()
    out = {}

    def walk(chunk: int, node: int, pieces: tuple, log: float) -> None:
        if node == t.end[starts[chunk]]:
            if chunk + 1 == len(starts):
                out[pieces] = log
                return
            chunk, node = chunk + 1, starts[chunk + 1]
        for e in range(t.first[node], t.first[node + 1]):
            walk(chunk, node + int(t.size[e]), (*pieces, int(t.piece[e])), log + math.log(t.chance[e]))

    walk(0, starts[0], (), 0.0)
    return out


def test_samples_follow_the_lattice_without_replacement(lattices):
    text, n = "the cat", 6000
    chance = {k: math.exp(v) for k, v in every_segmentation(lattices, text).items()}
    assert sum(chance.values()) == pytest.approx(1, abs=1e-5)
    keys = P._mix(np.arange(n, dtype=np.uint64))
    *samples, bound = P.sample(lattices, keys, [text] * n, 3)
    drawn = [[tuple(lattices.piece[e[s[d] : s[d + 1]]].tolist()) for d in range(n)] for _, s, e, _, _ in samples]
    assert all(len({a, b, c}) == 3 for a, b, c in zip(*drawn))
    best = sorted(chance, key=chance.get, reverse=True)[:4]
    first, second = collections.Counter(drawn[0]), collections.Counter(drawn[1])
    for x in best:
        then = sum(chance[y] * chance[x] / (1 - chance[y]) for y in chance if y != x)
        assert first[x] / n == pytest.approx(chance[x], abs=0.025)
        assert second[x] / n == pytest.approx(then, abs=0.025)
    # weights over inclusion probabilities are an unbiased estimate of the whole
    total = sum(np.exp(lp) / -np.expm1(-np.exp(lp - bound)) for _, _, _, lp, _ in samples)
    assert total.mean() == pytest.approx(1, abs=0.03)


def test_a_text_with_few_segmentations_gives_them_all(lattices):
    all_of = every_segmentation(lattices, "ab")
    *samples, bound = P.sample(lattices, np.array([5], np.uint64), ["ab"], 50)
    got = [tuple(lattices.piece[e[s[0] : s[1]]].tolist()) for alive, s, e, _, _ in samples if 0 in alive]
    assert sorted(got) == sorted(all_of) and bound[0] == -np.inf


def test_segments_decode_to_their_texts(spark):
    rows = [*brute.edge_rows(), (500, "  two  spaces \t\n and 中文 😀 \x00 end ", None, None, 1, None, 1, None), (501, "q" * 5000, None, None, 1, None, 1, None), (502, " ", None, None, 1, None, 1, None)]
    docs = spark.createDataFrame(rows, brute.DOCS)
    got = P.segment(docs, k=3).collect()
    assert all(r.decoded and r.n_pieces == len(r.piece_ids) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[(r.doc_id, r.sample)].append(tuple(r.piece_ids))
    assert {r[0] for r in rows} == {d for d, s in by if s == 0}
    assert len(by[(8, 0)]) == 3 and len(set(by[(8, 0)])) == 1  # repeated rows give equal samples
    for d in {r[0] for r in rows} - {None, 0}:
        seen = [x for s in range(3) for x in set(by.get((d, s), []))]
        assert len(seen) == len(set(seen))
    texts = {r[0]: r[1] or "" for r in rows}
    spelled = P.decode(P.segment(docs.where("doc_id IS NOT NULL"), k=1)).collect()
    assert all(r.decoded_text == texts[r.doc_id] for r in spelled)
    assert P.segment(docs.limit(0)).count() == 0


def test_pieces_agree_with_the_library(lattices):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    for text in ("Hello  world\nfoo é 中 😀", "plain words here"):
        ids = sp.encode(text)
        assert lattices.v.decode(ids) == text == sp.decode(ids)
