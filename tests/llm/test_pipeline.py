"""Each stage of the pipeline on small tables, and the whole of it."""

from __future__ import annotations

import collections
import hashlib

import corpus_pipeline
from tests.llm import brute
from vellum.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = read_table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "sampled pieces"]
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()} <= {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        assert 0 < out.count() < rows


def test_run_gives_pieces_of_mixed_documents(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.where("NOT decoded").count() == 0 and got.count() > 0


def test_stages_take_no_rows(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_edge_rows_go_through_every_stage(spark, tmp_path):
    """Each stage is held against brute force on what its predecessor kept."""
    filler = [" ".join(f"f{k}w{i}" for i in range(80)) for k in range(12)]
    rows = [*brute.edge_rows(), *[(100 + k, t, "en", f"s{k % 2}", len(t), "r", k, "d") for k, t in enumerate([*filler, *filler[:3], filler[5].upper(), filler[6].replace("f6w7 ", "other ")])]]
    docs = spark.createDataFrame(rows, brute.DOCS)
    columns = docs.columns
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, "").write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
        now = docs.collect()
        if at < 4:
            assert docs.columns == columns and {tuple(r) for r in now} <= set(before), name
        if at == 0:
            assert all(not brute.base_figures(r.text)[-1] for r in now) and {100, 112, 115, 116} <= {r.doc_id for r in now}
        if at == 1:
            want = collections.Counter((k[0], k[4]) for k in brute.exact(before) if k[3])
            assert collections.Counter((r.doc_id, hashlib.sha256(brute.lowered(r.text)).hexdigest()) for r in now) == want
        if at == 2:
            groups = brute.near(before, 5)
            assert {r.doc_id for r in now} == {i for i, c in groups.items() if i == c} | {r[0] for r in before if r[0] is None}
            assert 116 not in {r.doc_id for r in now} and 106 in {r.doc_id for r in now}
        if at == 4:
            assert {r.doc_id for r in now} <= {r[0] for r in before} and all(r.decoded for r in now) and len(now) >= len(before)


def test_quality_and_mixing_stages_equal_brute_force(spark):
    """Every row that quality rules keep or drop, by the scores of its own words; every count of the mixture."""
    import bisect
    import math

    from vellum.llm import mixing, quality_rules

    docs = read_table(spark, SF, "documents")
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in verdict.items() if k)
    rows = kept.collect()
    size = lambda r: len((r.text or "").encode()) + 1
    total = collections.Counter()
    for r in rows:
        total[r.source] += size(r)
    weight = {s: n**mixing.ALPHA for s, n in total.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(total.values()) / n for s, n in total.items()}
    want = {}
    for r in rows:
        u = (int(hashlib.md5(f"20:1:{r.doc_id}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        steps, chance = [], 0.0
        for k in range(60):
            chance += math.exp(-rate[r.source] + k * math.log(rate[r.source]) - math.lgamma(k + 1))
            steps.append(chance)
        want[r.doc_id] = bisect.bisect_left(steps, u)
    got = collections.Counter(r.doc_id for r in stages["mixing"](spark, kept, SF).collect())
    assert got == collections.Counter({i: n for i, n in want.items() if n})
