"""What one-sided labels may not decide, and entropy over characters."""

from __future__ import annotations

import collections
import math

from pyspark.sql import functions as F

from vellum.llm import url_filter as U


def test_a_suffix_with_labels_of_one_kind_does_not_decide(spark):
    words = (("paper", "garden", "museum", "river", "bakery", "window"), ("pills", "casino", "lottery", "poker", "warez", "viagra"))
    hosts = [(f"{words[i % 2][i // 2 % 6]}{i % 5}.com", float(i % 2)) for i in range(200)] + [(f"{words[1][i % 6]}{i % 5}.net", 1.0) for i in range(100)]
    model = U.fit(spark.createDataFrame([(f"http://{h}/a/{i}", y) for i, (h, y) in enumerate(hosts)], "url string, label double"))
    urls = [(k, f"http://{('pills', 'paper', 'letters')[k // 3]}{k}.{t}/a/{k // 3}") for k, t in enumerate(("com", "net", "org") * 3)]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(urls, "page_id long, url string"), model, rules=(("allow", "none", "/"),)).collect()}
    assert [got[k] for k in range(6)] == ["block"] * 3 + ["allow"] * 3
    assert len({got[k] for k in (6, 7, 8)}) == 1


def test_one_more_url_of_a_suffix_turns_no_rate_off(spark):
    for n in (7, 8, 9, 40):
        rates = U.Rates([{"net"}] * n + [{"com"}, {"com"}], [1.0] * n + [0.0, 1.0])
        assert 0.5 < rates.get("net") < 1 and rates.get("unseen") == 0.5


#: Hosts whose words the fit has not seen, and whose marks say the opposite of what they are.
GOOD = "my-garden.org free-software.org a-b.net quiet-harbour.org stone-carving.net swimming-pool.com cycling-routes.org knitting.org parish-council.org long-walks-in-rome.org winterbottom.org news-paper.org violin-lessons.net the-times.net".split()
BAD = "casino.org spam.net pornviagra.org mycasino.net lucky-slots.org megawarez.net viagraonline.net xxxpoker.com big-lottery.net payday.com paperbets.net onlinegambling.org adult.net".split()


def test_words_decide_and_not_hyphens(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    model = U.fit(U.lexical_labels(pages), lexical=True)
    urls = [(k, f"http://{h}/en/{k}") for k, h in enumerate(GOOD + BAD)]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(urls, "page_id long, url string"), model, rules=(("allow", "none", "/"),)).collect()}
    assert sum(got[k] == "allow" for k in range(len(GOOD))) >= 0.9 * len(GOOD)
    assert sum(got[k] == "block" for k in range(len(GOOD), len(urls))) >= 0.9 * len(BAD)
    assert [got[k] for k in range(3)] == ["allow"] * 3 and [got[len(GOOD) + k] for k in range(3)] == ["block"] * 3
    gains = model.importances()
    assert gains["f_hyphens"] < 0.2 and sum(v for k, v in gains.items() if "gram" in k) > 0.5


def test_entropy_is_over_characters(spark):
    urls = ["http://abcde.com/", "http://aaaaa.com/", "", "x://é中😀"]
    got = {r[0]: r[1] for r in U.with_features(U.with_parts(spark.createDataFrame([(u,) for u in urls], "url string"))).select("url", F.col("f_entropy")).collect()}
    for u in urls:
        want = -sum(c / len(u) * math.log2(c / len(u)) for c in collections.Counter(u).values())
        assert math.isclose(got[u], want, abs_tol=1e-9)


def test_method_judges_what_no_rule_fits(spark):
    """Held out: hosts that were never fitted on. A suffix by itself blocks nothing."""
    words = ("casino-win", "cheap-pills", "spam-farm", "adult-x", "poker-now", "free-bets")
    bad = [f"http://{w}{k}.{s}/en/{k * 7}" for k in range(40) for w in words for s in ("org", "net")]
    good = [f"https://{a}.{b}{k}.{s}/de/{k * 13}{t}" for k in range(80) for a in ("blog", "www", "m") for b in ("garden", "letter") for s, t in (("org", ""), ("net", ".html"), ("com", "?page=2"))]
    urls = [(u, y) for y, group in ((1, bad), (0, good)) for u in group]
    rows = [(k, u) for k, (u, _) in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    parts = U.with_parts(pages)
    seen = parts.where(F.pmod(F.xxhash64("host"), F.lit(2)) == 0)
    model = U.fit(U.lexical_labels(seen), lexical=True)
    asked = parts.where(F.pmod(F.xxhash64("host"), F.lit(2)) == 1).select("page_id", "url")
    got = [(r.verdict == "block", urls[r.page_id][1]) for r in U.judge(asked, model).where("rule IS NULL").collect()]
    assert len(got) > 300
    for y in (0, 1):
        assert sum(v == bool(y) for v, k in got if k == y) >= 0.9 * sum(k == y for _, k in got)


def test_labels_are_words_between_marks(spark):
    urls = ["http://a.casino-win.com/x", "http://casinos.com/", "http://x.org/casino", "http://POKER.net", "nothing", None]
    got = {r.url: r.label for r in U.lexical_labels(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got == {urls[0]: 1.0, urls[1]: 0.0, urls[2]: 0.0, urls[3]: 1.0}
