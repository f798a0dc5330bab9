"""Verdicts of hosts whose scores are tiny shares of the whole."""

from __future__ import annotations

from hindsail.llm import urlfilter


def test_small_distrust_still_blocks(spark):
    """Each host passes all but one in 20,000 of its distrust to a neighbour, the third in line gets about 1e-13."""
    link = lambda host, n=1: f'<a href="http://{host}/p">' * n
    rows = [("http://b.net/es/", "")]
    for i, host in enumerate(["b.net", "s1.org", "s2.org"], 1):
        rows += [(f"http://big{i}.org/", link(host, 20_000)), (f"http://s{i}.org/", link(host))]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: (r.verdict, r.trust, r.distrust) for r in urlfilter.judge_urls(pages).collect()}
    assert 0 < got["s3.org"][2] < 1e-9 and got["s3.org"][1] == 0
    assert {h: v[0] for h, v in got.items()} == dict.fromkeys(got, "block")
