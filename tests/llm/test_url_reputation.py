"""Host reputation against plain Python, and what the prior strengths do."""

import math
import random
from collections import defaultdict

import pytest

from tessera.llm import url_filter


def site(host):
    labels = host.split(".")
    n = 2 if len(labels) > 1 and len(labels[-1]) == 2 and labels[-1].isalpha() and labels[-2] in "ac co com edu gov net org".split() else 1
    return ".".join(labels[-n:]), ".".join(labels[-n - 1 :]), host


def plain(outcomes):
    """(mean, lower bound) by host from {host: [0 or 1, ...]}."""
    good, seen = defaultdict(int), defaultdict(int)
    for host, results in outcomes.items():
        for key in ((), *[site(host)[: k + 1] for k in range(3)]):
            good[key] += sum(results)
            seen[key] += len(results)
    post = {(): (good[()] + 1.0, seen[()] - good[()] + 1.0)}
    for depth in (1, 2, 3):
        keys = sorted({site(h)[:depth] for h in outcomes})
        prior = {k: (post[k[:-1]][0] - good[k]) / (sum(post[k[:-1]]) - seen[k]) for k in keys}
        some = [k for k in keys if seen[k]]
        squares = sum(seen[k] * (good[k] / seen[k] - prior[k]) ** 2 for k in some)
        noise = sum(prior[k] * (1 - prior[k]) for k in some)
        room = sum(prior[k] * (1 - prior[k]) * (seen[k] - 1) for k in some)
        strength = 20.0
        if room:
            strength = 200.0 if squares <= noise else min(200.0, max(2.0, room / (squares - noise) - 1))
        for k in keys:
            post[k] = prior[k] * strength + good[k], (1 - prior[k]) * strength + seen[k] - good[k]
    out = {}
    for host in outcomes:
        a, b = post[site(host)]
        out[host] = a / (a + b), a / (a + b) - url_filter.Z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return out


def judged(spark, outcomes):
    rows, results = [], []
    for host, values in outcomes.items():
        rows += [(len(rows) + k, f"http://{host}/x") for k in range(max(1, len(values)))]
        results += [(rows[-len(values) + k][0], v) for k, v in enumerate(values)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    found = url_filter.filter_urls(pages, spark.createDataFrame(results, "page_id long, good int"), rules=())
    return {r.host: (r.good_mean, r.good_bound, r.verdict) for r in found.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_python(spark, seed):
    r = random.Random(seed)
    outcomes = {}
    for k in range(60):
        host = ".".join([f"h{k}", *r.choice([["a", "com"], ["b", "com"], ["c", "co", "uk"], ["d", "co", "uk"], ["e", "org"], ["solo"]])])
        p = r.choice([0.1, 0.5, 0.9])
        outcomes[host] = [int(r.random() < p) for _ in range(r.choice([0, 1, 2, 30]))]
    outcomes |= {"localhost": [1], "co.uk": [0, 1], "127.0.0.1:80": []}
    have, want = judged(spark, outcomes), plain(outcomes)
    for host, (mean, bound) in want.items():
        assert have[host][0] == pytest.approx(mean, abs=1e-9) and have[host][1] == pytest.approx(bound, abs=1e-9)
        assert have[host][2] == ("allow" if bound >= url_filter.THRESHOLD else "block")


def test_sparse_hosts_take_their_domains_word(spark):
    """Hosts that are all like their domain: nothing is between them, so one with a single outcome shrinks to it nearly whole."""
    outcomes = {f"h{k}.good.com": [1] * 9 + [0] for k in range(20)} | {f"h{k}.bad.com": [0] * 9 + [1] for k in range(20)}
    outcomes |= {"new.good.com": [0], "new.bad.com": [1]}
    have = judged(spark, outcomes)
    assert have["new.good.com"][0] > 0.8 and have["new.bad.com"][0] < 0.2
    assert have["h1.good.com"][2] == "allow" and have["h1.bad.com"][2] == "block"


def test_domains_below_a_shared_suffix_stay_apart(spark):
    outcomes = {"x.good.co.uk": [1] * 30, "y.good.co.uk": [1] * 30, "x.bad.co.uk": [0] * 30, "z.good.co.uk": []}
    have = judged(spark, outcomes)
    assert have["z.good.co.uk"][0] > 0.8 and have["x.bad.co.uk"][0] < 0.2
