import datetime as dt
import random

import pytest

from barwise.llm.url_filter import OP1_SQL, filter_urls, op1_url_filter, patterns_of
from conftest import SF_MID, SF_SMALL
from llm_helpers import docs_of
from oracle_check import compare, duck_connect

DAY = dt.date(2024, 1, 1)


def test_patterns(spark):
    urls = ["http://A.b.Example.com:80/x//y/?q=/z#f", "https://user:p@host/", "nope", None, "ftp://h.org", "http://c.de./a b/é"]
    got = [r[0] for r in docs_of(spark, [(u,) for u in urls], "url string").select(patterns_of("url")).collect()]
    assert [sorted(x) for x in got] == [
        sorted(["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x", "a.b.example.com/x/y"]),
        ["host"], [], [], ["h.org"], sorted(["c.de", "c.de/a b", "c.de/a b/é"])]


def test_as_of(spark):
    rng = random.Random(3)
    pats = ["x.com", "a.x.com", "a.x.com/p", "a.x.com/p/q", "y.org"]
    entries = [(rng.choice(pats), rng.choice(["block", "allow", "clear"]), DAY + dt.timedelta(rng.randint(-40, 400)))
               for _ in range(60)] + [(None, "block", DAY), ("x.com", None, DAY), ("x.com", "block", None), ("y.org", "odd", DAY)]
    caps = [(i, rng.choice(["http://a.x.com/p/q", "http://a.x.com/p", "http://x.com/", "http://y.org/z", "http://n.net"]),
             DAY + dt.timedelta(rng.randint(0, 365)), 1) for i in range(300)]
    caps += caps[:3] + [(900, None, DAY, 1), (901, "http://x.com", None, 1), (None, "junk", DAY, 1), (902, "http://x.com/" + "s/" * 3000, DAY, 1)]
    rank = {"clear": 0, "block": 1, "allow": 2}
    by = {}
    for p, a, d in entries:
        if p and a in rank and d:
            by.setdefault(p, {})[d] = max(by.get(p, {}).get(d, a), a, key=rank.get)

    def want(url, day):
        best = None
        if url and day and "//" in url:
            rest = url.split("//")[1].rstrip("/")
            host = rest.split("/")[0]
            for p, days in by.items():
                if p == rest or rest.startswith(p + "/") or ("/" not in p and (host == p or host.endswith("." + p))):
                    on = [d for d in days if d <= day]
                    if on and days[max(on)] != "clear" and (best is None or len(p) > len(best[0])):
                        best = (p, days[max(on)], max(on))
        return best or (None, None, None)
    df = docs_of(spark, caps, "page_id long, url string, fetched_on date, host int")
    ent = docs_of(spark, entries, "pattern string, action string, listed_on date")
    got = filter_urls(df, ent).collect()
    assert sorted(((r.page_id, r.pattern, r.action, r.listed_on, r.blocked) for r in got), key=str) == sorted(
        ((i, *w, w[1] == "block") for i, u, d, _ in caps for w in [want(u, d)]), key=str)
    assert any(r.blocked for r in got)
    assert filter_urls(df, ent.limit(0)).filter("blocked").count() == 0
    assert filter_urls(df.limit(0), ent).count() == 0


def test_long_urls_far_dates_and_clashing_names(spark):
    long_url = "http://x.com/" + "/".join(f"s{i}" for i in range(12_000))
    caps = [(1, long_url, dt.date(2024, 5, 5)), (2, "http://x.com/s0", dt.date(900, 1, 2)), (3, "http://x.com/s0/s1?q", dt.date(9999, 12, 31)),
            (4, "http://a.x.com/", dt.date(2024, 5, 5)), (5, "http://x.com/s0x", dt.date(2024, 5, 5))]
    df = docs_of(spark, [(*c, 7, 8, "p") for c in caps], "__u long, url string, fetched_on date, __k int, __best int, pattern string")
    ent = docs_of(spark, [("x.com/s0", "block", dt.date(800, 1, 1)), ("x.com/s0/s1", "allow", dt.date(2000, 1, 1)), ("x.com/", "block", dt.date(800, 1, 1)),
                          ("x.com/s0//s1", "block", dt.date(800, 1, 1))], "pattern string, action string, listed_on date")
    got = {r["__u"]: (r.blocked, r.pattern, r["__k"], r["__best"]) for r in filter_urls(df, ent).collect()}
    assert got == {1: (False, "x.com/s0/s1", 7, 8), 2: (True, "x.com/s0", 7, 8), 3: (False, "x.com/s0/s1", 7, 8),
                   4: (False, None, 7, 8), 5: (False, None, 7, 8)}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_matches_sql(spark, sf):
    res = compare(op1_url_filter(spark, sf), OP1_SQL, duck_connect(sf))
    assert res["ok"], res["problems"]
    assert op1_url_filter(spark, sf).filter("blocked").count() > 0


def test_plan_is_native(spark):
    plan = op1_url_filter(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
