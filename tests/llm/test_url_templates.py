from __future__ import annotations

from ledgerpitch.llm import url_templates as ut
from ledgerpitch.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = path = ""
    for at, sign in enumerate(rest):
        if sign in "/?#":
            host, path = rest[:at], rest[at:]
            break
    else:
        host = rest
    for sign in "?#":
        path = path.split(sign, 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [
        r for r in URL_RULES
        if (host == r.rule.split("/", 1)[0] or host.endswith("." + r.rule.split("/", 1)[0]))
        and path.startswith("/" + r.rule.split("/", 1)[1])
    ]
    return max(fits, key=lambda r: len(r.rule), default=None)


URLS = [None, "", "nothing", "://", "http://", "a://b://c/d", "HTTP://WWW.Example.ORG/en/12?x=/es/", "http://example.org/es/1",
        "http://example.org?/es/", "http://notexample.org/en/1", "http://xorg/", "http://org/", "http://a.com/fr/", "http://a.com/fr",
        "http://com/de/9#x", "http://É.Example.org/en/2\nx", "http://a.net/" + "deep/" * 3000, "http://u@b.com:80/de/"]


def test_hosts_paths_and_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(n, u, "x", "y") for n, u in enumerate(URLS)] * 2, "page_id long, url string, host string, verdict string")
    rows = ut.filter_urls(pages, URL_RULES).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = split(URLS[r["page_id"]])
        rule = rule_of(host, path)
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (rule.rule if rule else None)
        assert r["verdict"] == (rule.action if rule else r["verdict"]) and r["verdict"] in ("allow", "block")
    assert ut.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_variable_segments_become_wildcards_and_labels_decide(spark):
    good = [(n, f"http://h.net/shop/item-{chr(97 + n % 26)}{chr(97 + n // 26)}x/view", False) for n in range(400)]
    bad = [(1000 + n, f"http://h.net/spam/deal-{chr(97 + n % 26)}{chr(97 + n // 26)}y/view", True) for n in range(400)]
    rows = spark.createDataFrame(good + bad, "page_id long, url string, bad boolean")
    got = ut.filter_urls(rows, [], labels=rows.filter("page_id % 2 = 0").select("page_id", "bad"))
    found = {(r["template"], r["verdict"]): r["count"] for r in got.groupBy("template", "verdict").count().collect()}
    assert found == {("/shop/*/view", "allow"): 400, ("/spam/*/view", "block"): 400}


def test_similar_branches_are_merged_and_different_ones_are_not(spark):
    rows = []
    for branch, rate in (("aa", 0.1), ("bb", 0.12), ("zz", 0.95)):
        rows += [(f"http://h.net/{branch}/{n}", n < 200 * rate) for n in range(200)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad boolean")
    got = ut.filter_urls(pages, [], labels=pages.select("page_id", "bad"), merge_z=4.0)
    verdicts = {(r["path"].split("/")[1], r["verdict"]) for r in got.collect()}
    assert verdicts == {("aa", "allow"), ("bb", "allow"), ("zz", "block")}


def test_the_main_path_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x/1")], "page_id long, url string")
    plan = ut.filter_urls(pages.filter("page_id > 0"), URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
