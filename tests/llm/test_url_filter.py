import random
import re

from logweave.llm import url_filter as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "/e", "block"), ("b.a.net", "", "allow"), (None, "/", "block"), ("org", None, "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def brute(url):
    host, path = parts(url)
    fit = [(len(h) + len(p or ""), len(h), v == "block", h + (p or ""), v) for h, p, v in RULES if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    return (host, path, *((max(fit)[3:]) if fit else (None, "allow")))


def test_equals_brute_force(spark):
    r = random.Random(1)
    hosts = ["com", "example.com", "www.Example.COM", "x.www.example.com", "net", "a.net", "b.a.net", "c.b.a.net", "notcom", "com.evil", "org", "ü.org", "example.com:80", "", "...", "a..net"]
    urls = [f"{r.choice(['http', 'HTTPS', 'ftp', ''])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/en/a/b', '/es/x', '/e', '/é//', '//en/'])}{r.choice(['', '?q=/en/', '#://x', '?a#b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "x://", "a\n://net/es/\nq", "http://net" + "/es" * 3000]
    pages = spark.createDataFrame([(i // 2, u, "h", "clash") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, html string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(str, (tuple(x[c] for c in ("page_id", "host", "path", "rule", "verdict")) for x in U.judge_urls(pages, rules).collect())))
    assert got == sorted(str((i // 2, *brute(u))) for i, u in enumerate(urls + urls[:3]))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert U.judge_urls(pages, none).first()["verdict"] == "allow"
    assert U.judge_urls(pages.limit(0), none).count() == 0


def test_large_rule_tables_are_joined_by_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rules = spark.createDataFrame([(f"h{i}.com", "/p/", "block") for i in range(2000)], "host string, path string, verdict string")
        pages = spark.createDataFrame([(i, f"http://www.h{i}.com/p/x") for i in range(0, 4000, 100)], "page_id long, url string")
        got = {r["page_id"]: r["verdict"] for r in U.judge_urls(pages, rules).collect()}
        assert got == {i: "block" if i < 2000 else "allow" for i in range(0, 4000, 100)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
