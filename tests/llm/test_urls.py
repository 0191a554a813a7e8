import re

from boreflow.llm import urls as U

URLS = [
    "http://a.example.org/es/1", "https://example.org/en/1x?y", "https://example.org/en/2", "http://x.com/fr/1", "http://com/de/", "http://xcom/de/",
    "http://A.Example.COM/DE/1", "http://a.example.com/de/1#q", "https://sub.example.net/porn/a", "https://sub.example.net/essex/a",
    "https://casino.example.net/bet", "https://casino.example.net/casino", "no scheme", "", None, "http://", "x://y://z/fr/", "http://e.net?u=http://a.org/",
    "https://example.org", "https://example.org:80/es/", "http://e.net/" + "a/" * 20_000 + "poker/free", "HTTP://E.NET/XXX",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    low = (url or "").lower()
    hit = lambda terms: {t for t in terms if re.search(rf"(?<![a-z]){t}(?![a-z])", low)}
    return host, path, None, "block" if hit(U.STRICT) or len(hit(U.SOFT)) >= U.SOFT_LIMIT else "allow"


def test_by_brute_force(spark):
    rows = [(k, u, "html", "clash") for k, u in enumerate(URLS)] + [(None, URLS[0], None, None), (0, URLS[0], None, None)]
    f = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.url_filter(f).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u, *_ in rows), key=str)
    assert U.url_filter(f.limit(0)).count() == 0
