import random
import re

from timeloom.llm import urls

from .helpers import collect


def split(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, path, low + rest[len(host) :]


def slow(url):
    """Every rule of the query on every url."""
    host, path, address = split(url)
    sites = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fit = [(len(h + p), h + p, v) for h, p, v in sites if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], None, max(fit)[2]
    fit = [r for r in urls.PATTERNS if re.search(r.regex, address, re.DOTALL)]
    best = min(fit, key=lambda r: (-len(r.name), r.verdict != "allow", r.name), default=None)
    return host, path, None, best and best.name, best.verdict if best else "allow"


def addresses(seed=2, n=400):
    r = random.Random(seed)
    hosts = ["net", "NET", "example.net", "a.Example.NET", "xexample.net", "example.com", "b.example.com", "org", "x.org", "xorg", "cheap-pills.de", "www.casino-win.com", "net:80", "münchen.net", "u@example.com"]
    paths = ["", "/", "/en/", "/en", "/en/x.html", "/de/1", "/fr/", "/fr/a.zip", "/x?page=2&ref=x", "?page=/en/", "#/de/", "/en/a\nb.html", "/login/", "/enx/"]
    out = [r.choice(["http://", "https://", "://", "http:/", ""]) + r.choice(hosts) + r.choice(paths) + r.choice(["", "", "/?q", "#f", "://net/"]) for _ in range(n)]
    return [None, "", "://", "x", "http://" + "a/" * 20_000 + "login/", *out]


def test_like_every_rule_on_every_url(spark):
    every = addresses()
    rows = [(i, u, "h", "v") for i, u in enumerate(every)] + [(None, "http://net/", "h", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string").repartition(4)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["pattern"], r["verdict"]) for r in collect(urls.judged(pages, urls.SITES + urls.PATTERNS))}
    assert got == {i: slow(u) for i, u in enumerate(every)} | {None: slow("http://net/")}
    stay = sorted(r["page_id"] for r in collect(urls.allowed(pages)))
    assert stay == [i for i, u in enumerate(every) if slow(u)[4] == "allow"]
    assert urls.allowed(pages).columns == pages.columns


def test_only_the_rarest_token_fetches_a_rule(spark):
    pages = spark.createDataFrame([(i, f"http://h.com/common/{'rare' if i == 3 else i}/") for i in range(50)], "page_id long, url string")
    rules = (urls.pattern("block", "/common/rare/"), urls.pattern("block", "ommon/rar"))
    counts = urls.token_counts(pages, rules)
    assert counts == {"common": 50, "rare": 1}
    tried = {r["page_id"]: r["n_tried"] for r in collect(urls.judged(pages, rules))}
    assert tried == {i: 2 if i == 3 else 1 for i in range(50)}  # the second rule has no whole token


def test_tokens_are_whole_in_every_address_that_fits():
    assert urls.site("block", "Example.net", "/en/a").tokens == ("example", "net", "en")
    assert urls.site("block", "example.net", "").tokens == ("example", "net")
    assert urls.pattern("block", "ads/x*y/z|").tokens == ("z",)
    assert urls.pattern("block", "|www.a").tokens == ("www",)


def test_empty_table_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert collect(urls.judged(pages, ()))[0]["verdict"] == "allow"
    assert urls.judged(pages.limit(0), urls.SITES).count() == 0
