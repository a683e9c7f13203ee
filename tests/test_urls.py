"""URL expressions: hand-made cases, properties, and the standard library's ``urljoin``."""

import random
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from sitefold.functions import urls

BASES = [
    "https://acme.io", "https://acme.io/", "http://acme.io/a/b", "https://acme.io/a/b/?q=1#f",
    "https://Acme.io:8080/x//y", "https://acme.io/a;p=1",
]
HREFS = [
    "", "/", "about", "/about", "./about", "../about", "../../..", ".", "..", "./", "../",
    "a/b/../c", "a/./b", "a//b", "//cdn.acme.io/x", "//cdn.acme.io", "?q=2", "#frag", "?", "#",
    "x?y#z", "https://other.org/team", "HTTPS://acme.io/Team", "http://acme.io/a/../b",
    "mailto:hi@x.io", "javascript:void(0)", "tel:+1", "data:text/plain,abc", "a:b", "1a:b",
    "/p/../q/./r", "/..", "a b/c", "/x;y=1/z;w=2", "g;x=1/../y", "über/ö", "/a\tb", "  /lead",
    "x/..", "x/.", "/a/b/", "..//x", "https://acme.io", "ftp://acme.io/f", "?a/../b", "#a/../b",
    "....", ".../x", "/a//b//", "%7Euser", "path?x=http://y/../z", "//user:pw@acme.io:1/z?q",
]


def _random_hrefs(n):
    rng = random.Random(7)
    parts = ["a", "b", "..", ".", "", "team", "x.y", "?", "#", "/", "//", ":", "k=v", "%20", ";p"]
    return ["".join(rng.choice(parts) + rng.choice(["/", "", ""]) for _ in range(rng.randint(1, 7)))
            for _ in range(n)]


def _comparable(base, href):
    """Leave out references the standard library refuses or treats by Python version."""
    try:
        urlparse(urljoin(base, href))
    except ValueError:
        return False
    # an empty authority is treated differently by Python versions
    return not href.startswith("///") and href != "//"


def test_resolve_matches_urljoin(spark):
    hrefs = HREFS + _random_hrefs(400)
    pairs = [(b, h) for b in BASES for h in hrefs if _comparable(b, h)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, b string, h string")
    got = df.select("k", urls.resolve_link(F.col("b"), F.col("h")).alias("r")).collect()
    wrong = []
    for row in got:
        base, href = pairs[row["k"]]
        want = urljoin(base, href)
        if row["r"] != want:
            wrong.append((base, href, row["r"], want))
    assert wrong == []


def test_canonical(column):
    cases = {
        "https://Acme.io/Team/?x#y": "https://Acme.io/Team",
        "https://acme.io//": "https://acme.io",
        "http://acme.io/a;p=1?q": "http://acme.io/a",
        "https://acme.io": "https://acme.io",
        "https://acme.io/a/b///": "https://acme.io/a/b",
        "HTTP://acme.io/A": "http://acme.io/A",
    }
    assert column(list(cases), urls.canonical_url) == list(cases.values())


def test_page_key(column):
    cases = {
        "https://Acme.IO/Team": "https://acme.io/Team",
        "https://acme.io:443/a": "https://acme.io/a",
        "http://acme.io:80": "http://acme.io",
        "http://acme.io:443/a": "http://acme.io:443/a",
        "https://acme.io:8443/a:443": "https://acme.io:8443/a:443",
    }
    assert column(list(cases), urls.page_key) == list(cases.values())


# page, its links, and the target links of the page in order
LINK_PAGES = [
    ("https://acme.io", ["/team", "/team/", "/TEAM?x=1", "/team#top"], ["https://acme.io/team", "https://acme.io/TEAM"]),
    ("https://acme.io/a/", ["about", "../company", "./b/careers/"],
     ["https://acme.io/a/about", "https://acme.io/company", "https://acme.io/a/b/careers"]),
    ("https://acme.io", ["/pricing", "/steamy", "/blog", "/x?team", "/y#about"],
     ["https://acme.io/pricing", "https://acme.io/steamy"]),
    ("https://acme.io", ["/x;team", "/p;jsessionid=1about", "/team;v=2"], ["https://acme.io/team"]),
    ("https://acme.io", ["https://jobs.acme.io/careers", "https://ACME.io/contact", "//acme.io/leadership"],
     ["https://jobs.acme.io/careers", "https://ACME.io/contact", "https://acme.io/leadership"]),
    ("https://acme.io", ["https://port.org/about", "https://notacme.io/team", "https://acme.io.port.org/team",
                         "https://acme.io:8080/team"], []),
    ("https://www.acme.io", ["https://acme.io/team", "https://www.acme.io/team"], ["https://www.acme.io/team"]),
    ("https://acme.io/about/", ["", "#team", "javascript:about()", "mailto:team@acme.io", " /contact ", "/about", "."],
     ["https://acme.io/contact"]),
    ("https://acme.io", [f"/team/{k}" for k in range(9)], [f"https://acme.io/team/{k}" for k in range(9)]),
]


def test_discover_links_cases(spark):
    rows = [(n, base, hrefs) for n, (base, hrefs, _) in enumerate(LINK_PAGES)]
    df = spark.createDataFrame(rows, "n int, base string, hrefs array<string>")
    for k in (1, 4, 5):
        got = df.select("n", urls.discover_links(F.col("base"), F.col("hrefs"), k).alias("l")).collect()
        for row in got:
            assert row["l"] == LINK_PAGES[row["n"]][2][:k], LINK_PAGES[row["n"]]


def test_discover_links_properties(spark):
    """Random pages: results are distinct, canonical, of the site, with a keyword in the path."""
    rng = random.Random(3)
    pool = HREFS + ["/team", "team/", "/About-Us?x", "https://jobs.acme.io/careers", "/pricing#p",
                    "https://notacme.io/team", "/steamy", " /contact ", "/management/", "/company"]
    pages = [(n, rng.choice(BASES[:4]), [rng.choice(pool) for _ in range(rng.randint(0, 25))]) for n in range(200)]
    df = spark.createDataFrame(pages, "n int, base string, hrefs array<string>")
    canonical = F.transform("l", urls.canonical_url)
    rows = df.select(
        "n", "base", urls.site_links(F.col("base"), F.col("hrefs")).alias("l"),
        urls.discover_links(F.col("base"), F.col("hrefs"), 3).alias("top"),
    ).withColumn("again", canonical)
    seen = 0
    for row in rows.collect():
        seen += len(row["l"])
        assert len(set(row["l"])) == len(row["l"]) and row["again"] == row["l"] and row["top"] == row["l"][:3]
        for link in row["l"]:
            host, path = urlparse(link).netloc.lower(), urlparse(link).path.lower()
            site = urlparse(row["base"]).netloc.lower()
            assert host == site or host.endswith("." + site)
            assert any(word in path for word in urls.TARGET_KEYWORDS) and link != row["base"].rstrip("/")
    assert seen > 200


def test_no_hrefs(spark):
    df = spark.createDataFrame([(None,)], "hrefs array<string>")
    assert df.select(urls.discover_links(F.lit("https://a.io"), F.col("hrefs")).alias("l")).first()["l"] == []


def test_seed_forms(column):
    seeds = ["acme.io", " acme.io\n", "http://acme.io/x", "HTTPS://Acme.io", " https://a.b/c　"]
    assert column(seeds, urls.normalize_seed) == [
        "https://acme.io", "https://acme.io", "http://acme.io/x", "https://HTTPS://Acme.io", "https://a.b/c"
    ]
    assert column(["https://www.Acme.io/x", "acme.io", "http://https://b.io"], urls.clean_domain) == [
        "www.acme.io", "acme.io", "b.io"
    ]
    assert column(["acme.io", "wWW.x.y", "a"], urls.company_name) == ["Acme", "Www", "A"]


def test_same_site(spark):
    cases = [("acme.io", "acme.io", True), ("Jobs.ACME.io", "acme.io", True), ("acme.io", "www.acme.io", False),
             ("notacme.io", "acme.io", False), ("acme.io:8080", "acme.io", False)]
    df = spark.createDataFrame(cases, "h string, b string, w boolean")
    for r in df.select("h", "b", "w", urls.same_site(F.col("h"), F.col("b")).alias("g")).collect():
        assert r["g"] == r["w"], r


def test_only_odd_links_are_matched_by_pattern(spark, column):
    """Paths and plain web addresses are cut at their first separators, as the pattern cuts them."""
    values = _random_hrefs(300) + HREFS + [b + h for b in BASES for h in HREFS] + ["a ", "https://h.io;p#a?b", "http:///x"]

    def by_pattern(url):
        return F.struct(*[
            (F.lower if name == "scheme" else lambda c: c)(F.regexp_extract(url, urls._PARTS, group)).alias(name)
            for name, group in (("scheme", 1), ("netloc", 3), ("path", 4), ("query", 5), ("fragment", 6))
        ])

    values = [v for v in values if not set(v) & set("\t\r\n") and not v.startswith(" ")]
    assert column(values, urls.split_url) == column(values, by_pattern)


def test_links_from_the_root_need_no_merging(spark):
    hrefs = ["/about", "/about/?q=team:1#f", "/a/../team", "//acme.io/company", "/x;team", "/team;p", "/blog", "ab\nout", "/ca\treers",
             "pricing", "/blog#team"]
    found = spark.range(1).select(urls.site_links(F.lit("https://acme.io/x/y"), F.array(*map(F.lit, hrefs))).alias("l"))
    assert found.first()["l"] == [
        "https://acme.io/about", "https://acme.io/team", "https://acme.io/company",
        "https://acme.io/x/about", "https://acme.io/careers", "https://acme.io/x/pricing"]
    base = spark.range(1).select(urls._resolve_target(F.struct(F.lit("https").alias("scheme"), F.lit("h").alias("netloc"),
        F.lit("/x").alias("path"), F.lit("").alias("query"), F.lit("").alias("fragment")), F.lit("/about/?q")).alias("p"))
    assert base.first()["p"]["path"] == "/about/"
