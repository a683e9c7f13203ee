"""Crawl joins, site aggregates and the salted join, on small hand-made tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sitefold import session
from sitefold.operators import crawl, sites
from sitefold.session import drop_rows, hot_slices, left_join_salted, pick_rows
from sitefold.sources import layout, tables


def page(page_id, url, body="", status=200):
    return (page_id, url, status, f"<html><body>{body}</body></html>")


def make_pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, status_code int, html string").repartition(3)


HOME = '<nav><a href="/about">A</a><a href="team/">T</a><a href="/about?x">A</a><a href="https://jobs.acme.io/careers">J</a></nav>Home x@acme.io'


HUB_SEEDS = [f"hub.io/u{k}" for k in range(40)]
SEEDS = ["acme.io", "gone.io", "acme.io", "copies.io", "acme.io", "many.io", " spaced.io\n", None, *HUB_SEEDS]
PAGES = [
    page(1, "https://acme.io/", HOME),
    page(2, "https://acme.io/team/?utm=1", "Team y@acme.io"),
    page(3, "https://gone.io/about", "its home page is missing"),
    page(4, "https://many.io", "".join(f'<a href="/team/{k}">t</a>' for k in range(20))),
    page(5, "https://spaced.io", "found", status=None),
    *[page(k, "https://copies.io/", f"copy{k}") for k in range(150, 105, -1)],
    *[page(200 + k, f"https://hub.io/u{k}", '<a href="/about">a</a>') for k in range(40)],
    page(300, "https://hub.io/about", "About the hub"),
]


@pytest.fixture(scope="module")
def crawled(spark):
    """Page rows by seed."""
    by_seed = {}
    rows = crawl.crawl(tables.seed_list(spark, SEEDS), make_pages(spark, PAGES)).collect()
    for r in sorted(rows, key=lambda r: r["page_no"]):
        by_seed.setdefault(r["domain"], []).append(r)
    return by_seed


def test_frontier_order_missing_pages_and_errors(crawled):
    rows = crawled["acme.io"]  # given three times, crawled once
    assert [(r["page_no"], r["url"], r["status_code"]) for r in rows] == [
        (0, "https://acme.io", 200), (1, "https://acme.io/about", 500),
        (2, "https://acme.io/team", 200), (3, "https://jobs.acme.io/careers", 500)]
    assert rows[1]["error"] == crawl.NOT_FOUND and rows[1]["markdown"].startswith("Failed to crawl page")
    assert rows[2]["emails"] == ["y@acme.io"] and rows[1]["emails"] == []


def test_missing_home_has_no_subpages(crawled):
    rows = crawled["gone.io"]
    assert [(r["page_no"], r["status_code"], r["error"]) for r in rows] == [(0, 500, crawl.NOT_FOUND)]


def test_copies_of_one_url_use_the_smallest_page_id(crawled):
    assert [r["markdown"] for r in crawled["copies.io"]] == ["copy106"]


def test_seeds_on_one_host_share_pages(crawled):
    rows = [r for seed in HUB_SEEDS for r in crawled[seed]]
    assert len(rows) == 80
    assert {r["markdown"] for r in rows if r["page_no"] == 1} == {"About the hub"}


def test_link_limit_and_default_status(crawled):
    assert len(crawled["many.io"]) == 5
    assert [(r["url"], r["status_code"]) for r in crawled[" spaced.io\n"]] == [("https://spaced.io", 200)]
    assert [(r["page_no"], r["status_code"]) for r in crawled[None]] == [(0, 500)]


def test_only_wanted_copies_are_parsed(spark):
    pages = make_pages(spark, [page(k, f"https://c.io/{k % 20}", f"p{k}") for k in range(2000)])
    ids = spark.createDataFrame([(3,), (7,)], "page_id bigint")
    picked = pick_rows(pages, ids, "page_id")
    found = [r["page_id"] for r in picked.collect()]
    assert {3, 7} <= set(found) and len(found) < 10 and picked.columns == pages.columns
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert pick_rows(pages, ids.limit(0), "page_id").count() == 0


def test_rows_are_dropped_in_place(spark):
    df = spark.createDataFrame([(k, f"t{k % 7}") for k in range(3000)] + [(None, "n"), (None, "m")], "id bigint, t string")
    gone = spark.createDataFrame([(k, f"t{k % 7}") for k in range(0, 3000, 3)] + [(1, "other"), (None, "n")], "id bigint, t string")
    left = drop_rows(df, gone, "id")
    assert sorted(r["id"] or -1 for r in left.collect()) == [-1, *[k for k in range(3000) if k % 3]]
    ids = gone.select("id").filter("id is not null")
    assert drop_rows(df, ids, "id").count() == 2001 and drop_rows(df, ids.limit(0), "id").count() == 3002


def test_the_filter_grows_with_the_ids(spark):
    assert session.filter_blocks(0) == session.filter_blocks(1) == 2
    assert session.filter_blocks(10**9) is None and session.filter_blocks(40_000_000) == session.MOST_BLOCKS
    ids = spark.range(0, 10_000_000, 2)  # more than 2**25 / 8
    others = spark.range(1, 400_001, 2)
    assert pick_rows(others, ids, "id").count() <= 0.02 * 200_000
    assert pick_rows(spark.range(0, 400_000, 2), ids, "id").count() == 200_000


def test_too_many_ids_for_a_filter_are_joined(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(50)] + [(None, "n")], "id bigint, t string")
    ids = spark.createDataFrame([(3,), (3,), (40,), (99,)], "id bigint")
    picked = pick_rows(df, ids, "id", most_blocks=0)
    assert sorted(r["id"] for r in picked.collect()) == [3, 40] and picked.columns == df.columns
    gone = df.filter("id % 2 = 0 OR id IS NULL")
    assert sorted(r["id"] for r in drop_rows(df, gone, "id", most_blocks=0).collect()) == list(range(1, 50, 2))


def leaf_rows(df):
    """Rows that the scan hands on, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return plan.metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [page(k, f"https://s{k % 500:03}.io/{'' if k < 500 else 'about'}", f'<a href="/about">a</a>{"x" * 500}{k}') for k in range(1000)]
    rows += [page(2000 + k, "https://s007.io/", "copy", status=200 if k % 2 else 500) for k in range(300)] + [page(7000, None), page(7001, "s1")]
    pages = make_pages(spark, rows)
    path = str(tmp_path_factory.mktemp("layout") / "p")
    return pages, layout.write_pages(pages, path, shards=8, row_group_bytes=4096)


def test_a_stored_layout_gives_the_same_crawl(spark, stored):
    pages, laid_out = stored
    seeds = tables.seed_list(spark, ["s007.io", "s008.io", "s499.io", "none.io", None, "s008.io"])
    plain = sorted(map(str, crawl.crawl(seeds, pages).collect()))
    again = layout.StoredPages(spark, laid_out.path)
    assert sorted(map(str, crawl.crawl(seeds, again).collect())) == plain and len(plain) > 5
    narrow = crawl.crawl(seeds, again, contents=False)
    assert sorted(narrow.columns) == ["domain", "error", "page_no", "start_url", "status_code", "url"]
    assert narrow.count() == len(plain)


def test_a_stored_layout_reads_few_shards_and_row_groups(spark, stored):
    _, laid_out = stored
    index = laid_out.index()
    wanted = index.filter("page_key LIKE '%s007.io%'")
    picked = laid_out.pick(wanted)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "In(page_id" in plan or "EqualTo(page_id" in plan
    assert {r["page_id"] for r in picked.collect()} == {r["page_id"] for r in wanted.collect()}
    total = laid_out.rows.count()
    assert leaf_rows(picked) < total / 4
    # ids that are in no row group, though between the least and largest of one
    none = laid_out.rows.filter("page_id = 1500")
    assert leaf_rows(none) == 0


def test_many_wanted_ids_use_the_filter(spark, stored, monkeypatch):
    _, laid_out = stored
    monkeypatch.setattr(layout, "PUSHED_IDS", 3)
    wanted = laid_out.index().limit(200)
    assert {r["page_id"] for r in wanted.collect()} <= {r["page_id"] for r in laid_out.pick(wanted).collect()}
    assert laid_out.pick(wanted.limit(0)).count() == 0


def test_empty_layout(spark, tmp_path):
    laid_out = layout.write_pages(make_pages(spark, []), str(tmp_path / "p"))
    rows = crawl.crawl(tables.seed_list(spark, ["a.io"]), laid_out).collect()
    assert [(r["status_code"], r["error"]) for r in rows] == [(500, crawl.NOT_FOUND)]


def test_host_case_default_port_and_best_copy(spark):
    pages = make_pages(spark, [
        page(1, "https://Up.io", '<a href="/Team">t</a>upper'), page(2, "https://up.io:443/Team", "port"),
        page(3, "https://best.io", "failed", status=503), page(4, "https://BEST.io/", "served"),
        page(5, "https://down.io", "a", status=500), page(6, "https://down.io/", "b", status=404)])
    seeds = tables.seed_list(spark, ["up.io", "UP.io:443", "best.io", "down.io"])
    rows = {(r["domain"], r["page_no"]): r for r in crawl.crawl(seeds, pages).collect()}
    assert rows["up.io", 0]["status_code"] == 200 and rows["up.io", 1]["markdown"] == "port"
    assert rows["up.io", 1]["url"] == "https://up.io/Team"  # what is put out keeps its form
    assert rows["UP.io:443", 0]["markdown"] == rows["up.io", 0]["markdown"]
    assert rows["best.io", 0]["markdown"] == "served"
    assert rows["down.io", 0]["status_code"] == 500


def test_page_text_is_cut_early(spark):
    pages = make_pages(spark, [page(1, "https://long.io", "x" * 1_000_000 + " a@long.io")])
    row = crawl.crawl(tables.seed_list(spark, ["long.io"]), pages, max_chars=50).first()
    assert len(row["markdown"]) == 50 and row["emails"] == ["a@long.io"]


def page_row(no, url, markdown, status=200, error=None, emails=(), urls=()):
    return ("acme.io", no, url, status, markdown, list(emails), list(urls), error)


ROW = ("domain string, page_no bigint, url string, status_code int, markdown string, emails array<string>, "
       "linkedin_urls array<string>, error string")


def test_context_order_and_failed_pages(spark):
    rows = spark.createDataFrame([
        page_row(2, "u2", "two", emails=["b@x.io", "a@x.io"]), page_row(0, "u0", "zero", emails=["b@x.io"]),
        page_row(1, "u1", "", urls=["l"]), page_row(3, "u3", "Failed to crawl page: x", 500, "x"),
        page_row(4, "u4", "served with an error", 503)], ROW)
    strict = sites.site_profiles(rows).first()
    assert strict["context"] == "--- PAGE: u0 ---\nzero\n\n--- PAGE: u2 ---\ntwo"
    assert strict["pages_crawled"] == ["u0", "u1", "u2", "u3", "u4"]
    assert strict["emails"] == ["a@x.io", "b@x.io"] and strict["linkedin_urls"] == ["l"]
    assert strict["home_status"] == 200
    everything = sites.site_profiles(rows, include_failed=True).first()["context"]
    assert everything.endswith("--- PAGE: u3 ---\nFailed to crawl page: x\n\n--- PAGE: u4 ---\nserved with an error")
    assert sites.site_profiles(rows, max_chars=5).first()["context"].startswith("--- P\n... [")
    assert sorted((r["kind"], r["contact"]) for r in sites.contact_rows(rows).collect()) == [
        ("email", "a@x.io"), ("email", "b@x.io"), ("linkedin", "l")]


def test_salted_join_equals_plain_join(spark):
    rng = random.Random(1)
    left = [(k, "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 30)}") for k in range(3000)]
    left += [(-1, None), (-2, "absent")]
    right = [("hot", 1)] + [(f"k{k}", k) for k in range(0, 30, 2)]
    a = spark.createDataFrame(left, "id bigint, k string")
    b = spark.createDataFrame(right, "k string, v int")
    salted = left_join_salted(a, b, "k", "id", slice_rows=100)
    plain = a.join(b, "k", "left")
    key = lambda r: (r["id"], r["k"] or "", r["v"] or 0)
    assert sorted(map(key, salted.collect())) == sorted(map(key, plain.collect()))
    assert salted.columns == ["k", "id", "v"]


def test_every_hot_key_is_sliced(spark):
    keys = 12_000
    a = spark.range(3 * keys).select("id", (F.col("id") % keys).cast("string").alias("k"))
    slices = hot_slices(a, "k", slice_rows=2)
    assert slices.count() == keys and slices.agg(F.min("_slices"), F.max("_slices")).first()[:] == (2, 2)
    b = spark.range(keys).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    joined = left_join_salted(a, b, "k", "id", slice_rows=2)
    assert joined.filter("v = cast(k AS bigint)").count() == joined.count() == 3 * keys


def test_scratch_folder(spark, tmp_path, monkeypatch):
    assert session.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    with session.scratch_run(spark):
        table = session.materialize(spark.range(3), "t")
        folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
        assert table.count() == 3 and os.path.isdir(folder)
    assert not os.path.exists(os.path.dirname(folder))

    class Context:
        master = "spark://h:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session)
    Context.getCheckpointDir = staticmethod(lambda: "hdfs://n/ck/")
    assert session.scratch_root(Session) == "hdfs://n/ck"


@pytest.mark.parametrize("hot", ["hot", None])
def test_hot_key_is_spread(spark, hot):
    a = spark.range(20_000).select(F.col("id"), F.lit(hot).cast("string").alias("k"))
    b = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = left_join_salted(a, b, "k", "id", slice_rows=300)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 8_000


def test_without_hot_keys_each_side_moves_once(spark):
    a = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("k"))
    b = spark.range(0, 50, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted((r["id"], r["k"], r["v"]) for r in a.join(b, "k", "left").collect())
    for limit, joins in ((400, 1), (300, 1), (10, 3)):  # plain; many nulls only; hot keys
        joined = left_join_salted(a, b, "k", "id", slice_rows=limit)
        assert joined.columns == ["k", "id", "v"]
        assert sorted(((r["id"], r["k"], r["v"]) for r in joined.collect()), key=lambda r: r[0]) == sorted(
            a.join(b, "k", "left").select("id", "k", "v").collect(), key=lambda r: r[0])
        assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == joins, limit
    assert len(want) == 1000


def test_join_on_a_further_column(spark):
    a = spark.createDataFrame([(k, k % 7, k % 2 == 0) for k in range(300)], "id long, k long, f boolean")
    b = spark.createDataFrame([(k, f, f"{k}{f}") for k in range(5) for f in (True, False)], "k long, f boolean, v string")
    for limit in (1000, 10):
        got = left_join_salted(a, b, "k", "id", slice_rows=limit, also=("f",)).collect()
        assert len(got) == 300
        assert all(r["v"] == (f"{r['k']}{r['f']}" if r["k"] < 5 else None) for r in got)


def test_index_takes_the_smallest_served_page(spark):
    rows = [("a", 3, 200), ("a", 1, 500), ("a", 2, 200), ("b", 9, 500), ("b", 8, 404), ("c", None, 200), ("c", 4, 200),
            ("d", None, 500), ("d", 5, 200), (None, 6, 200)]
    keyed = spark.createDataFrame(rows, "page_key string, page_id long, status_code int")
    found = layout.standing_pages(keyed, ["page_id"])
    assert {(r["page_key"], r["page_id"]) for r in found.collect()} == {
        ("a", 2), ("b", 8), ("c", None), ("d", 5), (None, 6)}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_page_text_is_joined_once(spark, monkeypatch):
    """Pages picked by chance fall out in the join to the frontier, not in one of their own."""
    monkeypatch.setattr(layout, "pick_rows", lambda df, ids, key: df)  # every page passes
    seeds = spark.createDataFrame([(k, s) for k, s in enumerate(SEEDS)], "seed_no long, domain string")
    rows = crawl.crawl(seeds, make_pages(spark, PAGES))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    home = [r for r in rows.collect() if r["url"] == "https://acme.io"]
    assert len(home) == 1 and home[0]["emails"] == ["x@acme.io"]
