"""The whole flow on a hand-made batch, the sinks, and every query against its SQL."""

import csv
import glob
import json
import os
import re

import duckdb
import pytest
from pyspark.sql import DataFrameWriter, functions as F

import __spark_entry__ as entry
import check
from sitefold import schemas
from sitefold.operators import costs
from sitefold.operators import crawl
from sitefold.plans import catalog, oracle
from sitefold.plans.enrich import INPUTS, enrich, run_key
from sitefold.plans.fixtures import TABLES
from sitefold.session import fingerprint, scratch_path
from sitefold.sources import sinks, tables

SMALL = "/root/testdata/sf0.001"


def small_inputs(spark, body="<p>hi</p>"):
    pages = spark.createDataFrame(
        [(1, "https://acme.io", 200, '<p>Acme builds developer tools, for everyone. It ships every single day to customers.</p>'
          '<p>Ada Stone, CEO</p><a href="/team">t</a> info@acme.io "q"'),
         (2, "https://acme.io/team", 200, "<p>CTO: Bo Lind</p>"), (3, "https://bare.io", 200, body)],
        schemas.PAGES)
    hits = spark.createDataFrame(
        [('"Ada Stone" "Acme" site:linkedin.com/in', 1, "Ada", "https://linkedin.com/in/ada", "")], schemas.SEARCH_RESULTS)
    kb = spark.createDataFrame([], schemas.KNOWLEDGE_BASE)
    seeds = tables.seed_list(spark, ["acme.io", "gone.io", "acme.io", "bare.io", None])
    return seeds, pages, kb, costs.model_prices(spark), hits


@pytest.fixture(scope="module")
def records(spark):
    return enrich(*small_inputs(spark))


class Stopped(Exception):
    pass


def test_a_stopped_run_goes_on(spark, records, tmp_path, monkeypatch):
    root, written, limit = str(tmp_path / "runs"), [], [2]
    plain = DataFrameWriter.parquet

    def parquet(self, path, **options):
        if len(written) == limit[0]:
            raise Stopped
        written.append(path)
        return plain(self, path, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    with pytest.raises(Stopped):
        enrich(*small_inputs(spark), resume=root)
    first, limit[0] = list(written), None
    want = sorted(map(str, records.collect()))
    assert sorted(map(str, enrich(*small_inputs(spark), resume=root).collect())) == want
    later = written[len(first):]
    assert len(first) == 2 and later and not set(first) & set(later)  # the two are taken up
    done = len(written)
    assert sorted(map(str, enrich(*small_inputs(spark), resume=root).collect())) == want
    assert len(written) == done  # nothing is written again
    os.remove(f"{later[0]}.json")  # a table without its entry is not trusted
    assert sorted(map(str, enrich(*small_inputs(spark), resume=root).collect())) == want
    assert written[done:] == later[:1]
    changed = enrich(*small_inputs(spark, "<p>changed</p>"), resume=root)
    assert len(written) > done + 5 and changed.count() == len(want)
    other = len(written)
    enrich(*small_inputs(spark), resume=root, compat=True)
    assert len(written) > other + 5


def test_fingerprints(spark):
    rows = [(1, "a", [1.0]), (2, None, None), (2, None, None)]
    of = lambda r, schema="a int, b string, c array<double>": fingerprint(spark.createDataFrame(r, schema))
    assert of(rows) == of(rows[::-1])
    assert len({of(rows), of(rows[:2]), of([]), of(rows, "x int, b string, c array<double>"), of([(None, "a", None)]),
                of([(1, "a", [2.0]), *rows[1:]])}) == 6
    swapped = "a string, b string"
    assert fingerprint(spark.createDataFrame([(None, "v")], swapped)) != fingerprint(spark.createDataFrame([("v", None)], swapped))


def test_versions_stand_for_inputs(spark):
    options = {"compat": False}
    named = dict.fromkeys(INPUTS, "v1")
    key = run_key((None,) * 6, options, named)
    assert key == run_key((object(),) * 6, options, named) != run_key((None,) * 6, options, named | {"kb": "v2"})
    with pytest.raises(ValueError):
        run_key((None,) * 6, options, {"page": "v1"})


def test_one_record_per_seed(records):
    rows = {r["seed_no"]: r for r in records.collect()}
    assert len(rows) == 5
    assert rows[4]["error"] == "missing:domain"  # one bad seed, the others are unaffected
    assert rows[0].asDict() | {"seed_no": 2} == rows[2].asDict()
    acme = rows[0]
    assert acme["company_overview"] == (
        "Acme builds developer tools, for everyone. It ships every single day to customers..")
    assert [(x["name"], x["linkedin_url"]) for x in acme["key_leadership"]] == [
        ("Ada Stone", "https://linkedin.com/in/ada"), ("Bo Lind", None)]
    assert acme["pages_crawled"] == ["https://acme.io", "https://acme.io/team"]
    assert len(acme["search_queries_used"]) == 2 and acme["data_confidence_score"] == 1.0
    gone = rows[1]
    assert gone["home_status"] == 500 and gone["error"] is None  # an unreachable site still counts
    assert gone["data_confidence_score"] == 0.85 and gone["cost_metrics"]["input_tokens"] == 0
    assert gone["search_queries_used"] == ['"Gone" founder CEO CTO site:linkedin.com/in']


def test_batch_summary(records):
    row = costs.batch_summary(records).first()
    assert (row["total_domains"], row["successful_domains"], row["failed_domains"]) == (5, 4, 1)
    per = [r["cost_metrics"] for r in records.collect() if r["cost_metrics"]]
    assert row["total_tokens"] == sum(p["total_tokens"] for p in per)
    assert row["estimated_cost_usd"] == pytest.approx(sum(p["estimated_cost_usd"] for p in per))


def test_sinks(spark, records):
    lead = records.filter("error IS NULL").select(*schemas.LEAD.fieldNames())
    path = scratch_path(spark, "json")
    sinks.write_json(lead, path)
    docs = [json.loads(line) for f in glob.glob(path + "/*.json") for line in open(f, encoding="utf-8")]
    assert len(docs) == 4 and list(docs[0]) == schemas.LEAD.fieldNames()
    acme = next(d for d in docs if d["domain"] == "acme.io")
    assert acme["key_leadership"][1] == {"name": "Bo Lind", "role": "CTO", "linkedin_url": None}
    assert sorted(map(str, sinks.read_json(spark, path).collect())) == sorted(map(str, lead.collect()))

    path = scratch_path(spark, "csv")
    sinks.write_report(lead, path)
    rows = [r for f in glob.glob(path + "/*.csv") for r in csv.DictReader(open(f, encoding="utf-8", newline=""))]
    assert len(rows) == 4 and tuple(rows[0]) == schemas.REPORT_COLUMNS
    acme = next(r for r in rows if r["domain"] == "acme.io")
    assert acme["key_leadership"] == "Ada Stone (CEO) - https://linkedin.com/in/ada; Bo Lind (CTO)"
    assert acme["contact_points"] == "info@acme.io" and acme["data_confidence_score"] == "1.0"
    gone = next(r for r in rows if r["domain"] == "gone.io")
    assert gone["contact_points"] == "" and gone["key_leadership"] == ""


def test_summary_and_failures(spark, records, tmp_path):
    sinks.write_summary(records, str(tmp_path / "summary"))
    sinks.write_failures(records, str(tmp_path / "failures"))
    assert spark.read.json(str(tmp_path / "summary")).first()["failed_domains"] == 1
    failures = spark.read.json(str(tmp_path / "failures")).collect()
    assert [(r["seed_no"], r["error"]) for r in failures] == [(4, "missing:domain")]


def test_seed_file(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("acme.io\n\nacme.io\n")
    rows = tables.seed_file(spark, str(tmp_path / "seeds.txt")).collect()
    assert sorted((r["seed_no"], r["domain"]) for r in rows) == [(0, "acme.io"), (1, ""), (2, "acme.io")]


@pytest.mark.parametrize("split", ["128m", "700", "64"])
def test_seed_files_count_on_from_file_to_file(spark, tmp_path, split):
    files = {"a.txt": ["a0"], "b.txt": [f"b{k}" for k in range(300)], "c.txt": [], "d.txt": ["", "d1", "d1"], "é f.txt": ["z"] * 40}
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(line + "\n" for line in lines), encoding="utf-8")
    names = sorted(files, key=lambda n: n.encode() if n.isascii() else b"\xff")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = tables.seed_file(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [line for name in names for line in files[name]]
    assert [r["domain"] for r in sorted(rows, key=lambda r: r["seed_no"])] == want
    assert sorted(r["seed_no"] for r in rows) == list(range(len(want)))


def test_report_lines_are_read_by_several_tasks(spark, records):
    texts = ['A "b", c\nd', "\\n", "a\\\\\nb\\", "\r\n", "\\\r\\r", '"', ",", "plain" * 50]
    odd = F.element_at(F.array(*map(F.lit, texts)), (F.col("k") % len(texts) + 1).cast("int"))
    lead = records.filter("error IS NULL").select(*schemas.LEAD.fieldNames()).limit(1)
    many = lead.crossJoin(F.broadcast(spark.range(4000).toDF("k"))).withColumn("company_overview", odd)
    path = scratch_path(spark, "csv-lines")
    sinks.write_report(many.coalesce(1), path, by_line=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        back = sinks.read_report(spark, path, by_line=True)
        assert back.rdd.getNumPartitions() > 4
        found = [r["company_overview"] for r in back.select("company_overview").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(glob.glob(path + "/*.csv")) == 1
    assert sorted(found) == sorted(texts * (4000 // len(texts)))
    row = back.filter("company_overview = ','").first()
    assert row["company_name"] == lead.first()["company_name"] and row["input_tokens"] == lead.first()["cost_metrics"]["input_tokens"]


def test_csv_quotes_and_line_ends(spark, records):
    odd = records.filter("error IS NULL").select(*schemas.LEAD.fieldNames()).withColumn("company_name", F.lit('A "b", c\nd'))
    path = scratch_path(spark, "csv")
    sinks.write_report(odd, path)
    assert {r["company_name"] for r in sinks.read_report(spark, path).collect()} == {'A "b", c\nd'}
    rows = [r for f in glob.glob(path + "/*.csv") for r in csv.DictReader(open(f, encoding="utf-8", newline=""))]
    assert {r["company_name"] for r in rows} == {'A "b", c\nd'}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.registered()) == set(oracle.statements())
    assert set(catalog.registered()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.registered()))
def test_query_agrees_with_sql(spark, con, name):
    assert check.compare(spark, con, name, SMALL) is None


def executed_plans(spark, run):
    """Plans of everything that ``run`` executes while it is called, and of its result."""
    plans = []
    write = DataFrameWriter.parquet

    def noted(self, path, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **options)

    DataFrameWriter.parquet = noted
    try:
        plans.append(run()._jdf.queryExecution().executedPlan().toString())
    finally:
        DataFrameWriter.parquet = write
    return plans


@pytest.mark.parametrize("name", list(catalog.registered()))
def test_plan_has_no_cross_join_and_no_row_python(spark, name):
    for plan in executed_plans(spark, lambda: catalog.registered()[name](spark, SMALL)):
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert operator not in plan


@pytest.mark.parametrize("flow", ["crawl", "enrich"])
def test_html_is_never_shuffled(spark, tmp_path, flow):
    pages = spark.createDataFrame([(1, "https://acme.io", 200, "<p>x</p>")], schemas.PAGES)
    pages.write.parquet(str(tmp_path / "pages"))
    pages = tables.pages(spark, str(tmp_path / "pages"))
    seeds = tables.seed_list(spark, ["acme.io"])
    hits = spark.createDataFrame([], schemas.SEARCH_RESULTS)
    kb = spark.createDataFrame([], schemas.KNOWLEDGE_BASE)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = executed_plans(spark, lambda: crawl.crawl(seeds, pages) if flow == "crawl" else enrich(
            seeds, pages, kb, costs.model_prices(spark), hits))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    reading = [p for p in plans if re.search(r"html#\d+", p)]
    assert len(reading) >= 2
    for plan in reading:  # the way from the scan of the HTML up to the parser has no exchange
        steps = plan.split("\n")
        scan = next(k for k, step in enumerate(steps) if "FileScan" in step and re.search(r"html#\d+", step))
        parser = max(k for k, step in enumerate(steps[:scan]) if "MapInArrow" in step)
        depth = [len(step) - len(step.lstrip(" :+-")) for step in steps]
        above, level = [], depth[scan]
        for k in range(scan - 1, parser, -1):
            if depth[k] < level:
                above.append(steps[k])
                level = depth[k]
        assert above and not any("Exchange" in step or "Sort" in step for step in above), plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "company_name" in df.columns


@pytest.mark.parametrize("name", ["link_same_site"])
def test_page_url_is_split_once_not_per_link(spark, tmp_path, name):
    spark.createDataFrame([(1, "Customer#1", 3, "BUILDING")], "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(3, "N")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan[: plan.index("Generate")]
    rows = {(r["page_no"], r["link_no"]): r["url"] for r in df.collect()}
    assert rows[0, 3] == "https://building1.com/pricing?ref=1#top" and rows[0, 9] == "https://building1.com/team"
    assert (0, 8) not in rows
