"""Declared schemas. Nothing is inferred from data."""

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SEEDS = _struct(seed_no=_L, domain=_S)
PAGES = _struct(page_id=_L, url=_S, status_code=T.IntegerType(), html=_S)

LEADER = _struct(name=_S, role=_S, linkedin_url=_S)
LEADERS = T.ArrayType(LEADER)
COST_METRICS = _struct(input_tokens=_L, output_tokens=_L, total_tokens=_L, estimated_cost_usd=_D)

LEAD = _struct(
    domain=_S,
    company_name=_S,
    company_overview=_S,
    target_audience=_S,
    contact_points=T.ArrayType(_S),
    key_leadership=LEADERS,
    data_confidence_score=_D,
    pages_crawled=T.ArrayType(_S),
    search_queries_used=T.ArrayType(_S),
    cost_metrics=COST_METRICS,
)

KNOWLEDGE_BASE = _struct(
    domain=_S, name=_S, overview=_S, icp=_S, contacts=T.ArrayType(_S), leadership=LEADERS
)
MODEL_PRICES = _struct(model=_S, in_milli=_L, out_milli=_L)
SEARCH_RESULTS = _struct(query=_S, rank=T.IntegerType(), title=_S, href=_S, body=_S)
RESPONSES = _struct(domain=_S, provider=_S, model=_S, raw_json=_S)
CALLS = _struct(call_id=_L, domain=_S, model=_S, input_tokens=_L, output_tokens=_L)

REPORT_COLUMNS = (
    "domain", "company_name", "company_overview", "target_audience", "contact_points",
    "key_leadership", "data_confidence_score", "input_tokens", "output_tokens",
    "estimated_cost_usd",
)
