"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Patterns find candidates. The value of each candidate is hashed, and for each hash the
distinct repositories and owners that hold it are counted over the whole corpus: a value
that many owners share, or that one owner keeps in many repositories, is an example that
was copied; one that few hold and that looks random may be live. Random-looking strings without any keyword are reported only if the
counts say that they are owner-specific.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitefold.session import materialize

#: Fixed patterns of the base kinds: pattern, group of the value, least length of it.
BASE = {
    "assign": (
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    # a run of 20 or more is a run whose tail has 16 or more
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Further kinds of this scan: prefixed provider tokens and random-looking strings.
EXTRA = {
    "provider": (
        r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
        r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
        0,
        14,
    ),
    "opaque": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
}
KINDS = {**BASE, **EXTRA}
#: A value of more owners than this is a copied example.
MAX_OWNERS = 2
#: So is a value of more repositories than this, however few own them.
MAX_REPOSITORIES = 4
#: A random-looking value has so many different characters.
LEAST_CHARACTERS = 8


def _candidates(kind: str, matches: Column, pieces: Column) -> Column:
    pattern, group, least = KINDS[kind]

    def one(match: Column, k: Column) -> Column:
        value = F.regexp_extract(match, pattern, group) if group else match
        return F.struct(
            F.lit(list(KINDS).index(kind)).alias("kind_no"),
            k.alias("k"),
            F.length(F.get(pieces, k)).cast("long").alias("gap"),
            F.length(match).cast("long").alias("size"),
            F.when(F.length(value) >= least, value).alias("value"),
        )

    return F.transform(matches, one)


def _looks_random(value: Column) -> Column:
    return (
        value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS)
    )


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per candidate with its place, and one with nulls for a row without any.

    Texts are searched where they lie. Matches and the pieces between them alternate, so a
    running sum of their lengths gives the places; only these narrow rows are shuffled.
    """
    rows = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_no"),
        owner.alias("owner"),
        repository.alias("repository"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.select(
        "*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, (p, _, _) in KINDS.items()]
    )
    rows = rows.select(
        "doc_id", "row_no", "owner", "repository",
        *[f"m_{k}" for k in KINDS],
        *[
            F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"p_{k}")
            for k, (p, _, _) in KINDS.items()
        ],
    )
    found = F.concat(*[_candidates(k, F.col(f"m_{k}"), F.col(f"p_{k}")) for k in KINDS])
    flat = rows.select("doc_id", "row_no", "owner", "repository", F.explode_outer(found).alias("c"))
    order = Window.partitionBy("row_no", "kind_no").orderBy("k")
    flat = flat.select("doc_id", "row_no", "owner", "repository", "c.*")
    return flat.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)).select(
        "doc_id",
        "row_no",
        "owner",
        "repository",
        "kind_no",
        (F.col("end") - F.col("size")).alias("start"),
        "end",
        F.when(F.col("value").isNotNull(), F.xxhash64(F.lower("value"))).alias("value_hash"),
        _looks_random(F.col("value")).alias("random"),
        (F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")).alias("mixed_case"),
    )


def _span(c: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(":", F.get(names, c["kind_no"]), c["start"], c["end"])


def _of_kind(number: int):
    return lambda span: span["kind_no"] == number


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, _span), ",")


def scan(
    docs: DataFrame,
    owner: Column | None = None,
    repository: Column | None = None,
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per row of ``docs`` with its secrets.

    ``n_assign, n_access, n_hex``: base spans; ``base_spans`` and ``spans``: base and all
    spans as ``kind:start:end``, by start, then kind, joined by commas (code points, end
    exclusive); ``live_spans``: those whose value at most ``max_owners`` owners hold in at
    most ``max_repositories`` repositories and that looks random; ``n_live`` and
    ``n_example`` (values of more owners or repositories) count spans; ``owners`` and
    ``repositories``: the most that hold one value of the row (0 without spans). ``owner``
    is by default ``source``, ``repository`` source and language; repositories of one name
    and different owners are different. A null owner or repository counts as one. Null and empty texts have no spans; rows that repeat are each
    scanned. An empty table gives no rows; other columns are not read.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    found = materialize(
        candidates(docs, F.coalesce(owner.cast("string"), F.lit("")), F.coalesce(repository.cast("string"), F.lit(""))),
        "secret-candidates",
    )
    spread = (
        found.filter("value_hash is not null")
        .groupBy("value_hash", "owner", "repository").agg(F.lit(1))
        .groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("value_hash")
        .agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))
    )
    with_value = found.filter("value_hash is not null").join(spread, "value_hash")
    # rows without a value, most of all, have nothing to join and would meet in one task
    without = found.filter("value_hash is null").withColumns(
        {c: F.lit(None).cast("long") for c in ("repositories", "owners")}
    )
    marked = with_value.unionByName(without).withColumn(
        "copied", (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    )
    marked = marked.withColumn("live", ~F.col("copied") & F.col("random"))
    first_extra, opaque = len(BASE), list(KINDS).index("opaque")
    # hex strings and access keys have kinds of their own, so this one has both cases
    shown = F.col("value_hash").isNotNull() & (
        (F.col("kind_no") != opaque) | (F.col("live") & F.col("mixed_case"))
    )
    span = F.struct("start", "kind_no", "end", "live", "copied", "owners", "repositories")
    per_row = marked.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"),
        # the spans of one text, bounded by its length
        F.sort_array(F.collect_list(F.when(shown, span))).alias("found"),
    )
    base = F.filter("found", lambda c: c["kind_no"] < first_extra)
    live = F.filter("found", lambda c: c["live"])
    return per_row.select(
        "doc_id",
        *[
            F.size(F.filter("found", _of_kind(n))).cast("long").alias(f"n_{k}")
            for n, k in enumerate(BASE)
        ],
        _joined(base).alias("base_spans"),
        _joined(F.col("found")).alias("spans"),
        _joined(live).alias("live_spans"),
        F.size(live).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda c: c["copied"])).cast("long").alias("n_example"),
        *[
            F.coalesce(F.array_max(F.transform("found", lambda c: c[k])), F.lit(0)).alias(k)
            for k in ("owners", "repositories")
        ],
    )
