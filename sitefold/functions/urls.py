"""URL handling as built-in column expressions.

Links are resolved inside the row that holds them: an array of raw hrefs becomes
an array of parts, then of resolved parts, then of canonical links. Each stage is
one ``transform``, so no expression is evaluated twice and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sitefold.functions.text import bound, strip

# --- fixed values -----------------------------------------------------------
TARGET_KEYWORDS = (
    "about", "about-us", "company", "team", "leadership", "contact", "contact-us",
    "pricing", "careers", "founders", "management",
)
SKIPPED_HREF = "^(#|javascript:|mailto:)"
# ----------------------------------------------------------------------------

# scheme, authority marker, authority, path, query, fragment (RFC 3986 appendix B,
# with the scheme held to its legal characters)
_PARTS = (
    r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)

# a path from the root without parameters, dots and control characters
_ROOTED = r"^/(?!/)[^?#:;.\x00-\x20]*(?:[?#][^\x00-\x20]*)?$"

# parameters of the last path segment, which do not count as part of the path
_PARAMS = ";[^/]*$"


def normalize_seed(seed: Column) -> Column:
    """Strip, and prefix ``https://`` unless a (lower-case) scheme is there."""
    s = strip(seed)
    return F.when(s.rlike("^https?://"), s).otherwise(F.concat(F.lit("https://"), s))


def clean_domain(seed: Column) -> Column:
    bare = F.replace(F.replace(seed, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.lower(F.substring_index(bare, "/", 1))


def company_name(domain: Column) -> Column:
    label = F.substring_index(domain, ".", 1)
    return F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substr(label, F.lit(2))))


def split_url(url: Column) -> Column:
    """Struct of scheme, netloc, path, query, fragment; empty string where absent."""
    stray = url.rlike(r"^[\x00-\x20]|[\t\r\n]")
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    return bound(F.when(stray, clean).otherwise(url), _url_parts)


def _after(whole: Column, head: Column, separator: int) -> Column:
    """What follows ``head`` and a separator of so many characters."""
    return F.substr(whole, F.length(head) + (separator + 1))


def _url_parts(url: Column) -> Column:
    """The groups of ``_PARTS``. A path alone and a plain web address, which most links are,
    are cut at the first "#", "?" and "/"; only other forms are matched."""

    def parts(scheme: Column, netloc: Column, path: Column, cut: Column) -> Column:
        return F.struct(
            scheme.alias("scheme"),
            netloc.alias("netloc"),
            path.alias("path"),
            cut["query"].alias("query"),
            cut["fragment"].alias("fragment"),
        )

    def tail(whole: Column) -> Column:
        def with_query(before: Column) -> Column:
            head = F.substring_index(before, "?", 1)
            return F.struct(
                head.alias("head"),
                _after(before, head, 1).alias("query"),
                _after(whole, before, 1).alias("fragment"),
            )

        plain = ~(whole.contains("#") | whole.contains("?"))
        none = F.lit("")
        return F.when(
            plain, F.struct(whole.alias("head"), none.alias("query"), none.alias("fragment"))
        ).otherwise(bound(F.substring_index(whole, "#", 1), with_query))

    def web(scheme: str) -> Column:
        def address(cut: Column) -> Column:
            rest = _after(cut["head"], F.lit(f"{scheme}://"), 0)
            return bound(
                rest,
                lambda r: bound(
                    F.substring_index(r, "/", 1), lambda host: parts(F.lit(scheme), host, _after(r, host, 0), cut)
                ),
            )

        return bound(tail(url), address)

    def matched(group: int) -> Column:
        return F.regexp_extract(url, _PARTS, group)

    return (
        F.when(
            ~(url.contains(":") | url.startswith("//")),
            bound(tail(url), lambda cut: parts(F.lit(""), F.lit(""), cut["head"], cut)),
        )
        .when(url.startswith("https://"), web("https"))
        .when(url.startswith("http://"), web("http"))
        .otherwise(
            F.struct(
                F.lower(matched(1)).alias("scheme"),
                matched(3).alias("netloc"),
                matched(4).alias("path"),
                matched(5).alias("query"),
                matched(6).alias("fragment"),
            )
        )
    )


def unsplit_url(p: Column) -> Column:
    path = F.when(
        (p["netloc"] != "") & (p["path"] != "") & ~p["path"].startswith("/"),
        F.concat(F.lit("/"), p["path"]),
    ).otherwise(p["path"])
    return F.concat(
        F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(F.lit("")),
        F.when(
            (p["netloc"] != "")
            | (p["scheme"].isin("http", "https") & ((path == "") | path.startswith("/"))),
            F.concat(F.lit("//"), p["netloc"]),
        ).otherwise(F.lit("")),
        path,
        F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")),
        F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(F.lit("")),
    )


def _without_dot_segments(segments: Column) -> Column:
    """Apply "." and ".." segment by segment; a trailing one leaves a slash."""
    root = F.array(F.lit("")).cast("array<string>")
    resolved = F.aggregate(
        segments,
        F.slice(root, 1, 0),
        lambda acc, seg: F.when(
            seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg))),
    )
    return F.when(
        F.element_at(segments, -1).isin(".", ".."), F.concat(resolved, root)
    ).otherwise(resolved)


def _merge_path(base_path: Column, ref_path: Column) -> Column:
    """Path of a relative reference against ``base_path`` (RFC 3986, 5.2)."""
    # parameters of the last segment take no part in the merge
    params = F.when(ref_path.contains(";"), F.regexp_extract(ref_path, _PARAMS, 0)).otherwise(F.lit(""))
    return F.concat(
        bound(_without_params(ref_path), lambda p: _merge_plain_path(base_path, p)),
        params,
    )


def _without_params(path: Column) -> Column:
    return F.when(path.contains(";"), F.regexp_replace(path, _PARAMS, "")).otherwise(path)


def _merge_plain_path(base_path: Column, path: Column) -> Column:
    # all segments but the last, which is a file name unless it is empty
    folder = F.regexp_replace(base_path, "[^/]+$", "")
    joined = F.split(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path), "/")

    def drop_inner_empty(segments: Column) -> Column:
        inner = F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0)))
        return F.concat(
            F.slice(segments, 1, 1), F.filter(inner, lambda s: s != ""), F.slice(segments, -1, 1)
        )

    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(
        bound(joined, drop_inner_empty)
    )
    merged = F.array_join(bound(segments, _without_dot_segments), "/")
    plain = path.startswith("/") & ~(path.contains(".") & path.rlike(r"(^|/)\.\.?(/|$)"))
    return F.when(plain, path).otherwise(
        bound(merged, lambda m: F.when(m == "", F.lit("/")).otherwise(m))
    )


def resolve_parts(base: Column, ref: Column) -> Column:
    """Resolve split reference ``ref`` against split ``base``."""
    foreign = (ref["scheme"] != "") & (ref["scheme"] != base["scheme"])
    own_host = ref["netloc"] != ""
    bare = ref["path"] == ""
    return F.when(foreign, ref).otherwise(
        F.struct(
            base["scheme"].alias("scheme"),
            F.when(own_host, ref["netloc"]).otherwise(base["netloc"]).alias("netloc"),
            F.when(own_host, ref["path"])
            .when(bare, base["path"])
            .otherwise(_merge_path(base["path"], ref["path"]))
            .alias("path"),
            F.when(~own_host & bare & (ref["query"] == ""), base["query"])
            .otherwise(ref["query"])
            .alias("query"),
            ref["fragment"].alias("fragment"),
        )
    )


def resolve_link(base_url: Column, href: Column) -> Column:
    """Absolute form of ``href`` found on ``base_url``."""
    parts = bound(
        split_url(base_url),
        lambda base: bound(split_url(href), lambda ref: resolve_parts(base, ref)),
    )
    foreign = F.lower(F.regexp_extract(href, _PARTS, 1)) != F.lower(
        F.regexp_extract(base_url, _PARTS, 1)
    )
    return (
        F.when(href == "", base_url)
        .when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") & foreign, href)
        .otherwise(bound(parts, unsplit_url))
    )


def resolve_all(base_url: Column, hrefs: Column) -> Column:
    """Array of ``(link_no, href, to)`` with ``to`` the parts of the resolved link."""
    return bound(split_url(base_url), lambda base: resolve_against(base, hrefs))


def resolve_against(base: Column, hrefs: Column) -> Column:
    """:func:`resolve_all` for a base that is split already."""
    return F.transform(
        hrefs,
        lambda h, i: F.struct(
            (i + 1).cast("bigint").alias("link_no"),
            h.alias("href"),
            bound(split_url(strip(h)), lambda ref: resolve_parts(base, ref)).alias("to"),
        ),
    )


def canonical_from_parts(p: Column) -> Column:
    path = _without_params(p["path"])
    slash = F.when((path != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.rtrim(F.concat(p["scheme"], F.lit("://"), p["netloc"], slash, path), F.lit("/"))


def canonical_url(url: Column) -> Column:
    """``scheme://host/path`` without query, fragment and trailing slashes."""
    plain = url.rlike(r"^https?://[^/?#;\x00-\x20][^?#;\t\r\n]*$")
    return F.when(plain, F.rtrim(url, F.lit("/"))).otherwise(
        bound(split_url(url), canonical_from_parts)
    )


def page_key(canonical: Column) -> Column:
    """Join key of a canonical URL: host in lower case and without its default port.

    For comparing pages only; URLs that are put out keep their form.
    """
    site = F.lower(F.regexp_extract(canonical, "^[^/]*//[^/]*", 0))
    rest = F.regexp_replace(canonical, "^[^/]*//[^/]*", "")
    return F.concat(F.regexp_replace(site, "^(https://.*):443$|^(http://.*):80$", "$1$2"), rest)


def same_site(host: Column, base_host: Column) -> Column:
    """Same host, or a subdomain of the base host; a port is part of the host."""
    h, b = F.lower(host), F.lower(base_host)
    return (h == b) | h.endswith(F.concat(F.lit("."), b))


def target_path(path: Column) -> Column:
    """A keyword occurs in the path; parameters of its last segment do not count."""
    return F.lower(_without_params(path)).rlike("|".join(TARGET_KEYWORDS))


def is_skippable(href: Column) -> Column:
    h = strip(href)
    return (h == "") | h.rlike(SKIPPED_HREF)


def _resolve_target(base: Column, href: Column) -> Column:
    """:func:`resolve_parts` of ``href`` without query and fragment where it is a plain path from
    the root, as most links are: then there is nothing to merge."""
    path = F.substring_index(F.substring_index(href, "#", 1), "?", 1)
    none = F.lit("")
    rooted = F.struct(
        base["scheme"].alias("scheme"),
        base["netloc"].alias("netloc"),
        path.alias("path"),
        none.alias("query"),
        none.alias("fragment"),
    )
    return F.when(href.rlike(_ROOTED), rooted).otherwise(
        bound(split_url(href), lambda ref: resolve_parts(base, ref))
    )


def site_links(base_url: Column, hrefs: Column) -> Column:
    """Canonical same-site target links of a page, first occurrence first."""
    usable = F.array_distinct(
        F.filter(F.transform(hrefs, strip), lambda h: (h != "") & ~h.rlike(SKIPPED_HREF))
    )

    def against(base: Column) -> Column:
        # a keyword lies within one segment, and a segment comes whole from the link or the base
        base_word = target_path(base["path"])
        likely = F.filter(
            usable, lambda h: F.lower(h).rlike("|".join(TARGET_KEYWORDS)) | base_word | h.rlike(r"[\t\r\n]")
        )
        return F.filter(
            F.transform(likely, lambda h: _resolve_target(base, h)),
            lambda p: same_site(p["netloc"], base["netloc"]) & target_path(p["path"]),
        )

    links = F.array_distinct(F.transform(bound(split_url(base_url), against), canonical_from_parts))
    return F.filter(links, lambda u: u != F.rtrim(base_url, F.lit("/")))


def discover_links(base_url: Column, hrefs: Column, max_links: int = 5) -> Column:
    """The first ``max_links`` of :func:`site_links`."""
    return F.coalesce(
        F.slice(site_links(base_url, hrefs), 1, max_links), F.array().cast("array<string>")
    )
