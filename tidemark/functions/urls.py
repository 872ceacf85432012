"""Urls as columns: splitting, joining, relative references, per-board normal forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.bind import let
from tidemark.functions.text import strip, strip_right

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_FIELDS = ("scheme", "netloc", "path", "query", "fragment")
# fixed values: schemes whose relative references are resolved
RELATIVE_SCHEMES = ("", "ftp", "http", "https", "gopher", "file", "sftp", "ws", "wss")
_DOT_SEGMENT = r"(?:^|/)\.{1,2}(?:/|$)"
_PLAIN_ROOTED = r"^/(?:[^/?#;][^?#;]*)?$"


def split_url(url: Column) -> Column:
    """Struct(scheme, netloc, path, query, fragment); absent parts are empty strings."""

    def split(clean: Column) -> Column:
        parts = [F.regexp_extract(clean, f"(?s){_PARTS}", i + 1) for i in range(len(_FIELDS))]
        parts[0] = F.lower(parts[0])
        return F.struct(*[p.alias(n) for p, n in zip(parts, _FIELDS)])

    return let(F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", ""), split)


def unsplit_url(scheme, netloc, path, query="", fragment="") -> Column:
    scheme, netloc, path, query, fragment = (
        p if isinstance(p, Column) else F.lit(p) for p in (scheme, netloc, path, query, fragment)
    )

    def body(x: Column) -> Column:
        netloc, path = x["netloc"], x["path"]
        slash = F.when((path == "") | path.startswith("/"), F.lit("")).otherwise(F.lit("/"))
        bare_host = scheme.isin(*RELATIVE_SCHEMES[1:]) & path.rlike("^/|^$")
        return (
            F.when(netloc != "", F.concat(F.lit("//"), netloc, slash, path))
            .when(path.startswith("//") | bare_host, F.concat(F.lit("//"), path))
            .otherwise(path)
        )

    return F.concat(
        F.coalesce(F.concat(F.nullif(scheme, F.lit("")), F.lit(":")), F.lit("")),
        let(F.struct(netloc.alias("netloc"), path.alias("path")), body),
        F.coalesce(F.concat(F.lit("?"), F.nullif(query, F.lit(""))), F.lit("")),
        F.coalesce(F.concat(F.lit("#"), F.nullif(fragment, F.lit(""))), F.lit("")),
    )


def origin(url: Column) -> Column:
    """scheme://netloc"""
    return let(split_url(url), lambda p: F.concat(p["scheme"], F.lit("://"), p["netloc"]))


def host(url: Column) -> Column:
    """Lower-case host with port."""
    return F.lower(split_url(url)["netloc"])


def bare_path(parts: Column) -> Column:
    """Path without the `;parameters` of its last segment."""
    return F.regexp_replace(parts["path"], ";[^/]*$", "")


def path(url: Column) -> Column:
    return bare_path(split_url(url))


def path_parts(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(url), "/", -1), lambda p: p != "")


def _drop_dot_segments(segments: Column) -> Column:
    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(segment)))
        )

    none = F.array().cast("array<string>")
    closing = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.concat(F.reduce(segments, none, step), closing)


def _relative_segments(base_path: Column, ref_path: Column) -> Column:
    """Segments of a path relative to a base path's folder; empty ones only at the ends."""
    folder = F.regexp_replace(base_path, "[^/]+$", "")
    between = F.when(folder == "", F.lit("")).when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/"))
    joined = F.split(F.concat(folder, between, ref_path), "/", -1)

    def inner(segments: Column) -> Column:
        last = F.size(segments) - 1
        return F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == last))

    return let(joined, inner)


def _merged_path(base_path: Column, ref_path: Column) -> Column:
    """Path of a non-empty reference path against a base path."""
    segments = F.when(ref_path.startswith("/"), F.split(ref_path, "/", -1)).otherwise(
        _relative_segments(base_path, ref_path)
    )
    text = let(segments, lambda s: F.array_join(_drop_dot_segments(s), "/"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("/"))


def resolve_url(base: Column, ref: Column) -> Column:
    """`ref` as seen from the page `base`, with dot segments removed (RFC 3986 style)."""

    def general(parts: Column) -> Column:
        b, r = parts["b"], parts["r"]
        same_page = r["path"] == ""
        new_path = F.when(same_page, b["path"]).otherwise(_merged_path(b["path"], r["path"]))
        query = F.when(same_page & (r["query"] == ""), b["query"]).otherwise(r["query"])
        own_host = r["netloc"] != ""
        foreign = ~r["scheme"].isin("", b["scheme"]) | ~b["scheme"].isin(*RELATIVE_SCHEMES)
        target = unsplit_url(
            b["scheme"],
            F.when(own_host, r["netloc"]).otherwise(b["netloc"]),
            F.when(own_host, r["path"]).otherwise(new_path),
            F.when(own_host, r["query"]).otherwise(query),
            r["fragment"],
        )
        return F.when(foreign, parts["ref"]).otherwise(target)

    def choose(x: Column) -> Column:
        base, ref = x["base"], x["ref"]
        plain = ref.rlike(_PLAIN_ROOTED) & ~ref.rlike(_DOT_SEGMENT) & base.rlike(r"^https?://[^/?#]+")
        both = F.struct(split_url(base).alias("b"), split_url(ref).alias("r"), ref.alias("ref"))
        return (
            F.when(base.isNull() | ref.isNull(), F.lit(None).cast("string"))
            .when(base == "", ref)
            .when(ref == "", base)
            .when(plain, F.concat(F.regexp_extract(base, r"^https?://[^/?#]+", 0), ref))
            .otherwise(let(both, general))
        )

    return let(F.struct(base.alias("base"), ref.alias("ref")), choose)


def without_query(url: Column) -> Column:
    """Page identity: no query, no fragment, at least a root path."""
    rebuilt = let(
        split_url(strip(url)),
        lambda p: unsplit_url(p["scheme"], p["netloc"], F.coalesce(F.nullif(bare_path(p), F.lit("")), F.lit("/"))),
    )
    return F.when(url.isNotNull(), rebuilt)


def without_fragment(url: Column) -> Column:
    rebuilt = let(
        split_url(strip(url)), lambda p: unsplit_url(p["scheme"], p["netloc"], bare_path(p), p["query"])
    )
    return F.when(url.isNotNull(), rebuilt)


def registrable_domain(host_column: Column) -> Column:
    """Last two labels of the host."""
    labels = F.split(F.lower(host_column), r"\.", -1)
    return let(labels, lambda x: F.array_join(F.slice(x, F.greatest(-F.size(x), F.lit(-2)), F.lit(2)), "."))


def same_domain(a: Column, b: Column) -> Column:
    return registrable_domain(host(a)) == registrable_domain(host(b))


def same_site(base: Column, candidate: Column) -> Column:
    """Same host (and port), reachable over http or https."""
    return let(
        split_url(candidate),
        lambda c: (host(base) == F.lower(c["netloc"])) & c["scheme"].isin("http", "https"),
    )


def workday_parts(careers_url: Column) -> Column:
    """Struct(origin, tenant, site), or null when the url names no board."""
    locale = r"^[a-z]{2}-[A-Z]{2}$"

    def ordinary(p: Column) -> Column:
        return ~F.lower(p).isin("login", "jobs", "job", "apply", "search")

    def site(parts: Column) -> Column:
        """The piece after the first locale, else the last piece that is no page name."""
        after_locale = F.get(
            F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p, i: F.get(parts, i).rlike(locale)), F.lit(0)
        )
        last = F.try_element_at(F.filter(parts, lambda p: ordinary(p) & ~p.rlike(locale)), F.lit(-1))
        return let(after_locale, lambda a: F.coalesce(F.when(ordinary(a), a), last))

    def found(x: Column) -> Column:
        url = x["url"]
        tenant = F.lower(F.substring_index(url["netloc"], ".", 1))
        on_board = F.lower(url["netloc"]).contains("myworkdayjobs.com") & (tenant != "") & x["site"].isNotNull()
        return F.when(
            on_board,
            F.struct(
                F.concat(url["scheme"], F.lit("://"), url["netloc"]).alias("origin"),
                tenant.alias("tenant"),
                x["site"].alias("site"),
            ),
        )

    def with_site(url: Column) -> Column:
        parts = F.filter(F.split(bare_path(url), "/", -1), lambda p: p != "")
        return let(F.struct(url.alias("url"), let(parts, site).alias("site")), found)

    return let(split_url(strip(careers_url)), with_site)


def _first_part_on(url: Column, board_host: str) -> Column:
    def first(p: Column) -> Column:
        parts = F.filter(F.split(bare_path(p), "/", -1), lambda x: x != "")
        return F.when(F.lower(p["netloc"]).contains(board_host), F.get(parts, F.lit(0)))

    return let(split_url(url), first)


def smartrecruiters_slug(url: Column) -> Column:
    return _first_part_on(url, "smartrecruiters.com")


def gem_slug(url: Column) -> Column:
    return _first_part_on(url, "jobs.gem.com")


def gem_board_url(url: Column) -> Column:
    return F.coalesce(F.concat(F.lit("https://jobs.gem.com/"), gem_slug(url)), strip_right(url, "/"))


def workday_board_url(url: Column) -> Column:
    """No query or fragment, no trailing slash, no closing /login."""

    def board(p: Column) -> Column:
        trimmed = F.regexp_replace(strip_right(bare_path(p), "/"), r"(?i)/login$", "")
        return unsplit_url(p["scheme"], p["netloc"], F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("/")))

    return F.when(url.isNotNull(), let(split_url(strip(url)), board))


def icims_board_url(url: Column) -> Column:
    """The /jobs page of the host, or the given jobs page without its query."""

    def board(x: Column) -> Column:
        p, low = x["p"], F.lower(x["p"]["path"])
        jobs_page = F.concat(p["scheme"], F.lit("://"), p["netloc"], F.lit("/jobs"))
        return F.when(low.contains("login") | ~low.contains("/jobs"), jobs_page).otherwise(
            strip_right(F.substring_index(x["url"], "?", 1), "/")
        )

    return let(F.struct(split_url(strip(url)).alias("p"), url.alias("url")), board)


def without_slash(url: Column) -> Column:
    return strip_right(url, "/")
