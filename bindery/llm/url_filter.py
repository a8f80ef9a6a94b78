"""URL filter that sees through redirects.

A rule names a host and the start of a path; it fits the host and its subdomains
and the longest fitting rule decides. A blocked page is often reachable by other
addresses. Addresses that redirect or point to each other (meta refresh,
canonical links, and the spellings that servers treat alike) form a graph; its
connected components are found distributedly, and a block passes on to every
alias in the component that no rule decides. An explicit allow takes precedence
twice: at its own address, and over a block elsewhere in the component.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

from bindery.llm.linkage import components
from bindery.llm.rows import ascii_lower, written

#: (verdict, host, path start)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK_TAG = (
    r"""(?is)<link\b[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'"""
    r"""|canonical(?:[\s/]|>))[^>]*>?"""
)
REFRESH_TAG = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_TO = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
TRACKING = r"(?i)([?&])(?:(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*(?:&|$))+"


def host_of(url: Column | str) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column | str) -> Column:
    """After the host up to ``? #``; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def one_spelling(url: Column) -> Column:
    """The address without what usually redirects: scheme, ``www.``, default port, fragment, tracking, last slash."""
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), r"(?s)#.*$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, TRACKING, "$1"), r"[?&]$", "")
    rest = F.regexp_replace(rest, r"^([^?]*)/(\?|$)", "$1$2")
    return F.concat(F.regexp_replace(host_of(url), r"^www\.|:(?:80|443)$", ""), rest)


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    ends_in_folder = F.element_at(parts, -1).isin(".", "..")
    parts = F.when(ends_in_folder, F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda at, part: F.when(part == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))))
        .when(part == ".", at)
        .otherwise(F.concat(at, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute(link: Column, base: Column) -> Column:
    """``link`` as found on the page ``base``, in any of its relative forms.

    Null for an empty link, a bare fragment and schemes without a host.
    """
    scheme = F.regexp_extract(base, r"(?s)^(.*?://)", 1)
    site = F.concat(scheme, F.regexp_extract(base, URL, 1))
    path, tail = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when((link == "") | link.startswith("#"), F.lit(None))
        .when(link.rlike(r"(?is)^[a-z][a-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), link))
        .when(link.rlike(r"(?is)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("?"), F.concat(site, path_of(base), link))
        .when(link.startswith("/"), F.concat(site, without_dots(path), tail))
        .otherwise(F.concat(site, without_dots(F.concat(folder, path)), tail))
    )


def rule_table(docs: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    schema = StructType().add("verdict", StringType()).add("rule_host", StringType()).add("rule_path", StringType())
    return docs.sparkSession.createDataFrame(list(rules), schema)


def decided(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``rule`` and ``ruled``, both null where no rule fits.

    Rules meet each distinct host once, through the host's suffixes; pages then
    look their host's rules up. Of equally long rules an allow wins.
    """
    hosts = urls.select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    rule = F.concat("rule_host", "rule_path")
    fitting = (
        hosts.filter("host <> ''")
        .select("host", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .groupBy("host")
        .agg(
            F.sort_array(
                F.collect_set(
                    F.struct(F.length(rule).alias("size"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"), "rule_path")
                ),
                asc=False,
            ).alias("rules")
        )
    )
    best = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    return (
        urls.join(fitting, "host", "left")
        .select(*urls.columns, best.alias("_best"))
        .select(
            *urls.columns,
            F.col("_best")["rule"].alias("rule"),
            F.when(F.col("_best")["allow"], "allow").when(F.col("_best").isNotNull(), "block").alias("ruled"),
        )
    )


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, by_alias) for each row of ``pages``.

    ``verdict`` is the rule's; else ``allow`` if a rule allows an alias; else
    ``block`` if one blocks an alias; else ``allow``. ``by_alias`` tells whether
    an alias decided. Addresses that are null or have no host have no aliases and
    are allowed. Null html has no links. Repeated rows are judged alike; extra
    columns are ignored.
    """
    table = rule_table(pages, rules)
    base = F.col("url")

    def found(tag: str, target: str) -> Column:
        tags = F.regexp_extract_all("html", F.lit(tag), F.lit(0))
        return F.transform(tags, lambda t: F.regexp_extract(t, target, 1))

    links = F.array_distinct(F.concat(found(LINK_TAG, HREF), found(REFRESH_TAG, REFRESH_TO)))
    node = F.when(F.col("host") != "", F.xxhash64(one_spelling(F.col("url"))))
    read = written(
        pages.select("page_id", "url", F.filter(F.transform(links, lambda x: absolute(x, base)), F.isnotnull).alias("links"))
        .withColumn("host", host_of("url"))
        .withColumn("path", path_of("url"))
        .withColumn("node", node),
        "pages",
    )
    targets = (
        read.filter("node is not null and size(links) > 0")
        .select(F.col("node").alias("source"), F.explode("links").alias("url"))
        .distinct()
        .withColumn("host", host_of("url"))
        .withColumn("path", path_of("url"))
        .withColumn("node", node)
        .filter("node is not null")
    )
    judged = written(decided(read.drop("links"), table), "judged")
    labels = written(
        components(targets.select(F.col("source").alias("a"), F.col("node").alias("b")).filter("a <> b")), "aliases"
    )
    known = judged.select("node", "ruled").union(decided(targets, table).select("node", "ruled"))
    known = known.filter("node is not null and ruled is not null").distinct()
    by_alias = (
        known.join(labels, "node", "left")
        .groupBy(F.coalesce("label", "node").alias("label"))
        .agg(F.when(F.max(F.col("ruled") == "allow"), "allow").otherwise("block").alias("alias_verdict"))
    )
    return (
        judged.join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .join(by_alias, "label", "left")
        .select(
            "page_id",
            "url",
            "host",
            "path",
            "rule",
            F.coalesce("ruled", "alias_verdict", F.lit("allow")).alias("verdict"),
            (F.col("ruled").isNull() & F.col("alias_verdict").isNotNull()).alias("by_alias"),
        )
    )


def digest(pages: DataFrame) -> DataFrame:
    return judge_pages(pages).select("page_id", "host", "path", "rule", "verdict", "by_alias")
