"""Operator 10: URL filters with redirect equivalence.

A page's URL is judged by the longest rule that fits it.  A URL that no rule fits takes the decision of its aliases:
redirect and canonical-link edges make a graph of URLs, its connected components are found by distributed star steps,
and a component in which some URL is allowed by a rule is allowed (explicit allow has precedence), else one in which
some URL is blocked is blocked, else it is allowed, as nothing speaks against it.

Stated edges come from the pages: every ``<link rel="canonical" href=...>`` and ``<meta http-equiv="refresh"
content="..url=...">`` of the html, with targets resolved against the page's URL (``//host/x``, ``/x``, ``x``, ``?x``) and
``&amp;`` read as ``&``.  Supposed edges are the redirects that servers usually make from an address to its canonical form:
https, no ``www.`` or ``m.`` host prefix, no fragment, no parameters of ``dropped`` (an argument), no trailing slash; they
can be turned off.  Redirects known from elsewhere can be passed as a table (a, b).  Edges of URLs that are no pages count.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule and has no aliases; rows that
repeat a URL get the same verdict; null html has no links; an empty table gives an empty result; other columns are
ignored.
Long urls and pages are read whole, as values of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import table, written
from gradus.llm.components import components

#: Verdict, host and start of the path of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


#: Fixed value: parameters that do not tell pages apart (of tracking).
DROPPED = "utm_[^=]*|ref|fbclid|gclid"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    text, verdict = None, None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path) if text is None else text.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return text, verdict


def canonical_form(url: Column, dropped: str = DROPPED) -> Column:
    """The address to which servers send variants of an address."""
    parts = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    query = F.array_join(F.filter(parts, lambda p: ~p.rlike(rf"^({dropped})(=.*)?$")), "&")
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), "/$", "")
    whole = F.concat(F.lit("https://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host_of(url) != "", whole)


def resolved(target: Column, url: Column) -> Column:
    """The address that a link in a page means."""
    scheme, host = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1)
    path = path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    root = F.concat(scheme, F.lit("://"), host)
    target = F.regexp_replace(F.trim(target), "(?i)&amp;", "&")
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None))
        .when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(root, folder, target))
    )


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html", dropped: str | None = DROPPED) -> DataFrame:
    """(a, b): redirect and canonical-link edges between URLs; ``dropped`` is the pattern of parameters, None for no supposed edges."""
    url, html = F.col(url_col), F.col(html_col)
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0))
    refreshes = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0))
    targets = F.concat(
        F.transform(links, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.transform(refreshes, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)),
    )
    sound = pages.where(host_of(url) != "")
    stated = sound.select(url.alias("a"), F.explode(targets).alias("target")).select("a", resolved(F.col("target"), F.col("a")).alias("b"))
    whole = stated.where(host_of(F.col("b")) != "")
    if dropped is not None:
        supposed = sound.select(url.alias("a")).unionByName(whole.select(F.col("b").alias("a")))
        whole = whole.unionByName(supposed.select("a", canonical_form(F.col("a"), dropped).alias("b")))
    return whole.where("a <> b").distinct()


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, redirects: DataFrame | None = None, dropped: str | None = DROPPED) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict."""
    links = alias_links(pages, url_col, html_col, dropped)
    if redirects is not None:
        links = links.unionByName(redirects.select("a", "b"))
    placed = written(components(links, "a", "b"), "op10-components")
    rule, verdict = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    says = placed.select("component", verdict.alias("says")).where("says is not null").groupBy("component").agg(F.min("says").alias("says"))  # "allow" sorts before "block"
    says = written(says, "op10-says")  # the join has a plain shuffle on either side, so that a large component can be split
    aliases = placed.join(says, "component").select(F.col("node").alias("url"), "says")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).select("*", rule.alias("rule"), verdict.alias("own"))
    return judged.join(aliases, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "says", F.lit("allow")).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql(template: str, url: str) -> str:
    after = f"(case when strpos({url}, '://') > 0 then substr({url}, strpos({url}, '://') + 3) else '' end)"
    host = f"translate(regexp_extract({after}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"regexp_extract({after}, '^[^/?#]*([^?#]*)', 1)"
    query = f"array_to_string(list_filter(string_split(regexp_extract({url}, '[?]([^#]*)', 1), '&'), lambda p: not regexp_matches(p, '^({DROPPED})(=.*)?$')), '&')"
    return template.replace("HOST", host).replace("PATH", path).replace("QUERY", query)


_FITS = [(k, h + p, f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))") for k, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
_RULE = "case " + " ".join(f"when {fits} then '{text}'" for _, text, fits in _FITS) + " end"
_VERDICT = "case " + " ".join(f"when {fits} then '{kind}'" for kind, _, fits in _FITS) + " end"
_FORM = "case when HOST <> '' then 'https://' || regexp_replace(HOST, '^(www|m)[.]', '') || regexp_replace(PATH, '/$', '') || case when QUERY = '' then '' else '?' || QUERY end end"

ORACLE = f"""
with recursive p as (select page_id, url, coalesce({_sql("HOST", "url")}, '') as host, coalesce({_sql("PATH", "url")}, '') as path, coalesce(html, '') as html from pages),
tags as (select url as a, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>')), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) as t from p where host <> ''
  union all select url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*http-equiv\\s*=\\s*["'']?refresh\\b[^>]*>')), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) from p where host <> ''),
parts as (select a, regexp_replace(trim(t), '&amp;', '&', 'gi') as t, regexp_extract(a, '^(.*?)://', 1) as scheme, regexp_extract(a, '://([^/?#]*)', 1) as h, {_sql("PATH", "a")} as pa from tags),
stated as (select a, case when t = '' or starts_with(t, '#') then null when strpos(t, '://') > 0 then t when starts_with(t, '//') then scheme || ':' || t when starts_with(t, '/') then scheme || '://' || h || t
  when starts_with(t, '?') then scheme || '://' || h || pa || t when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
  else scheme || '://' || h || case when pa = '' then '/' else regexp_extract(pa, '^(.*/)', 1) end || t end as b from parts),
whole as (select a, b from stated where coalesce({_sql("HOST", "b")}, '') <> '' union all select url, {_sql(_FORM, "url")} from p where host <> ''),
links as (select a, b from whole union select b, {_sql(_FORM, "b")} from whole),
both_ways as (select a, b from links where a <> b union select b, a from links where a <> b),
reach as (select distinct a as node, a as other from both_ways union select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a),
others as (select node, {_sql("HOST", "other")} as host, {_sql("PATH", "other")} as path from reach),
says as (select node, min({_VERDICT}) as says from others group by node)
select page_id, host, path, {_RULE} as rule, coalesce({_VERDICT}, says, 'allow') as verdict from p left join says on p.url = says.node"""
