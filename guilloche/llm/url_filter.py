"""URL filter with redirect equivalence.

Rules name a host and a path prefix. Urls that redirect to each other, name the same canonical
link or differ only in form are aliases: connected components over those edges, in which a
plain form is a node beside the urls that have it. A blocked alias blocks the urls of its
component that no rule fits; an explicitly allowed alias in the component takes precedence
over that.
"""

from __future__ import annotations

import html as markup
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stage
from .graph import connected_components

#: (action, host and path prefix) of the registered query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_form(url: Column) -> Column:
    """The name of a url's plain aliases: no scheme, ``www.`` or ``m.``, fragment, tracking parameters, ``.html`` or last slash."""
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), r"&(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", ""), "^&", "")
    path = F.regexp_replace(path_of(url), r"(/|/index\.html?|\.html?)$", "")
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(F.length(kept) > 0, F.concat(F.lit("?"), kept)).otherwise("")))


_TAG = re.compile(r"""<(link|meta|base)\b((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.I)
_ATTR = re.compile(r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_REFRESH = re.compile(r"""^[\d.\s]*[;,]\s*(?:url\s*=)?\s*["']?([^"']+)""", re.I)


def links_of(url: str, page: str) -> list[str]:
    """Absolute targets of a page's canonical links and refreshes; relative ones join its base, or its own url."""
    base, found = url, []
    for tag, attrs in _TAG.findall(page):
        a = {}
        for k, v in _ATTR.findall(attrs):
            a.setdefault(k.lower(), markup.unescape(v[1:-1] if v[:1] in "\"'" else v).strip())
        kind = tag.lower()
        if kind == "base" and a.get("href") and base == url:
            base = _join(url, a["href"])
        elif kind == "link" and "canonical" in a.get("rel", "").lower().split():
            found.append(a.get("href", ""))
        elif kind == "meta" and a.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(a.get("content", ""))):
            found.append(m[1].strip())
    return [t for t in dict.fromkeys(_join(base, x) for x in found if x) if "://" in t]


def _join(base: str, target: str) -> str:
    try:
        return urljoin(base, target)
    except ValueError:  # no url at all
        return ""


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) from each page's url to its canonical links and refresh targets.

    Pages that name neither are left out by a search of their text. Null urls and pages have no edges.
    """
    some = pages.select(F.col("url").cast("string").alias("src"), F.col("html").cast("string").alias("html")).where("src is not null").where(F.col("html").rlike(r"(?i)<(link|meta)\b[^>]*(canonical|refresh)"))

    def read(batches):
        for batch in batches:
            pairs = [(u, t) for u, p in zip(*(batch.column(k).to_pylist() for k in (0, 1))) for t in links_of(u, p)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["src", "dst"])

    return some.mapInArrow(read, "src string, dst string")


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``action`` to distinct rows (url, host, path): of the rules that fit the longest, of equal ones an allowing one.

    A rule fits its host and all subdomains, if the path starts with the rule's; its host is
    compared in lower case. Rows of the rule table with null in them do not count.
    """
    r = rules.where("action in ('allow', 'block') and rule is not null").select("rule", "action", F.translate(F.regexp_extract("rule", "^([^/]*)", 1), _UPPER, _LOWER).alias("_host"), F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("_path")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.select("url", "path", F.explode(suffixes).alias("_host")).join(small(r), "_host").where(F.startswith("path", "_path"))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule")).alias("b"))
    return urls.join(best, "url", "left").select("url", "host", "path", "b.rule", F.when(F.col("b").isNotNull(), F.when(F.col("b.allow"), "allow").otherwise("block")).alias("action"))


def judge(pages: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, alias_group.

    ``edges`` (src, dst) are redirects and canonical links between urls. The verdict is the
    rule's; without a rule it is block if an alias is blocked by a rule and none is allowed by
    one, else allow. ``alias_group`` is the smallest url or form of the aliases. A null url, or one without ``://``, has an empty host and path, no
    aliases and, as no rule has an empty host, the verdict allow. Repeated pages are judged
    alike; edges with a null end, repeated ones and self-links change nothing. Without rules
    all is allowed.
    """
    named = pages.select("page_id", F.col("url").cast("string").alias("url"))
    links = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src is not null and dst is not null")
    links = stage(links.where(F.instr("src", "://") > 0).where(F.instr("dst", "://") > 0), "links")
    every = named.select("url").unionByName(links.select(F.col("src").alias("url"))).unionByName(links.select(F.col("dst").alias("url"))).where("url is not null").distinct()
    ruled = stage(apply_rules(every.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules).withColumn("form", canonical_form(F.col("url"))), "ruled-urls")
    forms = ruled.where("form is not null and form != url").select(F.col("url").alias("a"), F.col("form").alias("b"))
    joins = connected_components(forms.unionByName(links.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "a", "b")
    known = ruled.join(joins, F.col("url") == F.col("node"), "left")
    group = F.when(F.col("form").isNotNull(), F.coalesce("component", "url"))
    grouped = known.withColumn("alias_group", group).drop("node", "component")
    said = grouped.where("alias_group is not null and action is not null").groupBy("alias_group").agg(F.max(F.when(F.col("action") == "block", 1).otherwise(0)).alias("_block"), F.max(F.when(F.col("action") == "allow", 1).otherwise(0)).alias("_allow"))
    verdict = F.coalesce("action", F.when((F.col("_block") == 1) & (F.col("_allow") == 0), "block").otherwise("allow"))
    judged = grouped.join(said, "alias_group", "left").select("url", "host", "path", "rule", verdict.alias("verdict"), "alias_group")
    nothing = {"host": "", "path": "", "verdict": "allow"}
    return named.join(judged, "url", "left").select("page_id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) if (v := nothing.get(c)) is not None else F.col(c) for c in ("host", "path", "rule", "verdict", "alias_group")])


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(RULES, "action string, rule string")
    return judge(pages, page_edges(pages), rules)


_FORM = """CASE WHEN contains({u}, '://') THEN regexp_replace({host}, '^(www|m)\\.', '')
 || regexp_replace({path}, '(/|/index\\.html?|\\.html?)$', '')
 || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"""


def _form(u: str) -> str:
    host = f"translate(regexp_extract({u}, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    kept = f"regexp_replace(regexp_replace('&' || regexp_extract({u}, '^[^#?]*\\?([^#]*)', 1), '&(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '')"
    return _FORM.format(u=u, host=host, path=f"regexp_extract({u}, '://[^/?#]*([^?#]*)', 1)", kept=kept)


SQL = rf"""
WITH RECURSIVE rules(action, rule) AS (VALUES {', '.join(str(r) for r in RULES)}),
r AS (SELECT action, rule, regexp_extract(rule, '^([^/]*)', 1) AS rh, regexp_extract(rule, '^[^/]*(.*)$', 1) AS rp FROM rules),
raw AS (SELECT url AS src, unnest([regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical["'']?[^>]*>', 0), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
  regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh["'']?[^>]*>', 0), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS dst FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
e AS (SELECT src, CASE WHEN contains(dst, '://') THEN dst WHEN starts_with(dst, '//') THEN 'http:' || dst WHEN starts_with(dst, '/') THEN regexp_extract(src, '^.*?://[^/?#]*', 0) || dst END AS dst FROM raw WHERE dst <> ''),
u AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT src FROM e WHERE dst IS NOT NULL UNION SELECT dst FROM e WHERE dst IS NOT NULL),
hp AS (SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, {_form('url')} AS form FROM u),
fit AS (SELECT url, rule, action, row_number() OVER (PARTITION BY url ORDER BY length(rule) DESC, action, rule DESC) AS k FROM hp JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
ruled AS (SELECT hp.*, rule, action FROM hp LEFT JOIN fit ON fit.url = hp.url AND k = 1),
link AS (SELECT {_form('src')} AS a, {_form('dst')} AS b FROM e WHERE dst IS NOT NULL),
links AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
walk AS (SELECT DISTINCT form AS a, form AS b FROM ruled WHERE form IS NOT NULL UNION SELECT walk.a, links.b FROM walk JOIN links ON links.a = walk.b),
comp AS (SELECT walk.a AS form, min(least(walk.b, f.least_url)) AS alias_group FROM walk JOIN (SELECT form, min(url) AS least_url FROM ruled GROUP BY form) f ON f.form = walk.b GROUP BY walk.a),
g AS (SELECT ruled.*, alias_group FROM ruled LEFT JOIN comp USING (form)),
said AS (SELECT alias_group, bool_or(action = 'block') AS blocked, bool_or(action = 'allow') AS allowed FROM g WHERE action IS NOT NULL AND alias_group IS NOT NULL GROUP BY alias_group)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict, g.alias_group
FROM pages LEFT JOIN g USING (url) LEFT JOIN said ON said.alias_group = g.alias_group
"""
