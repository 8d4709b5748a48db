"""URL filters by redirect equivalence, with DataFrame operations only.

Allow and block rules decide a url by host and path. Urls that redirect to each other, or name each
other as canonical, are aliases: connected components over those links carry a block to aliases that
no rule of their own decides. An explicit allow keeps its url out of that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.urls import resolve
from tidewire.runtime import table

from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are tested in place; more are joined on host suffixes.
INLINE_RULES = 256


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A url without scheme and fragment, host in lower case: what links are drawn between. Null without a host."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1)
    rest = F.when(rest == "", F.lit("/")).otherwise(rest)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


_HREF = r"href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)"


def _attribute(tag: Column) -> Column:
    """The href of a tag, without its quotes; empty where there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(tag, rf"(?is)\b{_HREF}", 0), r"(?is)^href\s*=\s*[\"']?|[\"']$", ""))


def links(pages: DataFrame) -> DataFrame:
    """Redirect and canonical links (a, b) between urls that pages (url, html) declare.

    Read are <link rel=canonical href=...> and <meta http-equiv=refresh content="0; url=...">. Targets are
    resolved as browsers do: against the page's <base href=...>, itself resolved against the url, or the url.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    based = pages.filter("url is not null and html is not null").withColumn("tw_base", _attribute(F.regexp_extract("html", rf"(?is)<base\b[^>]*\b{_HREF}[^>]*>", 0)))
    based = based.select(F.when(F.col("tw_base") == "", F.col("url")).otherwise(resolve(F.col("url"), F.col("tw_base"))).alias("tw_base"), "url", "html")
    tagged = based.select("url", "tw_base", F.explode(F.filter(tags, lambda t: t.rlike(r"(?is)rel\s*=\s*[\"']?\s*canonical\b|http-equiv\s*=\s*[\"']?\s*refresh\b"))).alias("tag"))
    target = F.when(F.col("tag").rlike(r"(?is)^<link"), _attribute(F.col("tag"))).otherwise(F.regexp_extract("tag", r"(?is)\burl\s*=\s*'?([^\"'>\s]+)", 1))
    aimed = tagged.select("url", "tw_base", F.replace(F.trim(target), F.lit("&amp;"), F.lit("&")).alias("target")).filter("target <> ''")
    return aimed.select(node_of(F.col("url")).alias("a"), node_of(resolve(F.col("tw_base"), F.col("target"))).alias("b")).filter("a is not null and b is not null and a <> b")


def decide(urls: DataFrame, rules: tuple[Rule, ...] | list[Rule]) -> DataFrame:
    """Add host, path, rule and rule_verdict to rows with a url: the longest rule that fits, or nulls.

    A rule fits its host and all subdomains if the path starts with its path. Of rules of equal length
    the one with the longer host wins, then an allow.
    """
    rows = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if len(rules) <= INLINE_RULES:
        best = F.lit(None).cast("struct<rule:string,verdict:string>")
        for r in sorted(set(rules), key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "allow")):  # the longest is asked first
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            best = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
        return rows.withColumn("tw_best", best).withColumn("rule", F.col("tw_best.rule")).withColumn("rule_verdict", F.col("tw_best.verdict")).drop("tw_best")
    spark = urls.sparkSession
    known = spark.createDataFrame([(r.host, r.path, r.verdict) for r in set(rules)], "r_host string, r_path string, r_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = rows.select("host", "path").distinct()
    fits = asked.withColumn("r_host", F.explode(suffixes)).join(known, "r_host").filter(F.col("path").startswith(F.col("r_path")))
    order = F.struct(F.length(F.concat("r_host", "r_path")), F.length("r_host"), F.col("r_verdict") == "allow", "r_host", "r_path")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(*rows.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] | list[Rule], more_links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of pages (page_id, url, html).

    more_links (from_url, to_url) are redirects seen in a crawl. A page that no rule decides is blocked
    if a rule blocks an alias of its url, else allowed. Null urls and urls without :// have an empty host
    and path, no rule and no alias. Repeated rows are judged row by row; an empty table gives no rows.
    """
    edges = links(pages.select("url", "html"))
    if more_links is not None:
        edges = edges.union(more_links.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    ruled = decide(pages.select("page_id", "url"), rules)
    groups = components(edges, "op10-components")
    names = groups.select(F.concat(F.lit("http://"), F.col("node")).alias("url"), "root")
    blocked = decide(names, rules).filter("rule_verdict = 'block'").select("root").distinct()
    bad = groups.join(blocked, "root", "left_semi").select(F.col("node").alias("tw_node"), F.lit(True).alias("tw_bad"))
    found = ruled.withColumn("tw_node", node_of(F.col("url"))).join(bad, "tw_node", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("tw_bad"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all pages by five rules and their aliases."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


def chained_pages(pages: DataFrame) -> DataFrame:
    """A pages table with links, made of page_id alone: five pages to a chain, each naming the next there is in another way.

    The last of every third chain names a blocked url, which makes all of that chain its aliases. No allow rule's path
    begins like that url's, whatever the chain's number.
    """
    chain = F.expr("page_id div 5")
    k = F.abs(F.col("page_id") % 5)
    number, after = chain.cast("string"), F.lead("page_id").over(Window.partitionBy(chain).orderBy("page_id")).cast("string")
    url = F.concat(F.lit("https://W"), number, F.lit(".example.org/a/b/"), F.col("page_id").cast("string"))
    tag = lambda *parts: F.concat(F.lit('<link rel="canonical" href="'), *parts, F.lit('">'))
    html = (
        F.when((F.col("page_id") % 5 == 4) & (chain % 3 == 0), tag(F.lit("https://www.example.com/en/c"), number))
        .when(k == 0, tag(F.col("after")))
        .when(k == 1, tag(F.lit("../../../a/./b/"), F.col("after"), F.lit("#top")))
        .when(k == 2, F.concat(F.lit("<head><base href='/a/'>"), tag(F.lit("b/"), F.col("after"))))
        .when(k == 3, F.concat(F.lit('<meta http-equiv="refresh" content="0; url=//w'), number, F.lit(".example.org/a/b/"), F.col("after"), F.lit('">')))
    )
    return pages.withColumn("after", after).select("page_id", url.alias("url"), html.alias("html"))


def chained_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 says of pages that are linked by redirects and canonical names of every form."""
    return judge(chained_pages(table(spark, sf_dir, "pages").select("page_id").distinct()), RULES).select("page_id", "host", "rule", "verdict")
