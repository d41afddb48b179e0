"""URL filters by redirect equivalence.

Rules decide on the urls they fit. Redirects (a refresh in the page's head) and canonical links make urls aliases of each other;
connected components over these edges carry a block to the aliases that no rule fits, unless one of them is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components

#: (verdict, host, path)
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for null and for what has no '://'; only A-Z of the host are lower-cased."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """What follows the path's '?', without the fragment; empty if there is none."""
    return F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1)


def rule_number(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The place of the longest rule that fits, else null. Of equally long ones the first wins. Rules are a parameter, a few of them."""
    out = None
    for i in sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i)):
        _, h, p = rules[i]
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return F.lit(None).cast("int") if out is None else out


def _named(number: Column, names: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), number) if names else F.lit(None).cast("string")


def attribute(tag: Column | str, name: str) -> Column:
    """An attribute's value, quoted or not, trimmed; empty if the tag has none."""
    found = lambda group: F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", group)
    return F.trim(F.concat(found(1), found(2), found(3)))


def plain_path(path: str) -> Column:
    """A path without dot segments; the empty one is the root."""
    fold = "aggregate(slice(split({0}, '/'), 2, 1000000), array(''), (a, s) -> CASE WHEN s = '.' THEN a WHEN s = '..' THEN slice(a, 1, greatest(size(a) - 1, 1)) ELSE concat(a, array(s)) END, a -> array_join(IF(element_at(split({0}, '/'), -1) IN ('.', '..'), concat(a, array('')), a), '/'))"
    return F.when(F.col(path) == "", "/").when(F.col(path).rlike(r"/\.\.?(/|$)"), F.expr(fold.format(path))).otherwise(F.col(path))


def resolved(rows: DataFrame, link: str, host: str, path: str, query: str) -> DataFrame:
    """rows with to_host, to_path, to_query: where the link leads from there. Links of no page, such as mail, and empty ones are left out."""
    ref = F.col(link)
    rows = rows.filter((ref != "") & (ref.rlike("(?i)^[a-z][a-z0-9+.-]*://") | ~ref.rlike("(?i)^[a-z][a-z0-9+.-]*:")))
    absolute = ref.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//")
    far_host, far_path = host_and_path(F.when(ref.startswith("//"), F.concat(F.lit("x:"), ref)).otherwise(ref))
    own = F.regexp_extract(ref, "^[^?#]*", 0)
    near = F.when(ref.rlike("^[?#]"), F.col(path)).when(ref.startswith("/"), own).when(F.col(path) == "", F.concat(F.lit("/"), own)).otherwise(F.concat(F.regexp_extract(path, "^(.*/)?", 0), own))
    rows = rows.withColumns({"to_host": F.when(absolute, far_host).otherwise(F.col(host)), "to_path": F.when(absolute, far_path).otherwise(near), "to_query": F.when(ref.startswith("#"), F.col(query)).otherwise(query_of(ref))})
    return rows.withColumn("to_path", plain_path("to_path"))


def edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """u, v: host, path and query of a page and of what it redirects to or names as canonical.

    Comments hold no tags; rel is a list of words; relative links are resolved against the page's base, if it names one, with dot
    segments taken out.
    """
    some = pages.filter(F.col(html).rlike(r"(?i)canonical|http-equiv")).withColumn("plain", F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", ""))
    tag = F.explode(F.regexp_extract_all("plain", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)))
    some = some.select("host", "path", "query", attribute(F.regexp_extract("plain", r"(?is)<base\b[^>]*>", 0), "href").alias("base"), tag.alias("tag"))
    canonical = F.col("tag").rlike(r"(?is)^<link") & F.array_contains(F.split(F.lower(attribute("tag", "rel")), r"\s+"), "canonical")
    refresh = F.col("tag").rlike(r"(?is)^<meta") & (F.lower(attribute("tag", "http-equiv")) == "refresh")
    link = F.when(canonical, attribute("tag", "href")).when(refresh, F.trim(F.regexp_extract(attribute("tag", "content"), r"""(?is)\burl\s*=\s*["']?([^"']+)""", 1)))
    unescaped = lambda c: F.regexp_replace(c, "(?i)&(?:amp|#0*38|#x0*26);", "&")
    some = some.select("host", "path", "query", unescaped(F.coalesce(F.nullif("base", F.lit("")), F.lit("#"))).alias("base"), unescaped(link).alias("link")).filter("link <> ''")
    based = resolved(some, "base", "host", "path", "query").withColumnsRenamed({"to_host": "base_host", "to_path": "base_path", "to_query": "base_query"})
    to = resolved(based, "link", "base_host", "base_path", "base_query")
    return to.select(F.struct("host", plain_path("path").alias("path"), "query").alias("u"), F.struct(F.col("to_host").alias("host"), F.col("to_path").alias("path"), F.col("to_query").alias("query")).alias("v")).distinct()


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_column: str = "page_id") -> DataFrame:
    """page id, host, path, rule, verdict of every page.

    Rules look at host and path; aliases are urls with their query, without the fragment, without dot segments in the path, of which
    none is the root. A page's own rule always holds. Others are blocked if their component has a blocked url and no allowed one; what
    is in no component, or in one that no rule reaches, gets the default. Null and malformed urls have an empty host and path and fit no
    rule; pages of one url are judged alike; an empty table gives no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(id_column), host.alias("host"), path.alias("path"), F.when(host == "", "").otherwise(query_of(F.col("url"))).alias("query"), F.col("html").cast("string").alias("html"))
    found = cut(edges(own.filter("host <> ''")), "aliases")
    names, verdicts = [h + p for _, h, p in rules], [v for v, _, _ in rules]
    numbered = own.select(id_column, "host", "path", "query", rule_number(F.col("host"), F.col("path"), rules).alias("number"))
    if found.isEmpty():
        judged = numbered.withColumn("alias", F.lit(None).cast("string"))
    else:
        group = components(found).select("node.host", "node.path", "node.query", "component").withColumn("ruled", _named(rule_number(F.col("host"), F.col("path"), rules), verdicts))
        allowed, blocked = F.max(F.col("ruled") == "allow"), F.max(F.col("ruled") == "block")
        held = group.groupBy("component").agg(F.when(allowed, "allow").when(blocked, "block").alias("alias"))
        aliases = cut(group.join(held, "component").filter("alias IS NOT NULL").select("host", "path", "query", "alias"), "held")
        aliases = aliases.withColumnRenamed("path", "node_path")
        judged = numbered.withColumn("node_path", plain_path("path")).join(aliases, ["host", "node_path", "query"], "left")
    return judged.select(id_column, "host", "path", _named(F.col("number"), names).alias("rule"), F.coalesce(_named(F.col("number"), verdicts), "alias", F.lit(default)).alias("verdict"))
