"""Links: site rules, resolving, incremental fetching."""

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Rows up to which a rule table is broadcast; beyond it the join shuffles by site.
SMALL = 10_000


def site(c: Column) -> Column:
    """Host of a url in lower case without user, port and a leading www. or m.; null without one."""
    host = F.lower(F.regexp_extract(c, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^(www\.|m\.)", ""), F.lit(""))


def site_name(c: Column) -> Column:
    """First label of the host, for sites without a name."""
    return F.regexp_extract(c, r"^([^.]+)", 1)


def with_site_rules(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Pages with site, site_name, link_patterns, exclude_patterns of the rule of their site.

    Sites without a rule are named by the first label of their host. One rule
    per site; of several the smallest name counts.
    """
    r = rules.groupBy(F.lower(F.col("site_host")).alias("site")).agg(F.min(F.struct("site_name", "link_patterns", "exclude_patterns")).alias("r"))
    x = pages.withColumn("site", site(F.col(url))).join(r, "site", "left")
    return x.select(*[c for c in x.columns if c != "r"], F.coalesce("r.site_name", site_name(F.col("site"))).alias("site_name"), F.col("r.link_patterns").alias("link_patterns"), F.col("r.exclude_patterns").alias("exclude_patterns"))


def is_article(url: Column, include: Column, exclude: Column) -> Column:
    """http(s) url that no exclude pattern finds and, if there are include patterns, one of them finds."""
    web = url.rlike("^https?://")
    out = F.coalesce(F.exists(exclude, lambda p: F.regexp_like(url, p)), F.lit(False))
    has = F.coalesce(F.size(include) > 0, F.lit(False))
    return F.coalesce(web & ~out & (~has | F.exists(include, lambda p: F.regexp_like(url, p))), F.lit(False))


def not_fetched(links: DataFrame, state: DataFrame, url: str = "url") -> DataFrame:
    """Links whose short hash isn't in the state (url_hash)."""
    return links.withColumn("url_hash", F.substring(F.md5(url), 1, 8)).join(state.select("url_hash"), "url_hash", "left_anti")


def add_fetched(state: DataFrame, done: DataFrame) -> DataFrame:
    """State (url_hash, url, title, fetch_time) with new rows; of a hash the last fetch counts."""
    rows = state.unionByName(done.select(F.substring(F.md5("url"), 1, 8).alias("url_hash"), "url", "title", "fetch_time"))
    return rows.groupBy("url_hash").agg(F.max(F.struct("fetch_time", "url", "title")).alias("s")).select("url_hash", "s.url", "s.title", "s.fetch_time")


def absolute(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Alias looked up, else https:// put before addresses without a scheme."""
    known = F.create_map(*[F.lit(x) for kv in (aliases or {}).items() for x in kv]) if aliases else None
    plain = F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit("https://"), c))
    return F.coalesce(F.element_at(known, c), plain) if known is not None else plain


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 resolution of relative links."""
    return pd.Series([urljoin(b, h) if b is not None and h is not None else None for b, h in zip(base, href)])


def url_parts(c: Column) -> dict[str, Column]:
    """domain, kind and id of a document address; quotes stripped, https:// added."""
    u = F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")
    u = F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    kinds = (("/drive/folder/", "folder"), ("/docx/", "docx"), ("/wiki/", "wiki"), ("/sheet/", "sheet"), ("/sheets/", "sheet"))
    kind, ident = F.lit(None).cast("string"), F.lit(None).cast("string")
    for part, name in reversed(kinds):
        got = F.regexp_extract(u, part + r"([^/?]+)", 1)
        kind, ident = F.when(got != "", name).otherwise(kind), F.when(got != "", got).otherwise(ident)
    drive = u.contains("/drive") & ident.isNull()
    return {"domain": F.regexp_extract(u, r"^(https?://[^/]+)", 1), "kind": F.when(drive, "drive").otherwise(F.coalesce(kind, F.lit("unknown"))), "id": F.when(drive, "root").otherwise(F.coalesce(ident, F.lit("")))}


def address_date(c: Column) -> Column:
    """(month, day part) of addresses like /202604/08100000.html; null without them."""
    return F.nullif(F.regexp_extract(c, r"/(\d{6})/\d{6,8}\.html", 1), F.lit(""))
