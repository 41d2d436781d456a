"""Lists of profiles pasted as HTML: who is linked, under which name, and whether the page is such a list at all.

A page is cut into tags and texts by one pattern. What stands within a link or a button, and which text follows a profile's links before those of
the next, are windows over these pieces in order. All are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Comments, scripts and styles as a whole, other tags, and texts between them.
PIECE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)|<[a-z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\z)|<|[^<]+"
#: The target of a link, with quotes of either kind or none.
HREF = r"(?is)^<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
#: A profile: the only part of a path, on any host or none.
PROFILE = r"^(?:(?i:https?:)?//[^/?#]+)?/([A-Za-z0-9._]{1,30})/?(?:[?#].*)?$"
#: Paths that are no profiles.
RESERVED = ("about", "accounts", "direct", "explore", "help", "legal", "p", "privacy", "reel", "reels", "stories", "terms")
#: Texts that only separate.
SEPARATOR = "^[·•|,;:-]+$"
#: The least share of profiles among the links of a list; a whole page has many others.
LEAST_SHARE = 0.5


def unescaped(c: Column) -> Column:
    """Text with the five named references of HTML and that of a space without a break resolved."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def pieces(pages: DataFrame, html: str = "html") -> DataFrame:
    """page (a number of the row), page_id, pos, piece: tags and texts of each page in order, comments, scripts and styles left out."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(PIECE), F.lit(0))
    rows = pages.select("page_id", F.xxhash64("page_id", html).alias("page"), F.posexplode(found).alias("pos", "piece"))
    return rows.where(~F.col("piece").rlike(r"(?i)^<(!--|script\b|style\b)"))


def _scanned(rows: DataFrame) -> DataFrame:
    """pieces with href (of links), username (of profiles), text (outside of links and buttons)."""
    low = F.lower(F.substr("piece", F.lit(1), F.lit(12)))
    opens, closes = low.rlike(r"^<(a|button)[\s>/]"), low.rlike(r"^</(a|button)[\s>]")
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(Window.partitionBy("page_id", "page").orderBy("pos"))
    parts = [F.nullif(F.regexp_extract("piece", HREF, i), F.lit("")) for i in (1, 2, 3)]
    href = F.when(low.rlike(r"^<a\s") & F.col("piece").rlike(HREF), F.trim(unescaped(F.coalesce(*parts, F.lit("")))))
    name = F.regexp_extract(F.col("href"), PROFILE, 1)
    text = F.btrim(F.regexp_replace(unescaped(F.col("piece")), r"\s+", " "))
    rows = rows.withColumn("depth", depth).withColumn("href", href)
    rows = rows.withColumn("username", F.when((name != "") & ~F.lower(name).isin(*RESERVED), name))
    shown = ~F.col("piece").startswith("<") & (F.col("depth") <= 0) & (text != "") & ~text.rlike(SEPARATOR)
    return rows.withColumn("text", F.when(shown, text))


def profile_lists(pages: DataFrame, html: str = "html", least_share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """From pages (page_id, html): profiles page_id, pos (of the first link), username, display_name, ambiguous; and a report page_id, n_links,
    n_profiles (links to profiles), status (list; no links; whole page, where too few of the links are profiles). Only lists have profiles.

    A profile is there once for a page, at its first link. Its name is the first text after one of its links, outside of all links and buttons
    and before a link to another profile; null if that is the username itself. It is ambiguous if that text looks like a username, so that it
    may be a profile of its own. Case counts in usernames. Null and empty pages have no links; rows that repeat a page are one page."""
    rows = _scanned(pieces(pages.select("page_id", html).distinct(), html))
    page = Window.partitionBy("page_id", "page").orderBy("pos")
    links = rows.where("href IS NOT NULL OR text IS NOT NULL")
    # a run of links to one profile, and what follows them until the next profile, has one number
    before = F.last("username", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1))
    links = links.withColumn("starts", F.when(F.col("username").isNotNull() & ~F.col("username").eqNullSafe(before), 1).otherwise(0))
    links = links.withColumn("run", F.sum("starts").over(page))
    runs = links.where("run > 0").groupBy("page_id", "page", "run").agg(
        F.first("username", ignorenulls=True).alias("username_any"), F.min(F.when(F.col("username").isNotNull(), F.struct("pos", "username"))).alias("f"), F.min(F.when(F.col("text").isNotNull(), F.struct("pos", "text"))).alias("t")
    )
    named = runs.select("page_id", "page", F.col("f.username").alias("username"), F.col("f.pos").alias("pos"), F.col("t.text").alias("text"))
    first = named.groupBy("page_id", "page", "username").agg(F.min("pos").alias("pos"), F.min_by("text", F.when(F.col("text").isNotNull(), F.col("pos"))).alias("text"))
    share = rows.groupBy("page_id", "page").agg(F.count("href").alias("n_links"), F.count("username").alias("n_profiles"))
    every = pages.select("page_id", F.xxhash64("page_id", html).alias("page")).distinct()
    alike = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("page") == F.col("_page"))
    counted = every.join(share.withColumnsRenamed({"page_id": "_id", "page": "_page"}), alike, "left").drop("_id", "_page")
    n, k = F.coalesce("n_links", F.lit(0)), F.coalesce("n_profiles", F.lit(0))
    status = F.when(k == 0, "no links").when(k / n < least_share, "whole page").otherwise("list")
    report = counted.select("page_id", "page", n.alias("n_links"), k.alias("n_profiles"), status.alias("status"))
    lists = report.where("status = 'list'").select(F.col("page_id").alias("_id"), F.col("page").alias("_page"))
    text = F.when(F.col("text") != F.col("username"), F.col("text"))
    found = first.join(lists, alike, "left_semi").select("page_id", "pos", "username", text.alias("display_name"), F.coalesce(text.rlike(r"^[a-z0-9._]{1,30}$"), F.lit(False)).alias("ambiguous"))
    return found, report.drop("page")
