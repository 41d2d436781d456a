"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a regular expression over host and path, and literal tokens that any URL it matches must contain. Each rule is
indexed under that of its tokens which fewest URLs contain; the tokens of a URL fetch candidate rules by an equality join,
and only those run their expression. Rules without whole tokens are indexed alike by the rarest run of four characters in
them; what has not even that (general expressions) is tried by all URLs, in blocks of rules. Two kinds of rules share the
index: prefix rules (a host with its subdomains, and the start of a path; the longest that fits decides) and pattern rules,
which decide where no prefix rule fits: allowed if an allowing pattern matches, else blocked if a blocking one does.
`parse_list` makes rules of the lines of public filter lists. All of it is built-in DataFrame functions.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm.text import NOT_WORD, lower_ascii, words
from chronofact.session import stored

#: Prefix rules of the production query: (host and path, verdict).
PREFIXES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

#: Pattern rules of the production query: (name, verdict, expression over host and path, literal tokens).
PATTERNS = [
    ("spam-farm", "block", r"^([^/]*\.)?spam-farm\.", ["spam", "farm"]),
    ("casino", "block", r"(^|[./_-])casino([./_-]|$)", ["casino"]),
    ("porn", "block", r"(^|[./_-])porn([./_-]|$)", ["porn"]),
    ("adult-content", "block", r"(^|[./_-])adult[._-]content([./_-]|$)", ["adult", "content"]),
    ("ad-server", "block", r"^([^/]*\.)?ad\.[^/]+/(banner|click)", ["ad"]),
    ("ads-server", "block", r"^([^/]*\.)?ads\.[^/]+/(banner|click)", ["ads"]),
    ("tracker-pixel", "block", r"/tracker/pixel", ["tracker"]),
    ("login-page", "block", r"/login([/.]|$)", ["login"]),
    ("cart-page", "block", r"/cart([/.]|$)", ["cart"]),
]

#: Names that the production list blocks in hosts and paths, in each of FORMS.
NAMES = [
    "casino", "poker", "roulette", "blackjack", "jackpot", "betting", "sportsbook", "slots", "lottery", "bingo",
    "porn", "xxx", "hentai", "escorts", "camgirls", "nsfw", "erotica", "hookup", "milf", "fetish",
    "cheap-pills", "viagra", "cialis", "xanax", "tramadol", "payday-loans", "forex-signals", "spam-farm", "link-farm", "free-followers",
    "warez", "torrents", "keygen", "cracks", "serials", "doubleclick", "adserver", "popunder", "clickbait", "malware",
]
FORMS = ["||{}.", "||{}^", "/{}^*", ".{}-", "-{}."]

#: Further lines of the production list, one of each form of the syntax at least.
LINES = [
    "! pages that are no prose", "/login^", "/cart^", "/checkout^", "/tracker/pixel", "/wp-admin^", "/cgi-bin/", "/feed.xml|", "||m.*/en/4", "||blog.*.html|",
    "0.0.0.0 ads.example.net", "thtion*/fr/", "ththre", "/\\/(de|fr)\\/[0-9]7$/", "||ads.$third-party", "example.com##.banner", "@@||blog.*/en/", "@@/help^", "@@ththle*/en/$document",
]

#: Options of a list's line that concern pages; lines with others are about parts of pages.
PAGE_OPTIONS = ["document", "doc", "all", "match-case"]

#: What ^ stands for: ASCII but letters, digits and _ - . %, or the end.
SEPARATOR = r"(?:[\x00-\x24\x26-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]|\z)"

#: Characters of the runs that rules without tokens are indexed by.
GRAM = 4
#: Rules that a URL tries at once where they have neither token nor run.
BLOCK = 1_000

#: Rows of the rule index that are broadcast at most; beyond, it is joined by a shuffle.
BROADCAST_RULES = 100_000


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, A-Z lower-cased."""
    return F.array_distinct(words(lower_ascii(text), NOT_WORD))


def prefix_rule(rule: str, verdict: str) -> tuple[str, str, str, str, list[str]]:
    """A prefix rule as (kind, name, verdict, expression, tokens). The last run of its path may go on in a URL, so it is no
    token of the rule."""
    name, slash, rest = rule.partition("/")
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    whole = (name + slash + re.sub(r"[0-9A-Za-z\x80-\U0010ffff]+$", "", rest)).translate(lower)
    found = [t for t in re.split(NOT_WORD, whole) if t]
    return "prefix", rule, verdict, rf"(?s)^([^/]*\.)?{_quoted(name.translate(lower))}/{_quoted(rest)}", found


def _quoted(literal: str) -> str:
    return re.sub(r"([^0-9A-Za-z\x80-\U0010ffff])", r"\\\1", literal)


def rule_table(spark: SparkSession, prefixes=PREFIXES, patterns=PATTERNS) -> DataFrame:
    """kind, name, verdict, expression, tokens: a row for each rule, as literals of the plan. Tables of millions of rules
    come from a file with these columns."""
    rules = [prefix_rule(*p) for p in prefixes] + [("pattern", *p) for p in patterns]
    text = lambda v: F.lit(v).cast("string")
    rows = [
        F.struct(
            text(kind).alias("kind"), text(name).alias("name"), text(verdict).alias("verdict"), text(expr).alias("expression"),
            F.array(*[text(t) for t in toks]).cast("array<string>").alias("tokens"),
        )
        for kind, name, verdict, expr, toks in rules
    ]
    if not rows:
        return spark.sql("SELECT '' kind, '' name, '' verdict, '' expression, array('') tokens WHERE false")
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def production_list(spark: SparkSession) -> DataFrame:
    """value: the lines of the production list."""
    lines = [form.format(name) for name in NAMES for form in FORMS] + LINES
    return spark.range(1).select(F.explode(F.split(F.lit("\n".join(lines)), "\n")).alias("value"))


def parse_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rules of the lines of a filter list: kind, name (the line), verdict, expression, tokens and literals (runs of characters) that
    any match contains, and skipped: null, or why a line is no rule for pages, which judge leaves out.

    The syntax is that of public lists: || (a host or its subdomains), | at the start or end, * (anything), ^ (a separator or the
    end), @@ (allows), /expression/, options after $, and lines of hosts files. Without match-case, case is ignored (ASCII). Rules
    apply to host and path. Skipped are blank lines, comments, rules on elements (cosmetic), rules with options about
    parts of pages or other sites (options), those that need a query or a scheme, and those that hold nothing but
    wildcards (everything). Lines that repeat are one rule; null lines are blank. An expression that Java can't compile is an error.
    """
    rows = lines.select(F.trim(F.coalesce(F.col(line).cast("string"), F.lit(""))).alias("name")).distinct()
    rule = F.regexp_replace("name", r"^(?:0\.0\.0\.0|127\.0\.0\.1)\s+([^\s#]+).*$", "||$1^")
    rows = rows.withColumn("rule", rule).withColumn("verdict", F.when(F.col("rule").startswith("@@"), "allow").otherwise("block"))
    rows = rows.withColumn("rule", F.regexp_replace("rule", "^@@", ""))
    rows = rows.withColumn("options", F.regexp_extract("rule", r"\$([~a-z0-9_-]+(?:=[^,]*)?(?:,[~a-z0-9_-]+(?:=[^,]*)?)*)$", 1))
    rows = rows.withColumn("rule", F.expr("left(rule, length(rule) - if(options = '', 0, length(options) + 1))"))
    rows = rows.withColumn("options", F.filter(F.split("options", ","), lambda x: x != ""))
    rows = rows.withColumn("free", F.col("rule").rlike("(?s)^/.+/$")).withColumn("core", F.regexp_replace("rule", r"^\|{1,2}|\|$", ""))
    start = F.when(F.col("rule").startswith("||"), r"^(?:[^/]*\.)?").when(F.col("rule").startswith("|"), "^").otherwise("")
    end = F.when(F.col("rule").rlike(r"[^|]\|$"), r"\z").otherwise("")
    body = F.regexp_replace("core", r"([^0-9A-Za-z\x80-\x{10FFFF}*^])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(SEPARATOR))
    case = F.when(F.array_contains("options", "match-case"), "(?s)").otherwise("(?si)")
    expression = F.concat(case, F.when(F.col("free"), F.expr("substring(rule, 2, length(rule) - 2)")).otherwise(F.concat(start, body, end)))
    edge = r"[\x00-\x29\x2B-\x2F\x3A-\x60\x7B-\x7F]"
    found = F.regexp_extract_all(lower_ascii(F.col("rule")), F.lit(rf"(?<={edge})([0-9a-z\x80-\x{{10FFFF}}]+)(?={edge})"), F.lit(1))
    none = F.array().cast("array<string>")
    skipped = (
        F.when(F.col("name").rlike(r"^($|!|#[^#@?$]|#$|\[)"), "comment").when(F.col("name").rlike(r"#[@?$]?#"), "cosmetic")
        .when(F.size(F.array_except("options", F.array(*[F.lit(o) for o in PAGE_OPTIONS]))) > 0, "options")
        .when(~F.col("free") & F.col("core").contains("?"), "query").when(~F.col("free") & F.col("core").contains("://"), "scheme")
        .when(F.regexp_replace("core", r"[*^|]", "") == "", "everything")
    )
    return rows.select(
        F.lit("pattern").alias("kind"), "name", "verdict", expression.alias("expression"), F.when(F.col("free"), none).otherwise(F.array_distinct(found)).alias("tokens"),
        F.when(F.col("free"), none).otherwise(F.split(lower_ascii(F.col("core")), r"[*^]")).alias("literals"), skipped.alias("skipped"),
    )


def grams(text: Column) -> Column:
    """Distinct runs of GRAM characters of a text, A-Z lower-cased; none for shorter ones."""
    low = lower_ascii(text)
    at = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(low, i, GRAM)))


def rule_index(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with the token it is indexed by: the rarest of its tokens in the column tokens of targets, the least of
    equally rare ones; null for a rule without tokens, which every URL has to try."""
    own = rules.select(F.explode("tokens").alias("token")).distinct()
    few = F.broadcast(own) if rules.count() <= BROADCAST_RULES else own
    counts = targets.select(F.explode("tokens").alias("token")).join(few, "token").groupBy("token").agg(F.count("*").alias("n"))
    counts = own.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    each = rules.select("kind", "name", "verdict", "expression", F.explode_outer("tokens").alias("token"))
    each = each.join(counts, "token", "left").groupBy("kind", "name", "verdict", "expression")
    return each.agg(F.min(F.struct("n", "token")).alias("best")).select("kind", "name", "verdict", "expression", F.col("best.token").alias("token"))


def candidates(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """_target, and kind, name, verdict and expression of each rule that the index finds for it: by the rule's rarest token, without
    tokens by its rarest run of characters, and without either all rules."""
    spark = targets.sparkSession
    shown = ["_target", "kind", "name", "verdict", "expression"]

    def tier(keys: Column, own: DataFrame) -> tuple[DataFrame, DataFrame]:
        keyed = targets.withColumn("tokens", keys)
        index = stored(spark, rule_index(keyed, own), "url-rules")
        hint = F.broadcast if index.count() <= BROADCAST_RULES else (lambda x: x)
        return keyed.select("_target", F.explode("tokens").alias("token")).join(hint(index), "token").select(*shown), index.where("token IS NULL").drop("token")

    found, rest = tier(tokens(F.col("_target")), rules)
    if rest.limit(1).count() and "literals" in rules.columns:
        keys = ["kind", "name", "verdict", "expression"]
        runs = rules.join(rest, keys, "left_semi").withColumn("tokens", F.array_distinct(F.flatten(F.transform("literals", grams))))
        more, rest = tier(grams(F.col("_target")), runs)
        found = found.unionByName(more)
    n = rest.count()
    if n:  # a stated rule set against all urls, in blocks of rules
        blocks = -(-n // BLOCK)
        block = F.pmod(F.xxhash64("kind", "name", "verdict", "expression"), F.lit(blocks))
        each = rest.groupBy(block.alias("block")).agg(F.collect_list(F.struct("kind", "name", "verdict", "expression")).alias("r"))
        every = targets.select("_target", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        hint = F.broadcast if n <= BROADCAST_RULES else (lambda x: x)
        found = found.unionByName(every.join(hint(each), "block").select("_target", F.explode("r").alias("r")).select("_target", "r.*"))
    return found


def judge(pages: DataFrame, rules: DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the longest prefix rule that fits, else null) and verdict. rules: a table as rule_table or
    parse_list make it, or both united; the production rules if None.

    A row for each row of pages. Null urls and those without :// have an empty host and path: no prefix rule fits, and a pattern decides
    only if it matches the empty text. Prefix rules of equal length: the least by name decides. Columns of pages with the new names are
    replaced. Each distinct host and path is judged once, however many pages share it. An empty table gives no rows; without rules
    every verdict is the default.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = rule_table(spark).unionByName(parse_list(production_list(spark)), allowMissingColumns=True)
    if "skipped" in rules.columns:
        rules = rules.where("skipped IS NULL")
    rules = stored(spark, rules, "url-rule-table")
    rows = pages.drop("host", "path", "rule", "verdict", "_target")
    rows = rows.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url))).withColumn("_target", F.concat("host", "path"))
    hits = candidates(rows.select("_target").distinct(), rules).where(F.expr("_target RLIKE expression"))
    longest = F.max(F.when(F.col("kind") == "prefix", F.struct(F.length("name").alias("n"), (-F.ascii("name")).alias("a"), "name", "verdict")))
    pattern = lambda verdict: F.max((F.col("kind") == "pattern") & (F.col("verdict") == verdict))
    judged = hits.groupBy("_target").agg(longest.alias("p"), pattern("allow").alias("allowed"), pattern("block").alias("blocked"))
    out = rows.join(judged, "_target", "left")
    verdict = F.coalesce("p.verdict", F.when(F.col("allowed"), F.lit("allow")), F.when(F.col("blocked"), F.lit("block")), F.lit(default))
    return out.withColumn("rule", F.col("p.name")).withColumn("verdict", verdict).drop("_target", "p", "allowed", "blocked")
