"""URL filters: pattern rules indexed by their rarest literal token.

A rule holds for an address (`host/path`: that host or any subdomain, and a path
that starts with it) or for a whole url (words between other characters, * for
anything); either way it is a regular expression and the literal tokens (runs of
a-z and 0-9, as between other characters) that every url it fits must have.  A
pass over all urls counts the rules' tokens; each rule is filed under its rarest
one (without tokens: under the empty token, which every url has).  Judging a url
takes its tokens, fetches the rules filed under them, and runs the regular
expressions of those only.

The rules are a table (rule, action, on_address).  Up to INLINE rules, the index
is written into the plan and judging is row-local; more are a table joined by
token, through a broadcast for tokens of more than 1/1000 of all (url, token) rows
and by shuffle for others, and the fits of a url are combined again.  Both ways
give the same rows.  DataFrame expressions only.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no address rule, and is judged by the url rules (a null one is allowed).
The longest address rule wins, of equally long ones the last by name and then
by action; of url rules an allowing one wins, then the first by name.  Repeated
rows and ids are each judged; an empty table of urls or rules is fine; extra
columns are not read; a very long url is judged whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import lookup, materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INLINE = 2_000

# Rules on host and path, as (rule, action)
ADDRESS_RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
# Url patterns of this engine's own: words between other characters, * for anything
BLOCK_PATTERNS = (
    "adult-chat", "adult-dating", "adult-video", "adult-x", "ad-server", "ads-track", "affiliate-click", "bet-bonus", "betting-odds", "buy-followers", "buy-viagra", "captcha-bypass",
    "casino-bonus", "casino-win", "cheap-meds", "cheap-pills", "cheap-viagra", "click-farm", "clickbait", "crack-download", "crypto-doubler", "doorway-page", "essay-writer", "escort-girls",
    "fake-diploma", "fast-cash-loan", "forex-signals", "free-bets", "free-gift-card", "free-iphone", "free-robux", "free-spins", "full-movie*download", "hack-tool", "hot-singles", "keygen",
    "link-farm", "live-cams", "lottery-winner", "malware", "miracle-cure", "no-prescription*pharmacy", "online-casino", "online-pharmacy", "payday-loan", "phishing", "pills*discount", "poker-bonus", "porn",
    "replica-watches", "slot-machine", "spam-farm", "sports-betting", "torrent*crack", "tracker-pixel", "viagra*discount", "warez", "weight-loss*pills", "win-big", "xxx",
)
RULES = tuple((r, a, True) for r, a in ADDRESS_RULES) + tuple((p, "block", False) for p in BLOCK_PATTERNS)
KIND = "rule string, action string, on_address boolean"


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"\\$1")


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0))


def compiled(rules: DataFrame) -> DataFrame:
    """name, action, on_address, size, regex, tokens of each rule."""
    low = _lower(F.col("rule"))
    host, path = F.substring_index(low, "/", 1), F.regexp_extract("rule", "(?s)^[^/]*/?(.*)$", 1)
    whole = F.regexp_replace(path, "[A-Za-z0-9]+$", "")  # the last token may go on
    address = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), _quoted(host), F.lit("/"), _quoted(path))
    body = F.regexp_replace(_quoted(low), r"\\\*", ".*")
    url = F.concat(F.lit("(?s)(?:^|[^a-z0-9])"), body, F.lit("(?:[^a-z0-9]|$)"))
    ends = F.regexp_replace(low, r"[a-z0-9]*\*[a-z0-9]*", "*")  # what a * may make longer
    tokens = F.when(F.col("on_address"), F.concat(_tokens(host), _tokens(_lower(whole)))).otherwise(_tokens(ends))
    return rules.select(F.col("rule").alias("name"), "action", "on_address", F.length("rule").alias("size"), F.when(F.col("on_address"), address).otherwise(url).alias("regex"), F.array_distinct(tokens).alias("tokens"))


def parts_of(url: Column) -> tuple[Column, Column]:
    """(host, path) as written above."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    return _lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def tokens_of(low: Column) -> Column:
    """The distinct tokens of a url in lower case, the empty one among them."""
    return F.array_union(F.array(F.lit("")), F.split(low, "[^a-z0-9]+"))


def filed(rules: DataFrame, rows: DataFrame, few: bool) -> DataFrame:
    """token, rules array<struct>, urls (rows with the token): each rule under its token with the fewest urls, over all urls.

    few: the rules' tokens are few enough to be written into the plan, so others aren't counted.
    """
    known = rules.withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(""))))
    tokens = tokens_of(F.col("low"))
    if few:
        wanted = [x[0] for x in known.select(F.explode("tokens").alias("token")).distinct().collect()]
        tokens = F.array_intersect(tokens, F.lit(wanted).cast("array<string>"))
    counts = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("urls"))  # combined before the shuffle
    one = F.struct("on_address", "size", "name", "action", "regex")
    each = known.select(one.alias("rule"), F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = each.groupBy("rule").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("at"))
    return rarest.groupBy(F.col("at.token").alias("token")).agg(F.array_sort(F.collect_list("rule")).alias("rules"), F.max("at.urls").alias("urls"))


def _fits(rules: Column) -> Column:
    return F.filter(rules, lambda r: F.regexp_like(F.when(r["on_address"], F.concat("host", "path")).otherwise(F.col("low")), r["regex"]))


def _winners(fits: Column) -> tuple[Column, Column]:
    """(the longest address rule, the url rule) of those that fit, or null."""
    longest = F.array_max(F.transform(F.filter(fits, lambda r: r["on_address"]), lambda r: F.struct(r["size"].alias("size"), r["name"].alias("name"), r["action"].alias("action"))))
    own = F.array_min(F.transform(F.filter(fits, lambda r: ~r["on_address"]), lambda r: F.struct((r["action"] != "allow").alias("later"), r["name"].alias("name"), r["action"].alias("action"))))
    return longest, own


def judge_urls(pages: DataFrame, rules: DataFrame | tuple = RULES, inline: int = INLINE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest address rule that fits, or null), pattern (a url rule that fits, or null), verdict."""
    spark = pages.sparkSession
    rules = compiled((rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), KIND)).select("rule", "action", "on_address").distinct())
    host, path = parts_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), _lower(F.coalesce(F.col(url_col), F.lit(""))).alias("low"))
    few = rules.limit(inline + 1).count() <= inline
    index = filed(rules, rows, few)
    longest, own = _winners(F.col("fits"))
    if few:
        known = {r["token"]: r["rules"] for r in index.collect()}  # `inline` rules at most
        literal = {t: F.array(*(F.struct(*(F.lit(x[k]).alias(k) for k in ("on_address", "size", "name", "action", "regex"))) for x in rs)) for t, rs in sorted(known.items())}
        if literal:
            under = F.create_map(*(x for t, rs in literal.items() for x in (F.lit(t), rs)))
            mine = F.array_intersect(tokens_of(F.col("low")), F.lit(list(literal)))
            fits = _fits(F.flatten(F.transform(mine, lambda t: F.try_element_at(under, t))))
        else:
            fits = F.array().cast("array<struct<on_address:boolean,size:int,name:string,action:string,regex:string>>")
        judged = rows.withColumn("fits", fits).withColumns({"longest": longest, "own": own})
    else:
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
        index = materialise(index, "url-rules")
        tokens = rows.select("row", "host", "path", "low", F.explode(tokens_of(F.col("low"))).alias("token"))
        held = lookup(tokens, index, "token", "urls", tokens.count(), "inner").withColumn("fits", _fits(F.col("rules"))).filter(F.size("fits") > 0)
        best = held.withColumns({"longest": longest, "own": own}).groupBy("row").agg(F.max("longest").alias("longest"), F.min("own").alias("own"))
        judged = rows.join(best, "row", "left")
    return judged.select("page_id", "host", "path", F.col("longest.name").alias("rule"), F.col("own.name").alias("pattern"), F.coalesce("longest.action", "own.action", F.lit("allow")).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("pattern")


def oracle_sql() -> str:
    def case(rules) -> str:
        return " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'" for r in rules for h, _, p in [r.partition("/")])

    ordered = sorted((r for r, _ in ADDRESS_RULES), key=len, reverse=True)
    actions = " ".join(f"WHEN '{r}' THEN '{a}'" for r, a in ADDRESS_RULES)
    words = "|".join(re.escape(p).replace(r"\*", ".*") for p in BLOCK_PATTERNS)
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS low, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE {case(ordered)} END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN CASE rule {actions} END
            WHEN regexp_matches(low, '(^|[^a-z0-9])({words})([^a-z0-9]|$)', 's') THEN 'block' ELSE 'allow' END AS verdict
FROM d
"""


ORACLE_SQL = oracle_sql()
