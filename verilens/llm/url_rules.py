"""URL filtering: pattern rules indexed by their rarest literal token.

A rule is a regular expression over an address (a URL after ``://``, its host
in lower case). Each rule is indexed under one of its literal tokens: a run of
letters and digits that any fitting address holds as a whole run. Of several
the one on the fewest URLs is taken, counted over all of them. The tokens of a
URL fetch its candidate rules, and only those are run. A rule without such a
token is indexed under the empty token, which every URL fetches, so no rule is
ever missed.

Site rules (host, path) fit their host and its subdomains if the path starts
with theirs; the longest one that fits decides (of equally long ones that with
the longer host, then the greater text). Where none fits the pattern rules
decide: a URL is blocked if a pattern fits and no exception does. Patterns are
those of filter lists: ``||`` starts at a host label, ``|`` is the address's
start or end, ``^`` a separator or the end, ``*`` anything, ``@@`` an
exception; letters match in either case. URLs that nothing fits get the
default verdict.

Defined cases: a null URL, and one without ``://``, has an empty host and path
and the default verdict; an empty text, and a very long one, are URLs like
others; URLs that repeat get equal results on every row; rules with a null or
empty pattern, and site rules with a null host, path or verdict, fit nothing;
rules that repeat count once; an empty table of pages gives an empty table, an
empty one of rules default verdicts; new columns whose names a table has get a
longer name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verilens.llm.common import free_name

#: Rules whose texts take up to so many characters are broadcast; a larger table is joined by shuffle.
BROADCAST_CHARS = 30_000_000

#: (host, path, verdict) of the site rules that the registered query applies. Fixed values.
SITES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Patterns for addresses that hold no text worth keeping: advertising, gambling, pills, adult sites and link farms.
PATTERNS = [
    "||ads-track.", "||adserver.", "||doubleclick.net^", "/adframe/", "/banner-ads/",
    "||casino-win.", "||free-bets.", "/online-casino/", "||cheap-pills.", "||adult-x.", "||spam-farm.",
    "@@/about-ads/",
]

_RULE = "rule string, verdict string, kind string, regex string, tokens array<string>, size int, host_size int"


def _lower(c: Column) -> Column:
    """A to Z in lower case; all else as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _literal(c: Column) -> Column:
    """A regular expression that matches the text itself."""
    return F.regexp_replace(c, "([^A-Za-z0-9])", r"\\$1")


def address(url: Column) -> Column:
    """What follows the first ``://``, with the host in lower case; null without it."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.concat(_lower(host), F.substring(rest, F.length(host) + 1, F.length(rest)))


def host_of(address: Column) -> Column:
    return F.coalesce(F.regexp_extract(address, "^[^/?#]*", 0), F.lit(""))


def path_of(address: Column) -> Column:
    return F.coalesce(F.regexp_extract(address, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def site_rules(rules: DataFrame) -> DataFrame:
    """The rule table of site rules (host, path, verdict)."""
    r = rules.select(_lower(F.col("host")).alias("host"), "path", "verdict").filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").distinct()
    # An empty path fits every path of the host; the last token of a path may go on in the URL unless something parts it there.
    regex = F.concat(
        F.when(F.col("host") == "", F.lit("^[^/?#]*")).otherwise(F.concat(F.lit(r"^(?:[^/?#]*\.)?"), _literal(F.col("host")))),
        F.when(F.col("path") == "", F.lit(r"(?=[/?#]|\z)")).otherwise(_literal(F.col("path"))))
    whole = F.concat("host", F.lit("/"), F.regexp_replace(_lower(F.col("path")), "[a-z0-9]+$", ""))
    return r.select(
        F.concat("host", "path").alias("rule"), "verdict", F.lit("site").alias("kind"), regex.alias("regex"),
        F.regexp_extract_all(whole, F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"),
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"))


def pattern_rules(rules: DataFrame) -> DataFrame:
    """The rule table of filter-list patterns (pattern)."""
    r = rules.select(F.col("pattern").alias("rule")).filter("rule IS NOT NULL").distinct()
    text = _lower(F.regexp_replace("rule", "^@@", ""))
    body = F.regexp_replace(F.regexp_replace(text, r"^\|\|?", ""), r"\|$", "")
    inner = F.regexp_replace(F.regexp_replace(body, r"([^A-Za-z0-9*^])", r"\\$1"), r"\*+", ".*")
    regex = F.concat(
        F.when(text.startswith("||"), F.lit(r"(?is)^(?:[^/?#]*\.)?")).when(text.startswith("|"), F.lit("(?is)^")).otherwise(F.lit("(?is)")),
        F.replace(inner, F.lit("^"), F.lit(r"(?:[^A-Za-z0-9_.%\-]|\z)")), F.when(text.endswith("|"), F.lit(r"\z")).otherwise(F.lit("")))
    edged = F.concat(F.when(text.startswith("|"), F.lit("/")).otherwise(F.lit("*")), body, F.when(text.endswith("|"), F.lit("/")).otherwise(F.lit("*")))
    allow = F.col("rule").startswith("@@")
    return r.filter(F.length(body) > 0).select(
        "rule", F.when(allow, "allow").otherwise("block").alias("verdict"), F.when(allow, "exception").otherwise("pattern").alias("kind"),
        regex.alias("regex"), F.regexp_extract_all(edged, F.lit("(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), F.lit(0)).alias("tokens"),
        F.length(body).alias("size"), F.lit(0).alias("host_size"))


def _bounded(rules: DataFrame) -> bool:
    row = rules.agg(F.sum(F.length("regex") + F.length("rule") + 100).alias("n")).first()
    return (row.n or 0) <= BROADCAST_CHARS


def _fetches(urls: DataFrame) -> DataFrame:
    """(url, address, token): a row per token of a URL, the empty one included."""
    tokens = F.array_distinct(F.regexp_extract_all(_lower(F.col("address")), F.lit("[a-z0-9]+"), F.lit(0)))
    return urls.select("url", "address", F.explode(F.array_append(tokens, F.lit(""))).alias("token"))


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``rules`` with ``token``: of their tokens the one on the fewest rows of ``urls`` (url, address), the empty one if they have none."""
    own = rules.select("rule", "kind", "verdict", F.explode_outer("tokens").alias("token"))
    wanted = own.filter("token IS NOT NULL").select("token").distinct()
    seen = _fetches(urls).select("token").join(F.broadcast(wanted) if _bounded(rules) else wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    best = own.join(seen, "token", "left").groupBy("rule", "kind", "verdict").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), F.coalesce("token", F.lit("")))).alias("m"))
    return rules.join(best, ["rule", "kind", "verdict"]).select(*rules.columns, F.col("m.col2").alias("token"))


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (the site rule), pattern and verdict.

    ``rules`` is a union of ``site_rules`` and ``pattern_rules``. Only URLs,
    tokens and results are shuffled, by URL; a URL on many rows has one row on
    the other side of the last join, so AQE can split it.
    """
    urls = pages.select(F.col(url_col).cast("string").alias("url")).withColumn("address", address(F.col("url"))).filter("address IS NOT NULL")
    index = indexed(rules, urls).select("rule", "kind", "verdict", "regex", "token", "size", "host_size")
    met = _fetches(urls).join(F.broadcast(index) if _bounded(rules) else index, "token").filter(F.regexp_like("address", F.col("regex")))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("size", "host_size", "rule", "verdict"))).alias(kind)
    found = met.groupBy(F.col("url").alias("found_url")).agg(of("site"), of("exception"), of("pattern"))
    site, exception, pattern = F.col("f.site"), F.col("f.exception"), F.col("f.pattern")
    where = address(F.col(f"p.{url_col}").cast("string"))
    new = {
        "host": host_of(where), "path": path_of(where), "rule": site["rule"],
        "pattern": F.when(site.isNull(), F.coalesce(exception["rule"], pattern["rule"])),
        "verdict": F.coalesce(site["verdict"], exception["verdict"], pattern["verdict"], F.lit(default)),
    }
    joined = pages.alias("p").join(found.alias("f"), F.col(f"p.{url_col}").cast("string") == F.col("f.found_url"), "left")
    return joined.select(*[F.col(f"p.`{c}`") for c in pages.columns], *[c.alias(free_name(pages, n)) for n, c in new.items()])


def registered(spark: SparkSession) -> DataFrame:
    """The rules that the registered query applies."""
    sites = site_rules(spark.createDataFrame(SITES, "host string, path string, verdict string"))
    return sites.unionByName(pattern_rules(spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")))


#: DuckDB SQL from the rules' meaning: hosts and paths are compared as texts, without tokens or candidates.
SQL = r"""
    WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    b AS (SELECT page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
    site(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    c AS (SELECT *, (SELECT arg_max(row(h || p, verdict), length(h || p)) FROM site WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS hit,
                 translate(coalesce(rest, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM b),
    d AS (SELECT *, contains(low, '/about-ads/') AS fine,
                 list_has_any(string_split(host, '.')[:-2], ['ads-track', 'adserver', 'casino-win', 'free-bets', 'cheap-pills', 'adult-x', 'spam-farm'])
                 OR contains(low, '/adframe/') OR contains(low, '/banner-ads/') OR contains(low, '/online-casino/')
                 OR regexp_matches(low, '^([^/?#]*\.)?doubleclick\.net([^a-z0-9_.%-]|$)') AS bad FROM c)
    SELECT page_id, host, path, hit[1] AS rule, coalesce(hit[2], CASE WHEN bad AND NOT fine THEN 'block' ELSE 'allow' END) AS verdict FROM d"""
