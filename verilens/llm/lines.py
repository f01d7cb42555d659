"""Cross-site line removal by distinct-site spread.

One HyperLogLog sketch of sites per line hash, merged by the aggregation,
says on how many sites a line stands. Lines whose estimate is near the
threshold are counted exactly. A line on ``min_sites`` sites or more is
boilerplate: it stays at its first place (smallest doc_id, then position) and
goes everywhere else.

Defined cases: a null text stays null and has no lines; blank lines are never
removed; lines are compared after trimming spaces; a null site adds nothing
to a line's spread; a null doc_id comes after all others; rows that agree in
doc_id and text are one document, and each of them gets the same result; an
empty table gives an empty table; further columns pass through, and a new
column whose name the table has gets a longer one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.llm.common import free_name, stored
from verilens.sources.tables import bounded

#: Boilerplate lines up to which their table (some 60 bytes a row) is broadcast.
BROADCAST_ROWS = 1_000_000
#: log2 of the sketch's registers: a standard error of 1.6 %.
LG_K = 12
#: Estimates within this share (and one site) of the threshold are counted exactly: six standard errors.
BAND = 0.1


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if bounded(df, BROADCAST_ROWS) else df


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(doc, digest, site, at, h1, h2): a row per line that isn't blank; 96 bits of hash stand for the line."""
    rows = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(site_col).alias("site"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"),
    ).withColumn("line", F.trim("line")).filter("line <> ''")
    return rows.select("doc", "digest", "site", "at", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(h1, h2, sites, first): lines on at least ``min_sites`` sites with their first place; ``sites`` is exact near the threshold."""
    lines = _lines(docs, id_col, text_col, site_col)
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "digest", "at")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(place).alias("first"))
    spread = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("about"))
    low, high = min_sites - max(1.0, BAND * min_sites), min_sites + max(1.0, BAND * min_sites)
    spread = stored(spread.filter(F.col("about") >= low), "spread")
    near = spread.filter(F.col("about") <= high)
    exact = (
        lines.join(_small(near.select("h1", "h2")), ["h1", "h2"], "left_semi").filter(F.col("site").isNotNull())
        .groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    )
    return near.join(exact, ["h1", "h2"]).select("h1", "h2", "sites", "first").unionByName(
        spread.filter(F.col("about") > high).select("h1", "h2", F.col("about").alias("sites"), "first"))


def dedup_lines(docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines gone from the text, and ``n_lines`` and ``n_removed`` (long) added.

    Lines meet a broadcast table of the boilerplate where that is small; beyond ``BROADCAST_ROWS`` the join shuffles
    and AQE splits a line that is on very many pages.
    """
    found = stored(boilerplate(docs, min_sites, id_col, text_col, site_col), "boilerplate")
    lines = _lines(docs, id_col, text_col, site_col)
    here = F.struct(F.col("doc").isNull().alias("last"), "doc", "digest", "at")
    hits = lines.join(_small(found), ["h1", "h2"]).filter(~here.eqNullSafe(F.col("first")))
    hits = hits.groupBy(F.col("doc").alias("hit_doc"), F.col("digest").alias("hit_digest")).agg(F.collect_set("at").alias("hit_at"))
    d = docs.alias("d").join(
        hits.alias("h"), F.col(f"d.{id_col}").eqNullSafe(F.col("h.hit_doc")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("h.hit_digest")), "left")
    text, drop = F.col(f"d.{text_col}"), F.col("h.hit_at")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(drop, i)), "\n")
    rest = [F.when(drop.isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    return d.select(
        *rest, F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias(free_name(docs, "n_lines")),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(free_name(docs, "n_removed")))


def without_boilerplate(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **how) -> DataFrame:
    """``docs`` with boilerplate lines gone from the text, in its own columns; ``chars_col``, where there is one, counts anew in texts that changed."""
    removed = free_name(docs, "n_removed")
    made = dedup_lines(docs, text_col=text_col, **how)
    count = F.when(F.col(removed) > 0, F.char_length(text_col).cast("long")).otherwise(F.col(chars_col)) if chars_col in docs.columns else None
    return made.select(*[count.alias(c) if c == chars_col else F.col(f"`{c}`") for c in docs.columns])


def sql(min_sites: int = 5) -> str:
    """DuckDB SQL with exact counts for the same columns."""
    return f"""
        WITH parts AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
        wide AS (SELECT trim(line) AS key, min(row(doc_id, pos)) AS home FROM parts WHERE trim(line) <> ''
                 GROUP BY trim(line) HAVING count(DISTINCT source) >= {min_sites}),
        marked AS (SELECT p.doc_id, p.pos, p.line, w.key IS NOT NULL AND row(p.doc_id, p.pos) <> w.home AS gone
                   FROM parts p LEFT JOIN wide w ON trim(p.line) = w.key)
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
               count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed
        FROM marked GROUP BY doc_id"""
