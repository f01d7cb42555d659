"""Corpus hygiene: audits, overlays, latest-wins, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Last row per key: an aggregate with map-side combine, so a hot key sends one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def overlay(log: DataFrame, corrections: DataFrame, key: str, field: str, order: Sequence[str]) -> DataFrame:
    """Log rows with ``field`` replaced by the last correction of the key, if any."""
    last = latest(corrections.select(key, field, *order), [key], order).select(key, F.col(field).alias("_fix"))
    return log.join(last, key, "left").withColumn("corrected", F.col("_fix").isNotNull()).withColumn(
        field, F.coalesce("_fix", field)).drop("_fix")


def mean_or(value: Column, usual: float) -> Column:
    """Aggregate: mean of the positive values, ``usual`` without any."""
    return F.coalesce(F.avg(F.when(value > 0, value)), F.lit(usual))


def violations(rule: str, rows: DataFrame, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def duplicate_keys(rule: str, df: DataFrame, key: str) -> DataFrame:
    d = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return violations(rule, d, F.col(key), F.col("n"))


def orphans(rule: str, child: DataFrame, fk: str, parent: DataFrame, pk: str, id_col: str) -> DataFrame:
    lost = child.join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")
    return violations(rule, lost, F.col(id_col), F.col(fk))


def erase(df: DataFrame, key: str, subjects: DataFrame) -> DataFrame:
    """Rows of everyone not on the erasure list."""
    return df.join(subjects.select(key).distinct(), key, "left_anti")


def unique_match(requests: DataFrame, registry: DataFrame, prefix_len: int) -> DataFrame:
    """Resolve name prefixes of at least ``prefix_len`` characters; ``n`` <> 1 is an error row.

    An equi-join on the first characters narrows the comparison before ``startswith``.
    """
    r = registry.withColumn("_p", F.substring("name", 1, prefix_len))
    q = requests.withColumn("_p", F.substring("prefix", 1, prefix_len))
    j = q.join(r, (q["_p"] == r["_p"]) & r["name"].startswith(q["prefix"]), "left")
    return j.groupBy("request", "prefix").agg(F.count("name").alias("n"), F.min("id").alias("_id")).select(
        "request", "prefix", "n", F.when(F.col("n") == 1, F.col("_id")).alias("id"))


def prefix_lookup(keys: DataFrame, lexicon: DataFrame, min_len: int = 4, discount: float = 0.8) -> DataFrame:
    """Exact lexicon entry of each distinct key, else its longest known prefix at a discounted confidence."""
    exact = keys.join(lexicon, "key", "left")
    hit = exact.filter("label is not null").select("key", "label", "conf", F.length("key").alias("matched"))
    miss = exact.filter("label is null and length(key) > " + str(min_len)).select("key")
    cand = miss.select("key", F.explode(F.sequence(F.length("key") - 1, F.lit(min_len), F.lit(-1))).alias("n")).select(
        "key", F.expr("substring(key, 1, n)").alias("p"), "n")
    found = cand.join(lexicon.withColumnRenamed("key", "p"), "p").groupBy("key").agg(
        F.max_by(F.struct("label", "conf"), "n").alias("e"), F.max("n").alias("matched"))
    return hit.unionByName(found.select("key", "e.label", (F.col("e.conf") * discount).alias("conf"), "matched"))


def majority(votes: DataFrame, key: str, label: str, weight: Column | None = None) -> DataFrame:
    """Winning label and its vote share per key; ties go to the lower label. Counts are combined before any gathering. ``weight``: votes that a row stands for."""
    n = votes.groupBy(key, label).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    win = n.groupBy(key).agg(F.sum("n").alias("_t"), F.min(F.struct((-F.col("n")).alias("m"), F.col(label))).alias("w"))
    return win.select(key, F.col(f"w.{label}").alias("label"), (-F.col("w.m") / F.col("_t")).alias("conf"))


def digest_tree(lines: DataFrame, group: str, stratum: str, line: str, header: Column) -> DataFrame:
    """(group, n, digest): SHA-256 over the strata's digests below a header line.

    A stratum's digest is that of a tree: lines are dealt by four hex digits of
    their own digest, then by two, and each level hashes the sorted digests of
    the one below, so that no row ever holds a whole list.
    """
    def over(df: DataFrame, keys: list[str], item: str, n: Column) -> DataFrame:
        return df.groupBy(*keys).agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(item))), 256).alias("_d"), F.sum(n).alias("n"))

    leaves = over(lines.withColumn("_b", F.substring(F.md5(line), 1, 4)), [group, stratum, "_b"], line, F.lit(1))
    inner = over(leaves.withColumn("_b", F.substring("_b", 1, 2)), [group, stratum, "_b"], "_d", F.col("n"))
    roots = over(inner, [group, stratum], "_d", F.col("n"))
    named = F.sort_array(F.collect_list(F.struct(stratum, F.concat_ws("=", stratum, "_d").alias("text"))))
    out = roots.groupBy(group).agg(F.sum("n").alias("n"), F.transform(named, lambda x: x["text"]).alias("_l"))
    return out.select(group, "n", F.sha2(F.concat_ws("\n", header, F.concat_ws("\n", "_l")), 256).alias("digest"))
