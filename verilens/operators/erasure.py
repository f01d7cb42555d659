"""Erasure of subjects over declared foreign keys.

The rows to erase are the closure of the subjects' own rows under "child of an
erased row": semi joins along the links, repeated until no table gains a row,
so links may form cycles. Every table gets counts and a residue audit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.sources.held import hold


@dataclass(frozen=True)
class Link:
    """Rows of ``child`` belong to the row of ``parent`` whose ``key`` equals their ``column``."""

    child: str
    column: str
    parent: str
    key: str


def doomed(tables: Mapping[str, DataFrame], links: Sequence[Link], root: str, root_key: str, subjects: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """(table, key column) -> distinct keys of the rows to erase. ``subjects`` has one column, the keys of the root table.

    A key column is one that some link points to. A round follows every link
    once; the number of rounds is the longest chain of links.
    """
    found: dict[tuple[str, str], DataFrame] = {(root, root_key): tables[root].join(subjects.toDF(root_key), root_key, "left_semi").select(root_key).distinct().transform(hold)}
    size = {k: d.count() for k, d in found.items()}
    while True:
        before = dict(size)
        for child, key in {(x.parent, x.key) for x in links} - {(root, root_key)}:
            gained = None
            for link in links:
                if link.child == child and (link.parent, link.key) in found:
                    parents = found[link.parent, link.key].toDF(link.column)
                    more = tables[child].join(parents, link.column, "left_semi").select(key)
                    gained = more if gained is None else gained.unionByName(more)
            if gained is not None:
                found[child, key] = gained.filter(F.col(key).isNotNull()).distinct().transform(hold)
                size[child, key] = found[child, key].count()
        if size == before:
            return found


def erased(tables: Mapping[str, DataFrame], links: Sequence[Link], root: str, root_key: str, subjects: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the subjects, the root table included."""
    found = doomed(tables, links, root, root_key, subjects)
    out = {}
    for name, df in tables.items():
        kept = df
        if name == root:
            kept = kept.join(found[root, root_key], root_key, "left_anti")
        for link in links:
            if link.child == name and (link.parent, link.key) in found:
                kept = kept.join(found[link.parent, link.key].toDF(link.column), link.column, "left_anti")
        out[name] = kept.select(*df.columns)
    return out


def audit(tables: Mapping[str, DataFrame], after: Mapping[str, DataFrame], links: Sequence[Link], root: str, root_key: str, subjects: DataFrame) -> DataFrame:
    """(tbl, before_n, after_n, erased_n, residue_n): residue counts kept rows that still name an erased parent or subject."""
    gone = {(root, root_key): subjects.toDF(root_key)}
    for link in links:
        if (link.parent, link.key) not in gone:
            gone[link.parent, link.key] = tables[link.parent].select(link.key).join(after[link.parent].select(link.key), link.key, "left_anti").distinct()
    out = None
    for name, df in tables.items():
        left = [after[name].join(gone[x.parent, x.key].toDF(x.column), x.column, "left_semi").select(F.lit(1).alias("_r")) for x in links if x.child == name]
        if name == root:
            left.append(after[name].join(gone[root, root_key], root_key, "left_semi").select(F.lit(1).alias("_r")))
        rest = left[0]
        for more in left[1:]:
            rest = rest.unionByName(more)
        one = lambda d, c: d.agg(F.count("*").alias(c))
        # three one-row tables
        row = one(df, "before_n").join(F.broadcast(one(after[name], "after_n"))).join(F.broadcast(one(rest, "residue_n")))
        row = row.select(F.lit(name).alias("tbl"), "before_n", "after_n", (F.col("before_n") - F.col("after_n")).alias("erased_n"), "residue_n")
        out = row if out is None else out.unionByName(row)
    return out
