"""Merkle dataset manifest: leaf digests, trees of eight children a node, proofs and their folding.

Each language's leaves, by doc_id, are a tree; the subroots, by language, are one more tree of the
same kind. A tree is reduced by superblocks of 512 consecutive nodes, three levels at once, until
one node remains: every stage is a written table, 512 times smaller than the one below. Proofs go
the other way. The nodes outside a superblock that its members need are the same for all of them;
these rows are cogrouped with the superblock's nodes, and one function finishes the reduction inside
it, joins the proofs and folds the leaves. No task ever holds more than one superblock of a tree.

Rows: nulls are hashed as '-'; a null language is a group of its own, the first one; null doc_ids
come first and are not tampered with. Rows of one doc_id are leaves of their own, ordered by their
digests. Empty and very long texts are hashed whole, where they are read. An empty table has no
leaves and gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeforge.llm import shared

WIDTH = 8
LEVELS = 3
BLOCK = WIDTH**LEVELS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "grp string, at long, n long, digest string"
_OUTER = "grp string, at long, level int, before string, after string"
_RESULT = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


def climbed(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level from the given ones up."""
    out = [nodes]
    for _ in range(levels):
        low = out[-1]
        out.append([digest("".join(low[a : a + WIDTH])) for a in range(0, len(low), WIDTH)])
    return out


def beside(nodes: list[str]) -> list[tuple[str, str]]:
    """For each node the joined digests before and after it in its run."""
    out = []
    for a in range(0, len(nodes), WIDTH):
        run = nodes[a : a + WIDTH]
        out += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
    return out


def paths(nodes: list[str], n: int) -> Iterator[list[tuple[str, str]]]:
    """Each node's siblings, level by level, inside a superblock of a tree of ``n`` nodes at this stage."""
    levels = min(LEVELS, depth(n))
    sides = [beside(x) for x in climbed(nodes, levels)[:levels]]
    for i in range(len(nodes)):
        yield [sides[k][i // WIDTH**k] for k in range(levels)]


# Leaves and stages


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(grp, id, doc_id, leaf, bad): a document's digest, and that of its tampered text where it has one.

    ``grp`` orders languages bytewise with null first; doc_id is text, since numbers beside a null
    would become floating point in frames. Texts are hashed where they are read.
    """

    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    def hashed(text: Column) -> Column:
        return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)

    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    group = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit(""))
    bad = F.when(tampered, hashed(F.translate("text", _UPPER, _LOWER)))
    return docs.select(group.alias("grp"), F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), hashed(F.col("text")).alias("leaf"), bad.alias("bad"))


def numbered(rows: DataFrame, by: str, *then: str) -> DataFrame:
    """``rows`` without ``by``, with ``at``, the place in the group from 0 by ``by`` and ``then``, and ``n``, the group's size.

    Rows are range-partitioned and sorted once and numbered as they pass; counts of partitions and
    groups shift them. Rows that are equal in all columns of the order are split too.
    """
    order = ["grp", by, *then, "_tie"]
    kept = [c for c in rows.columns if c != by]
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    schema = rows.select(kept).schema.add("_part", "integer").add("_n", "long")

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, group, seen = TaskContext.get().partitionId(), None, 0
        for f in frames:
            if not len(f):
                continue
            n = f.groupby("grp", sort=False).cumcount()
            if f["grp"].iloc[0] == group:
                n += seen * (f["grp"] == group)
            group, seen = f["grp"].iloc[-1], int(n.iloc[-1]) + 1
            yield f.assign(_part=part, _n=n)

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(kept)
    spread = shared.materialize(ordered.mapInPandas(number, schema), "numbered")
    sizes = shared.materialize(spread.groupBy("grp", "_part").agg(F.count("*").alias("size")), "sizes")
    whole = Window.partitionBy("grp")  # a row for each partition
    earlier = F.sum("size").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("grp", "_part", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("size").over(whole).alias("n"))
    return spread.join(shared.small(before), ["grp", "_part"]).withColumn("at", F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def reduced(nodes: DataFrame) -> DataFrame:
    """The next stage: one node for each superblock."""

    def reduce_block(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        n = int(f["n"].iloc[0])
        top = climbed(list(f.sort_values("at")["digest"]), min(LEVELS, depth(n)))[-1]
        return pd.DataFrame({"grp": [key[0]], "at": [key[1]], "n": [-(-n // BLOCK)], "digest": top})

    return nodes.select("grp", "at", "n", "digest", F.expr(f"at div {BLOCK}").alias("block")).groupBy("grp", "block").applyInPandas(reduce_block, _NODE)


def stages(nodes: DataFrame) -> list[DataFrame]:
    """The given nodes and all stages above them, up to one node a group; each is written."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(shared.materialize(reduced(out[-1]), "stage"))
    return out


# Proofs


def descended(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """The outer rows of each node from those of its superblock."""

    def exchange(key: tuple, f: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame(columns=["grp", "at", "level", "before", "after"])
        f, o = f.sort_values("at"), o.sort_values("level")
        fixed = o["level"] < 0
        above = list(zip(o["before"][~fixed], o["after"][~fixed], strict=True))
        roots = [(-1, b, a) for b, a in zip(o["before"][fixed], o["after"][fixed], strict=True)]
        rows = []
        for at, own in zip(f["at"], paths(list(f["digest"]), int(f["n"].iloc[0])), strict=True):
            rows += [(key[0], at, *r) for r in roots]
            rows += [(key[0], at, k, b, a) for k, (b, a) in enumerate(own + above)]
        return pd.DataFrame(rows, columns=["grp", "at", "level", "before", "after"])

    inside = nodes.select("grp", "at", "n", "digest", F.expr(f"at div {BLOCK}").alias("block")).groupBy("grp", "block")
    return inside.cogroup(outer.groupBy("grp", "at")).applyInPandas(exchange, _OUTER)


def outer_rows(tree: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The outer rows of the superblocks of a tree's lowest stage, from those of its top nodes."""
    for nodes in reversed(tree[1:]):
        outer = shared.materialize(descended(nodes, outer), "outer")
    return outer


def folded(leaves: DataFrame, outer: DataFrame) -> DataFrame:
    """Proof and folded root of each leaf, by one exchange of leaves and outer nodes."""

    def exchange(key: tuple, f: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame(columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        f, o = f.sort_values("at"), o.sort_values("level")
        _, subroot, root = o[["level", "before", "after"]].iloc[0]
        above = list(zip(o["before"].iloc[1:], o["after"].iloc[1:], strict=True))
        rest = "".join(b + a for b, a in above)
        rows = []
        for doc_id, leaf, bad, own in zip(f["doc_id"], f["digest"], f["bad"], paths(list(f["digest"]), int(f["n"].iloc[0])), strict=True):
            node = bad or leaf
            for b, a in own + above:
                node = digest(b + node + a)
            rows.append((doc_id, leaf, subroot, root, digest("".join(b + a for b, a in own) + rest), node, node == root))
        return pd.DataFrame(rows, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    inside = leaves.withColumn("block", F.expr(f"at div {BLOCK}")).groupBy("grp", "block")
    return inside.cogroup(outer.groupBy("grp", "at")).applyInPandas(exchange, _RESULT)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every document.

    ``folded_root`` is recomputed from the tampered leaf where the document is tampered with.
    """
    leaves = numbered(shared.materialize(leaf_rows(docs), "digests"), "id", "leaf").withColumnRenamed("leaf", "digest")
    leaves = shared.materialize(leaves, "leaves")
    groups = stages(leaves)
    subroots = groups[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("grp").alias("by"), "digest")
    top = stages(shared.materialize(numbered(subroots, "by"), "subroots"))
    root = top[-1].select("digest").first()
    if root is None:
        return docs.sparkSession.createDataFrame([], _RESULT.replace("doc_id string", "doc_id long"))
    none = docs.sparkSession.createDataFrame([], _OUTER)
    named = top[0].select(F.col("at").alias("place"), "name", F.col("digest").alias("subroot"))
    above = descended(top[0], outer_rows(top, none)).join(named, F.col("at") == F.col("place"))
    ends = named.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("at"), F.lit(-1).alias("level"), F.col("subroot").alias("before"), F.lit(root[0]).alias("after"))
    rows = above.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("at"), "level", "before", "after").unionByName(ends)
    outer = outer_rows(groups, shared.materialize(rows, "outer"))
    return folded(leaves, outer).withColumn("doc_id", F.col("doc_id").cast("long"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, base: str, keys: str) -> str:
    """CTEs of all levels of the trees in ``base`` (keys, pos, n, h) and of each node's siblings."""
    same = f"a.{keys} IS NOT DISTINCT FROM b.{keys}"
    return f"""{name} AS (SELECT {keys}, 0 AS level, pos, n, h FROM {base} UNION ALL
  SELECT {keys}, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY {keys}, level, pos // 8, n),
{name}_s AS (SELECT a.{keys}, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM {name} a JOIN {name} b ON {same} AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.{keys}, a.level, a.pos)"""


# crc32, bit by bit: each decimal digit is eight steps.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(doc_id::VARCHAR)), lambda i: (CASE WHEN i % 8 = 0 THEN ascii((doc_id::VARCHAR)[i // 8 + 1]) ELSE 0 END)::BIGINT)),
  lambda s, c: xor(xor(s, c) >> 1, 3988292384::BIGINT * (xor(s, c) & 1))))"""

ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS bad FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM d),
{_levels("t", "b", "lang")},
r AS (SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM t WHERE n = 1),
{_levels("u", "r", "one")},
p AS (SELECT doc_id, b.lang, b.leaf, t_s.level, before, after FROM b JOIN t_s ON b.lang IS NOT DISTINCT FROM t_s.lang AND t_s.pos = b.pos // CAST(8 ** t_s.level AS BIGINT)
  UNION ALL SELECT doc_id, b.lang, b.leaf, 100 + u_s.level, before, after FROM b JOIN r ON b.lang IS NOT DISTINCT FROM r.lang JOIN u_s ON u_s.pos = r.pos // CAST(8 ** u_s.level AS BIGINT)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step FROM p),
f AS (SELECT doc_id, 1 AS step, coalesce(bad, leaf) AS h FROM d UNION ALL SELECT f.doc_id, f.step + 1, sha256(k.before || f.h || k.after) FROM f JOIN k ON k.doc_id = f.doc_id AND k.step = f.step),
e AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM f GROUP BY doc_id),
q AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM k GROUP BY doc_id)
SELECT b.doc_id, b.leaf, r.h AS subroot, u.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = u.h AS verified
FROM b JOIN r ON b.lang IS NOT DISTINCT FROM r.lang JOIN u ON u.n = 1 JOIN e ON e.doc_id = b.doc_id LEFT JOIN q ON q.doc_id = b.doc_id"""
