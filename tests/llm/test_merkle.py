import zlib
from hashlib import sha256

import duckdb
import pytest

from citeforge.llm import merkle as K

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, siblings of each node as (before, after) level by level)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(proofs):
            a = at[i] // 8 * 8
            p.append(("".join(nodes[a : at[i]]), "".join(nodes[at[i] + 1 : a + 8])))
        nodes = [h("".join(nodes[a : a + 8])) for a in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = tree([x[2] for x in groups[g]])
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (_, _, own, r), proof in zip(groups[g], trees[g][1], strict=True):
            text, node = r["text"], own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            for a, b in proof + top:
                node = h(a + node + b)
            out.append((r["doc_id"], own, trees[g][0], root, h("".join(a + b for a, b in proof + top)), node, node == root))
    return sorted(out, key=str)


def check(docs):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in K.manifest(docs).select(cols).collect()), key=str)
    assert got == brute([r.asDict() for r in docs.select(*FIELDS).collect()])
    return got


def test_odd_rows_equal_brute_force(odd):
    check(odd.withColumnRenamed("kept", "leaf"))


@pytest.mark.parametrize("sizes", [[1], [9], [513, 1], [4097, 8, 1, 1, 1, 1, 1, 1, 1, 64]])
def test_trees_of_any_size(spark, sizes):
    """One leaf, runs of one, several superblocks, more languages than a run holds."""
    rows = [(k * 10_000 + i, f"Text {i} {'É' * (i % 3)}", f"l{k}" if k else None, "src", i) for k, n in enumerate(sizes) for i in range(n)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert len(rows) < 9 or {r[-1] for r in got} == {True, False}


def test_equal_rows(spark):
    rows = [(7, "A b", "en", "s", 3)] * 40 + [(2**60 + 1, "A b", "en", "s", 3), (None, None, "en", None, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_empty_table(empty):
    assert K.manifest(empty).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = K.op13_merkle(spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({K.ORACLE})").fetchall())
