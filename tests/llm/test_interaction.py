import itertools
import re

import duckdb
import pytest

from citeforge.llm import interaction as I

SF = "/root/testdata/sf0.001"


def brute(docs, labels):
    """The audit by its definition, one document at a time."""
    texts = [(d, t or "", s or "") for d, t, s in docs]
    rows = []
    for d, t, s in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = d is not None and any(o is not None and o < d and u == t for o, u, _ in texts)
        own = [x for x in labels if x[0] is not None and x[0] == d]
        rows.append((s, fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                v = [0] * 6
                for s, fails, good, toxic in rows:
                    if s != part:
                        continue
                    gone = any(fails[x] for x in order[:k])
                    hit = not gone and fails[c]
                    only = fails[c] and sum(fails.values()) == 1
                    for i, x in enumerate((not gone and not fails[c], hit, gone and fails[c], only, hit and good, hit and toxic)):
                        v[i] += x
                out[part, "".join(order), k + 1] = v
    return {(p, o, k): (*v, sum(w[1] for (q, r, j), w in out.items() if q == p and r[j - 1] == o[k - 1])) for (p, o, k), v in out.items()}


def audit(docs, labels):
    rows = I.audit_orders(I.mask_cells(I.document_masks(docs, labels))).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_odd_rows_equal_brute_force(spark, odd):
    long = " ".join(f"w{i}" for i in range(300))
    more = spark.createDataFrame([(10, long, "src0"), (11, long, "src0"), (12, long + " 5%", "src0"), (12, "", "src2"), (13, "WORD " * 300, None), (None, None, "src1")], "doc_id long, text string, source string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    labels = [(10, 1, 0), (11, 1, 1), (11, 0, None), (12, None, 1), (None, 1, 1), (99, 1, 1), (1, 1, 0), (1, 1, 0)]
    got = audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == brute([(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()], labels)


def test_empty_tables(spark, empty, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(empty, labels) == {}
    assert {k[0] for k in audit(docs, labels)} == {r[0] for r in docs.select("source").distinct().collect()}


@pytest.mark.parametrize("letters", ["A", "ABC"])
def test_prefixes_of_fewer_filters(spark, letters):
    masks = spark.createDataFrame([(0,), (5,)], "mask int")
    rows = I.walk_prefixes(spark, masks, letters).collect()
    want = {"".join(p) for k in range(1, len(letters) + 1) for p in itertools.permutations(letters, k)}
    assert {r.prefix for r in rows} == want and len(rows) == 2 * len(want)
    assert all(r.kept == (r.mask == 0 or not {"A": 1, "B": 0, "C": 4}.keys() & {x for x in r.prefix if x != "B"}) for r in rows)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = I.op11_interaction(spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({I.ORACLE})").fetchall())
