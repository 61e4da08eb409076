import numpy as np
from pyspark.sql import functions as F

from citeforge.llm import bytecnn as bc


def test_held_out_accuracy(docs):
    held = F.coalesce(bc.crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    network = bc.train(docs.where(~held))
    out = bc.identify(docs.where(held).select("doc_id", "text", "lang"), network).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.lang_score <= 1 for r in out)


def test_gradients():
    rng = np.random.default_rng(0)
    net = bc.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    windows, labels, weight = rng.integers(1, 256, (5, bc.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1]), np.ones(5)
    loss = lambda: -np.mean(np.log(net.probabilities(windows)[np.arange(5), labels]))
    got = net._gradients(windows, labels, weight)
    for name, at in [("out", (3, 1)), ("bias", (20,)), ("conv", (1, 2, 5)), ("conv", (3, 4, 30)), ("embed", (int(windows[0, 9]), 3))]:
        e, old = 1e-5, net.w[name][at]
        net.w[name][at] = old + e
        up = loss()
        net.w[name][at] = old - e
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / (2 * e) - got[name][at]) < 1e-3


def plain(net, text):
    """(language, score) of a text by loops over windows, filters and places."""
    data, stride = (text or "").encode(), bc.WINDOW - max(bc.WIDTHS) + 1
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total, n, at = np.zeros(len(net.languages)), 0, 0
    while n == 0 or at + max(bc.WIDTHS) - 1 < len(data):
        window = data[at : at + bc.WINDOW].ljust(bc.WINDOW, b"\0")
        pooled = []
        for i, width in enumerate(bc.WIDTHS):
            for f in range(i * bc.FILTERS, (i + 1) * bc.FILTERS):
                places = [sum(net.w["embed"][window[p + j]].astype(float) @ net.w["conv"][j, :, f] for j in range(width)) for p in range(stride)]
                pooled.append(max(0.0, max(places) + net.w["bias"][f]))
        logits = np.array(pooled) @ net.w["out"] + net.w["prior"]
        total += np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        n, at = n + 1, at + stride
    return net.languages[int(total.argmax())], float(total.max() / n)


def test_predictions_equal_plain_loops(spark):
    net = bc.Network(["a", "b", "c"])
    texts = ["x", "Ein Satz über Füße. " * 9, "é" * 63, "word " * 25 + "ab", "wörd " * 75, "12 34", "", None, "q" * (bc.WINDOW + 1)]
    got = bc.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()
    for r in got:
        want = plain(net, r.text)
        assert r.lang_pred == want[0] and abs(r.lang_score - want[1]) < 1e-5


def test_sample_is_stratified_and_repeatable(spark):
    rows = [(i, f"text {i}", "en") for i in range(2000)] + [(5000 + i, f"texte {i}", f"l{i % 700}") for i in range(1400)] + [(7, f"copy {i}", "en") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = bc.sample_ids(docs, 2000)
    assert sum(i >= 5000 for i in ids) == 1400 and 0 < sum(i < 5000 for i in ids) <= 600
    assert bc.shares([2500, 2, 900, 3], 1005) == [500, 2, 500, 3]
    assert bc.sample_ids(docs.repartition(7), 2000) == ids
    a, b = (bc.train(x, 300) for x in (docs, docs.repartition(5)))
    assert a.languages == b.languages and all((a.w[k] == b.w[k]).all() for k in a.w)
    assert len(bc.train(docs, 3000).languages) == 701


def test_odd_rows(odd, docs):
    network = bc.train(docs)
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in bc.identify(odd.withColumn("lang_score", F.lit("x")), network).collect()}
    assert out[2] == out[3] == out[4] == ("und", 0.0) and out[6][0] != "und" and out[5][0] in network.languages
    assert bc.identify(odd, network).count() == odd.count()


def test_no_labels(odd, empty):
    assert bc.train(empty) is None
    assert {r.lang_pred for r in bc.identify(odd, None).collect()} == {"und"}
    assert bc.identify(empty, None).collect() == []
