"""Cases that a narrower rule, cap or subset would miss."""

from __future__ import annotations

import corpus_pipeline
from tributary.llm import decontaminate, quality_classifier
from tributary.plans.catalogue import QUERIES, SHIFT

from .data import words


def test_pipeline_deletes_short_repeated_lines(spark):
    """A later copy of a short line goes though its neighbours differ each time; each first copy stays."""
    docs = [(k, f"{k} begins here\nAll rights reserved.\nand {k} ends\n\nok", "en", "s", 1) for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, df, "").collect()}
    want = {0: docs[0][1]} | {k: f"{k} begins here\nand {k} ends\n" for k in range(1, 5)}
    assert {k: t for k, (t, _) in got.items()} == want
    assert all(n == len(t) for k, (t, n) in got.items() if k)


def test_order_by_of_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = [(r.bal, r.c_custkey) for r in QUERIES["order_by_nulls_all"](spark, d).collect()]
    rows = [(None if r.c_custkey % 7 == 0 else r.c_acctbal, r.c_custkey) for r in spark.read.parquet(f"{d}/customer.parquet").collect()]
    assert len(rows) > 300 and got == sorted(rows, key=lambda x: (x[0] is not None, -(x[0] or 0), x[1]))


def test_decontamination_of_items_of_every_length(spark):
    """0.8 alike, by brute force, for whole items of 1 to 13 tokens, unchanged and with every pair of substitutions."""
    items = [(m, [f"i{m}x{k}" for k in range(m)]) for m in range(14)]
    docs = [[w if k not in (a, b) else "sub" for k, w in enumerate(t)] for _, t in items for a in range(len(t) or 1) for b in range(a, len(t) + 1)] + [t for _, t in items]
    bench = spark.createDataFrame([(m, " ".join(t)) for m, t in items], "item_id long, text string")
    df = spark.createDataFrame([(k, " ".join(["before", *d, "after"])) for k, d in enumerate(docs)], "doc_id long, text string")
    for x in decontaminate.contaminated(df, bench, short_items=True).collect():
        d = ["before", *docs[x.doc_id], "after"]
        want = [m for m, t in items if m and any(5 * sum(u != v for u, v in zip(d[p : p + m], t, strict=True)) <= m for p in range(len(d) - m + 1))]
        assert x.item_ids == want, (d, x.item_ids, want)


def test_training_reads_all_passages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda x, first, y: seen.append((len(x), list(first))))
    docs = spark.createDataFrame(
        [(k, " ".join(words(n, k))) for k, n in enumerate([20_000, 64, 65, 64, 64, 64])],
        "doc_id long, text string",
    )
    labels = docs.where(~quality_classifier.held_out(docs.doc_id)).selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    assert {0, 1} <= {r.doc_id for r in labels.collect()}
    quality_classifier.train(docs, labels)
    assert len(seen) == 1 and max(b - a for a, b in zip(seen[0][1], seen[0][1][1:], strict=False)) == 313


def test_changes_over_the_whole_table(spark, sf_dir):
    """Every customer is on both sides, with keys that match, that are new and that have no partner."""
    ids = {r.c_custkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()}
    moved = {k + SHIFT for k in ids}
    assert ids & moved and ids - moved and moved - ids
    assert {r.c_custkey for r in QUERIES["scd2_all"](spark, sf_dir).collect()} == ids | moved
    assert moved - ids <= {r.c_custkey for r in QUERIES["merge_all"](spark, sf_dir).collect()}
