import zlib

import numpy as np
from pyspark.sql import functions as F

from windowstate.llm import quality_fm as fm
from windowstate.llm.queries import op2_quality

from .helpers import docs_frame

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    got = {r["doc_id"]: r for r in op2_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 10000
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    out = [(got[d]["score"], q, got[d]["predicted"]) for d, q in labels.items() if got[d]["held_out"]]
    good, bad = [s for s, q, _ in out if q == 1], [s for s, q, _ in out if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good[:500] for b in bad])
    assert auc > 0.97
    assert np.mean([p == q for _, q, p in out]) > 0.95


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    model = fm.Model(np.sort(rng.normal(size=(fm.N_STATS, fm.STAT_BINS - 1))), 0.1, rng.normal(size=fm.Model.width()),
                     rng.normal(0, 0.1, (fm.Model.width(), fm.RANK)))
    docs = [fm.features(t, n) for t, n in (("A few plain words here", 22), ("", None), (None, 3.0), ("x " * 5000, 9))]
    got = model.score(docs)
    for (bins, values, stats), s in zip(docs, got):
        at = np.concatenate((bins, model.stat_bins(stats)))
        x = np.concatenate((values, np.full(fm.N_STATS, fm.STAT_VALUE)))
        z = model.bias + model.w[at] @ x
        z += sum(model.v[at[i]] @ model.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9


def test_labels_lang_source_and_ids_are_no_inputs(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, "good words here " * 9 if i % 2 else "### !!! ### " * 9) for i in range(40)]
    model = fm.train(docs_frame(spark, rows), labels)
    a = docs_frame(spark, [(1, "good words here"), (2, "### ###")])
    b = docs_frame(spark, [(77, "good words here", "other"), (None, "### ###", None)], clashing=True)
    a, b = ([r["__score"] for r in sorted(fm.score_quality(x, model).collect(), key=lambda r: r["text"])] for x in (a, b))
    assert a == b and a[0] < a[1]


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    none = labels.where("false")
    docs = docs_frame(spark, [(1, "a"), (2, None), (3, ""), (None, "x " * 50000), (3, "")], clashing=True)
    assert [r["__score"] for r in fm.score_quality(docs, fm.train(docs, none)).collect()] == [0.5] * 5
    got = fm.score_quality(docs, fm.train(docs, labels))
    assert got.columns == [*docs.columns, "__score"]
    assert all(0 <= r["__score"] <= 1 for r in got.collect())
    assert fm.score_quality(docs.where("false"), fm.train(docs, labels)).count() == 0


def test_sample_is_bounded_by_rows(spark):
    ids = [i for i, held in [(r[0], r[1]) for r in spark.range(40).select("id", fm.held_out(F.col("id"))).collect()]
           if not held][:4]
    rows = [(ids[0], f"text {i % 50} of a hot id") for i in range(400)] + [(i, "alone") for i in ids[1:]] + [(ids[1], "alone")]
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    got = fm.labelled_sample(docs_frame(spark, rows).repartition(3), labels, 20).collect()
    assert sorted(r["doc_id"] for r in got) == [ids[0]] * 5 + ids[1:]
    assert len({r["text"] for r in got if r["doc_id"] == ids[0]}) == 5
