"""Each stage against brute force on its own input."""

import corpus_pipeline as cp
from windowstate.llm.common import table
from windowstate.llm.oracles import LLM_ORACLES
from windowstate.llm.queries import LLM_QUERIES

from .helpers import deduped_lines, docs_frame, near_components, window_hits

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    inputs = []
    for _, stage in cp.STAGES:
        inputs.append(docs)
        docs = table(stage(spark, docs, SF), "test-stage")
        assert docs.columns[:len(columns)] == columns
    quality, lines, near, clean, mix = inputs[1], inputs[2], inputs[3], inputs[4], docs

    kept = {d for d, _ in rows_of(quality)}
    wrong = sum((labels[d] == 1) != (d in kept) for d in labels)
    assert wrong <= 0.03 * len(labels)

    before = rows_of(quality)
    want = {(d, t) for (d, _), (t, n) in zip(before, deduped_lines(before)) if n == 0 or t != "" or n < len(_.split("\n"))}
    assert set(rows_of(lines)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    comps = near_components(rows_of(lines))
    assert {d for d, _ in rows_of(near)} == {d for d, c in comps.items() if d == c}

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    here = rows_of(near)
    assert {d for d, _ in rows_of(clean)} == {d for (d, _), (_, hit, _i) in zip(here, window_hits(here, items)) if not hit}

    assert mix.columns == [*columns, "copies"]
    assert {r["doc_id"] for r in mix.collect()} <= {d for d, _ in rows_of(clean)}
    assert {r["copies"] for r in mix.collect()} <= {1, 2, 3}


def test_stages_on_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3),
                                 (2, "", "en", "s", 0), (3, "x\ny\nz", "en", "s", None), (4, "x\ny\nz", "en", "s", 5),
                                 (5, "w " * 30000, "en", "t", 60000)], schema)
    for rows in (odd, odd.where("false")):
        for _, stage in cp.STAGES:
            out = stage(spark, rows, SF)
            assert out.columns[:5] == rows.columns
            assert out.count() <= rows.count()


def test_near_dedup_keeps_one_row_a_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, "another text of this id"), (2, text + " end"), (3, "x y"), (3, "x y"), (4, None),
            (4, None), (None, "p q"), (None, "p q"), (None, "r s")]
    out = rows_of(cp.dedup_near(spark, docs_frame(spark, rows), SF))
    assert sorted(str(d) for d, _ in out) == ["1", "3", "4", "None", "None"]
    assert {t for d, t in out if d is None} == {"p q", "r s"} and (3, "x y") in out and (4, None) in out


def test_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in LLM_QUERIES}
    assert set(LLM_QUERIES) <= set(names) and "pipeline" in names
    assert set(LLM_ORACLES) <= set(entry.oracle_sql()) and "pipeline" not in entry.oracle_sql()
