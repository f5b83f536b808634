"""A task of line dedup keeps one Python worker, not one for each use of a column that Python made."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "a line of more than ten words that is there every time"


def test_lines_are_taken_out_by_one_call_a_row(spark):
    rows = [(1, f"{LINE}\nfirst", "en", "a", 9), (2, f"{LINE}\nsecond", "en", "a", 9), (3, LINE, "en", "b", 9), (4, None, "en", "b", 9)]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, f"{LINE}\nfirst", 9), (2, "second", 6), (4, None, 9)}
