"""Physical plans of the training-data operators."""

from tessella.llm import queries


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_mixing_is_native(spark, sf_dir):
    text = plan(queries.op9_source_mixing(spark, sf_dir))
    assert not any(w in text for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_scans_without_shuffle(spark, sf_dir):
    for query in (queries.op1_language_id, queries.op2_benchmark_decontamination, queries.op4_licence_scan):
        text = plan(query(spark, sf_dir))
        assert "Exchange" not in text
        assert "text:string" in text and "n_chars" not in text


def test_levels_reuse_the_dealt_documents(spark, sf_dir):
    df = queries.op8_substring_dedup(spark, sf_dir)
    df.collect()
    assert plan(df).count("ReusedExchange") >= 3
