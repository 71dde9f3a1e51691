"""Items without an id are searched like any others."""

from tessella.llm import decontam


def test_items_without_id_are_searched(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (None, "iota kappa"), (3, "alpha beta")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontam.find_contamination(docs, bench).collect()}
    alone = decontam.find_contamination(docs.where("doc_id = 1"), bench.where("item_id = 3")).first()
    assert (rows[1]["n_hit"], rows[1]["n_items"], rows[1]["items_sha256"]) == (11, 2, alone["items_sha256"])
    assert rows[2]["contaminated"] is False
    assert [r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()] == [2]
