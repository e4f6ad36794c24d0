"""Near dedup: a table of few slots changes the order of pairs, not the links."""

from wayfold.llm import near_dedup


def test_few_slots_give_the_same_components(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    own = lambda slots: {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, slots).collect()}
    assert own(1 << 12) == own(None)
