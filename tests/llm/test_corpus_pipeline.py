import corpus_pipeline as p
from tests.llm.test_near_dup import classes
from tests.llm.test_packing import ids_of
from tests.llm.test_secrets import brute as secrets_of
from tests.llm.util import SF001
from veilframe.llm import toxicity
from veilframe.sources.tables import table


def test_stages_follow_each_other(spark, tmp_path):
    """Each stage equals a plain rule on what its predecessor kept, and the columns stay."""
    docs = table(spark, SF001, "documents")
    columns = docs.columns
    for name, stage in p.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF001)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns and after
        if name == "toxicity":
            model = toxicity.fit(table(spark, SF001, "documents"), table(spark, SF001, "labels"))
            scored = toxicity.score_toxicity(table(spark, SF001, "documents"), model).collect()
            assert {r.doc_id for r in after} == {r.doc.c0 for r in scored if r.score < 0.5}
        if name == "near_dedup":
            groups = classes([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted(min(map(int, g)) for g in groups)
        if name == "decontamination":
            from tests.llm.test_decontaminate import brute

            bench = [tuple(r) for r in table(spark, SF001, "benchmark").select("item_id", "text").collect()]
            clean = {i for i, _, hit, _ in brute([(r.doc_id, r.text) for r in before], bench) if not hit}
            assert {r.doc_id for r in after} == clean
        if name == "secrets":
            old = {r.doc_id: r.text for r in before}
            for r in after:
                assert r.n_chars == len(r.text) and not secrets_of(r.text)
                assert secrets_of(old[r.doc_id]) or r.text == old[r.doc_id]
        if name == "packing":
            assert sum(r.length for r in after) == sum(map(len, ids_of([r.text for r in before])))
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
