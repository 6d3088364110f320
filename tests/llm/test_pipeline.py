import brute

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        if name == "quality_rules":
            assert all(not brute.quality(t)[-1] for t in after.values())
        if name == "ngram_jaccard":
            want = brute.jaccard_components(sorted(before.items()))
            assert set(after) == {k for k, (_, c) in want.items() if c == k}
        if name == "decontamination":
            items = [" ".join(x[0].lower().split()) for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
            assert not [k for k, t in after.items() if any(i in " ".join(t.lower().split()) for i in items)]
        if name == "bpe":
            assert docs.where("NOT round_trip").count() == 0 and docs.where("n_tokens <> size(ids)").count() == 0
