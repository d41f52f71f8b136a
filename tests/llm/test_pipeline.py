import corpus_pipeline as p

from tests.llm.helpers import components
from tests.llm.test_decontaminate import brute
from tests.llm.test_line_dedup import model as lines_model
from tidemark.llm import quality_model


def test_stages_against_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.columns, []
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 < len(p.STAGES):
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        held.append((docs, spark.read.parquet(f"{tmp_path}/{k}")))
        docs = held[-1][1]
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = map(text, held[0])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(after) <= set(before) and all(d in after for d, g in labels.items() if g == 1)
    assert not quality_model.rate_documents(held[0][0], quality_model.fit_on(held[0][0], quality_model.graded_ratings(spark.read.parquet(f"{sf}/labels.parquet")))).where("__tm_kept").join(held[0][1], "doc_id", "left_anti").count()

    before, after = map(text, held[1])
    import hashlib

    assert sorted(((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in after.items()), key=str) == sorted(((d, h) for d, _, _, h in lines_model(sorted(before.items()))), key=str)
    assert all(r.n_chars == len(r.text) for r in held[1][1].collect() if r.text != before[r.doc_id])

    before, after = map(text, held[2])
    assert set(after) == {d for d, (_, c) in components(sorted(before.items())).items() if c == d}

    before, after = map(text, held[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(before) - set(after) == {d for d, _ in brute(sorted(before.items()), items)}

    before, after = held[4]
    assert {r.doc_id for r in after.collect()} == set(text(before))
    assert sorted(map(tuple, p.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, after.select("doc_id", "piece", "length", "ids_crc32").collect()))
