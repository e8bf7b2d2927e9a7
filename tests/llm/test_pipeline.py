"""The registered queries and the pipeline as a whole."""

import corpus_pipeline
from logharbor.llm import decontaminate, pii, simhash
from logharbor.llm.common import cut


def test_each_operator_has_one_query():
    from __spark_entry__ import queries

    names = queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, sf))
        assert 0 < out.count() <= docs.count(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if name == "near_duplicates":
            groups = simhash.near_duplicates(out)
            assert groups.filter("doc_id <> component_id").count() == 0
        if name == "decontamination":
            assert decontaminate.leaks(out, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        if name == "personal_data":
            assert pii.detect(out).filter("size(base) > 0").count() == 0
        docs = out
    assert set(columns) <= set(docs.columns)
    for r in docs.limit(20).collect():
        assert r.decoded == r.text


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf))
    assert docs.count() == 0


def test_the_stage_encoder_remembers_less_and_gives_the_same():
    import public_tokenizers

    from logharbor.llm import piecebpe

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    few, many = piecebpe.PieceBpe(model, 8), piecebpe.PieceBpe(model)
    for text in ["", "one two three four five six seven eight nine ten", "Größe 12,5 kg — naïve façade", "a  b\n\tc " * 9]:
        assert few.encode(text) == many.encode(text)
    assert len(few.words.new) + len(few.words.old) <= 8
    assert piecebpe.STAGE_WORDS < piecebpe.CACHE_WORDS
