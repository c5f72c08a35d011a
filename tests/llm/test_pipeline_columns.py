"""Columns with names that the operators use pass through every stage."""

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
CLASH = {"score": "'mine'", "lang_pred": "'mine'", "_gone": "7L", "_lines": "'mine'", "_document": "1", "row": "'mine'", "gone": "array(1)", "id": "'mine'", "key": "2", "_row": "'mine'", "n_shingles": "3", "size": "'mine'", "kept": "4", "_key": "'mine'", "taken": "5"}


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    plain = docs
    docs = docs.selectExpr("*", *[f"{v} AS `{k}`" for k, v in CLASH.items()])
    wanted = {k: v for k, v in docs.select(*[f"`{c}`" for c in CLASH]).first().asDict().items()}
    for name, stage in P.STAGES[:4]:
        docs, plain = P.cut(stage(spark, docs, SF)), P.cut(stage(spark, plain, SF))
        assert docs.columns == [*plain.columns, *CLASH], name
        assert all(r.asDict() == wanted for r in docs.select(*[f"`{c}`" for c in CLASH]).collect()), name
        both = [sorted(map(str, d.select(*plain.columns).collect())) for d in (docs, plain)]
        assert both[0] == both[1] and both[0], name
    last = P.STAGES[4][1]
    assert sorted(map(str, last(spark, docs, SF).collect())) == sorted(map(str, last(spark, plain, SF).collect()))
