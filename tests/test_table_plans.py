from docloom.operators import classify
from docloom.plans import table_plans


def test_forest_has_the_operators_size(spark, monkeypatch):
    models, predict = [], classify.predict
    monkeypatch.setattr(classify, "predict", lambda model, rows: models.append(model) or predict(model, rows))
    got = table_plans.cls_4_forest(spark, "/root/testdata/sf0.001")
    forest = models[0].stages[-1]
    assert (forest.getNumTrees, forest.getMaxDepth(), forest.getSeed()) == (100, 10, 42)
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
