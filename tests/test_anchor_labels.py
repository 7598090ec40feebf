from marlcore.plans import catalogue


def test_anchors_meet_no_pairs_by_features(spark, sf):
    out = catalogue.queries()["anchor_labels"](spark, sf)
    assert "sign#" not in out._jdf.queryExecution().optimizedPlan().toString()
