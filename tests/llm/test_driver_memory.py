from likeness import storage
from likeness.llm import near_dedup, quality_classifier
from likeness.operators import graph


def test_finished_steps_leave_the_driver(spark, edge_docs, labels, monkeypatch):
    calls = []
    monkeypatch.setattr(storage, "tidy", lambda s: calls.append("step"))
    monkeypatch.setattr(quality_classifier, "tidy", lambda s: calls.append("fit"))
    quality_classifier.train(edge_docs, labels)
    assert calls.count("fit") == 2
    for full, some in ((2.0, False), (0.0, True)):
        monkeypatch.setattr(storage, "FULL", full)
        calls.clear()
        near_dedup.near_duplicate_classes(edge_docs)
        assert bool(calls) == some
    calls.clear()
    graph.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"), "a", "b", small=0)
    assert len(calls) > 1  # after each round
