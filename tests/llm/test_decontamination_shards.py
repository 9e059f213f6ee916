import random

from likeness.llm import decontamination


def test_shards_do_not_change_results(spark, monkeypatch):
    rng = random.Random(12)
    common = ["the", "of", "and", "to", "in", "was"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcde") for _ in range(3))
    items = [" ".join(word() for _ in range(rng.randint(8, 90))) for _ in range(60)]
    items += items[:5]  # equal items in several shards
    docs = []
    for i in range(200):  # texts that hold an item partly, near the threshold
        words = [w if rng.random() < 0.72 else "zzz" for w in rng.choice(items).split()]
        docs.append((i, " ".join([word() for _ in range(rng.randint(0, 200))] + words)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string")
    found = []
    for size in (50_000, 30):
        monkeypatch.setattr(decontamination, "ITEMS_PER_SHARD", size)
        rows = sorted(tuple(r) for r in decontamination.contaminated(table, benchmark, overlap=0.1).collect())
        dropped = decontamination.drop_contaminated(table, benchmark, overlap=0.1)
        found.append((rows, sorted(r.doc_id for r in dropped.collect())))
    assert found[0] == found[1] and len(found[0][0]) > 20
