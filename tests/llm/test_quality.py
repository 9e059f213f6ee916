import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from likeness.llm import decontamination, license_scan
from likeness.llm.decontamination import Index, Searcher, contaminated, drop_contaminated, word_keys
from likeness.llm.quality_classifier import Scorer, fit, keep_quality, quality_classifier
from likeness.llm.quality_rules import FEATURES, fit_trees, quality_rules, statistics


def sample(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        chosen = [rng.choice(words) for _ in range(60)]
        junk = i % 5 == 0
        texts.append(" ".join(w.upper() + "!!" for w in chosen) if junk and i % 2 else " ".join(w + "$$$" for w in chosen) if junk else " ".join(chosen) + ".")
        labels.append(0 if junk else 1)
    return texts, np.array(labels)


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)]


def test_statistics_match_brute_force():
    rng = random.Random(1)
    texts = ["", " ", "a\na\na", "é# <b> \n x", *(" ".join(rng.choice("abé") for _ in range(rng.randint(0, 60))) for _ in range(80))]
    assert statistics(texts)[0].tolist() == [brute_statistics(t) for t in texts]
    assert statistics([""])[0].tolist() == [[0] * 5]


def test_trees_are_monotonic_and_accurate():
    texts, y = sample(400, 2)
    x = statistics(texts)[1]
    trees = fit_trees(x, y.astype(float), list(FEATURES.values()))
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.98
    for j, direction in enumerate(FEATURES.values()):
        if direction:
            grid = np.repeat(x[:50], 20, axis=0)
            grid[:, j] = np.tile(np.linspace(x[:, j].min(), x[:, j].max() + 1, 20), 50)
            steps = np.diff(trees.score(grid).reshape(50, 20), axis=1) * direction
            assert (steps >= -1e-12).all()
    assert fit_trees(x, np.ones(400), list(FEATURES.values())).score(x).min() > 0.99


def test_rules_on_edge_cases(edge_docs, no_docs, labels):
    rows = quality_rules(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert quality_rules(no_docs, labels).count() == 0
    assert quality_rules(edge_docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_rules_through_the_query_match_brute_force(spark, edge_docs, labels):
    """Counts, the base rule with its share of repeated words, and the trees' verdict beside it."""
    rng = random.Random(17)
    eight = " ".join(f"r{i}" for i in range(8))
    texts = [" ".join([eight] * k + [f"u{k}{j}" for j in range(n)]) for k in range(5) for n in (0, 3, 19, 20, 25, 37, 38, 60)]
    texts += ["\n".join(" ".join(rng.choice(["aa", "b#", "c"]) for _ in range(9)) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    known = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(500 + i, i % 2) for i in range(len(texts))], "doc_id long, quality long"))
    rows = quality_rules(docs, known).collect()
    want = []
    for d in docs.collect():
        counts = brute_statistics(d.text or "")
        want.append(str((d.doc_id, *counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0])))
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows) == sorted(want)
    assert {r.base_failed for r in rows if r.n_words >= 20} == {True, False}
    assert all(r.kept == (not r.base_failed and r.score >= 0.5) for r in rows)
    again = {(r.doc_id, r.n_words): r.score for r in quality_rules(docs.repartition(5), known).collect()}
    assert all(again[r.doc_id, r.n_words] == r.score for r in rows)


def test_classifier_learns_and_handles_edges(spark, edge_docs, no_docs, labels):
    texts, y = sample(500, 3)
    model = fit(texts[:400], y[:400], steps=300)
    assert ((Scorer(model).scores(texts[400:]) >= 0.3) == y[400:]).mean() > 0.97
    small = Scorer(model, most_words=3)
    assert np.allclose(small.scores(texts[400:]), Scorer(model).scores(texts[400:])) and np.allclose(small.scores(texts[400:]), Scorer(model).scores(texts[400:]))
    rows = quality_classifier(edge_docs, labels, model=model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_classifier(no_docs, labels).count() == 0
    kept = keep_quality(edge_docs, labels, model=model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert keep_quality(edge_docs, labels.limit(0)).count() == len(rows)


def test_query_trains_outside_the_fold_on_whole_texts(spark):
    """Held-out accuracy through the operator; repeated ids and very long texts in the sample."""
    texts, y = sample(600, 11)
    texts = [t + " tail" * 2000 if i % 50 == 1 else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*enumerate(texts), (1, "another text of an id that is there"), (2, None)], "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(i, int(q)) for i, q in enumerate(y.tolist())], "doc_id long, quality int")
    got = [r for r in quality_classifier(docs, known).collect() if r.doc_id > 2]
    fold = [r for r in got if r.held_out]
    assert {r.doc_id for r in fold} == {i for i in range(3, 600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == y[r.doc_id] for r in fold) / len(fold) > 0.97
    again = {r.doc_id: r.score for r in quality_classifier(docs.repartition(2), known).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def brute_blocks(words):
    """Label and containment of every template that a window of the words matches."""
    out = {}
    for label, template in license_scan.TEMPLATES:
        t = set(template.split())
        span = math.ceil(len(template.split()) / 0.8 - 1e-9)
        share = max((len(t & set(words[i : i + span])) / len(t) for i in range(len(words))), default=0.0)
        if share >= 0.8 - 1e-9:
            out[label] = max(share, out.get(label, 0.0))
    return out


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    found = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    blocks = brute_blocks(words)
    labels = {x for _, x in found} | set(blocks)
    places = [i for i, _ in found]
    return (len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found})), ",".join(sorted(labels)), 1.0 if found else max(blocks.values(), default=0.0))


def test_licenses_match_brute_force(spark, edge_docs, no_docs):
    rng = random.Random(8)
    extra = [(490, "the M\u0130T license, the Apac\u212ae license, MIT License and Licensed under CC BY-NC 4.0."), (491, "licensed under the mit license " * 700)]
    for i in range(80):
        label, template = rng.choice(license_scan.TEMPLATES)
        words = [w for w in template.split() if rng.random() > 0.15]
        for _ in range(rng.randint(0, 4)):
            words.insert(rng.randint(0, len(words)), rng.choice(["extra", "the", "of", "license"]))
        if i % 3 == 0:
            rng.shuffle(words)
        extra.append((500 + i, "start of it\n" + "".join(w.title() + rng.choice([" ", " ", "\n * "]) for w in words) + "\nend"))
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted(str(tuple(r)) for r in license_scan.license_scan(docs).collect())
    assert got == sorted(str((d.doc_id, *brute_license(d.text or ""))) for d in docs.collect())
    assert license_scan.license_scan(no_docs).count() == 0
    assert "Python" not in license_scan.license_scan(docs)._jdf.queryExecution().executedPlan().toString()


def items_and_docs():
    rng = random.Random(4)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefg") for _ in range(5))
    items = [" ".join(word() for _ in range(rng.randint(12, 60))) for _ in range(80)]
    docs = [" ".join(word() for _ in range(rng.randint(0, 500))) for _ in range(60)]
    want = set()
    for d in range(0, 60, 3):
        i = rng.randrange(80)
        words = docs[d].split()
        at = rng.randint(0, len(words))
        docs[d] = " ".join([*words[:at], items[i].title(), *words[at:]])
        want.add((d, i))
    return items, docs, want


def brute_scores(index, items, texts, least):
    """Best score of every text and item over all passages, without bounds."""
    hashed = [dict(zip(*(x.tolist() for x in index.impacts(i)), strict=True)) for i in range(len(items))]
    key, out, stride = {}, {}, index.passage // 2
    for d, text in enumerate(texts):
        words = re.findall(r"[a-z]+", text.lower())
        for w in words:
            key.setdefault(w, int(word_keys([w])[0][0]))
        for k in range(max(1, -(-len(words) // stride) - 1)):
            window = {key[w] for w in words[k * stride : k * stride + index.passage]}
            for i in range(len(items)):
                score = sum(v for h, v in hashed[i].items() if h in window)
                if score >= least:
                    out[d, i] = max(out.get((d, i), 0), round(score, 9))
    return out


@pytest.mark.parametrize("skipped", [0.0, 0.75])
def test_search_is_exact(monkeypatch, skipped):
    monkeypatch.setattr(decontamination, "SKIPPED", skipped)
    items, docs, want = items_and_docs()
    index = Index.of(list(range(80)), items, 0.6)
    found = {(d, i) for d, i, *_ in Searcher(index, 0.6, 0.5).search(docs)}
    assert found == want
    assert Searcher(index, 0.6, 0.5).search(["", "nothing of it", items[0].split()[0]]) == []
    for threshold in (0.3, 0.45, 0.6):
        # every passage against every item: neither more nor less is found
        got = {(d, i): round(s, 9) for d, i, _, s, *_ in Searcher(Index.of(list(range(80)), items, threshold), threshold, 0.0).search(docs[:30])}
        brute = brute_scores(index, items, docs[:30], threshold)
        assert len(brute) >= 10 and got.keys() == brute.keys() and all(abs(got[k] - brute[k]) < 1e-8 for k in got)


def test_pivots_skip_but_miss_nothing():
    rng = random.Random(2)
    scored = every = 0
    for _ in range(300):
        held = [[i for i in range(16) if rng.random() < 0.3] for _ in range(8)]
        weights = [{i: rng.random() for i in items} for items in held]
        cursors = [(items, max(w.values())) for items, w in zip(held, weights) if items]
        total = {i: sum(w.get(i, 0) for w in weights) for i in range(16)}
        got = list(decontamination.pivots(cursors, 0.1, 2.0))
        assert got == sorted(set(got)) and {i for i, s in total.items() if s + 0.1 >= 2.0} <= set(got)
        scored, every = scored + len(got), every + 16
    assert scored < 0.9 * every


def test_decontamination_edges(spark, edge_docs, no_docs):
    items, docs, want = items_and_docs()
    benchmark = spark.createDataFrame([*enumerate(items), (98, None), (99, ""), (None, "x")], "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.item_id) for r in contaminated(table, benchmark).collect()} == want
    assert sorted(r.doc_id for r in drop_contaminated(table, benchmark).collect()) == sorted(set(range(60)) - {d for d, _ in want})
    assert drop_contaminated(edge_docs, benchmark).columns == edge_docs.columns
    assert contaminated(no_docs, benchmark).count() == 0 and contaminated(table, benchmark.limit(0)).count() == 0
