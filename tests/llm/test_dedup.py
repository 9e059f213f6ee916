import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.llm import line_dedup as line_dedup_module
from likeness.llm import near_dedup, suffix_dedup
from likeness.llm.bwt_intervals import repeated_starts
from likeness.llm.cuckoo import CuckooFilter
from likeness.llm.dart_minhash import cells, jaccard, shingles, signatures
from likeness.llm.line_dedup import LineIndex, drop_repeated_lines, line_dedup
from likeness.llm.near_dedup import drop_near_duplicates
from likeness.llm.suffix_dedup import substring_dedup

SPACE = " \t\n\x0b\x0c\r"


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all() and not f.saturated
    assert f.contains(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.01
    assert all(f.delete(int(k)) for k in keys[:2500])
    again = CuckooFilter.from_bytes(f.to_bytes())
    assert again.contains(keys[2500:]).all() and again.contains(keys[:2500]).mean() < 0.01
    full = CuckooFilter.of(keys, most_buckets=64)
    assert full.saturated and full.contains(np.array([1, 2], np.uint64)).all()


def brute_lines(docs, threshold):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    held = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < threshold]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def as_rows(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_lines_match_brute_force_and_can_be_undone(spark, edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = brute_lines(docs, 10)
    assert sum(w[2] for w in want) == 24
    assert as_rows(line_dedup(edge_docs, 10)) == want
    assert line_dedup(no_docs, 10).count() == 0
    extra = spark.createDataFrame([(100 + i, "own 3 text\nsolo") for i in range(10)], "doc_id long, text string")
    index = LineIndex.build(edge_docs, 10)
    more = index.insert(extra)
    both = brute_lines(docs + [(100 + i, "own 3 text\nsolo") for i in range(10)], 10)
    assert as_rows(line_dedup(edge_docs, 10, more)) == [w for w in both if w[0] in {x[0] for x in want}]
    back = more.delete(extra)
    assert as_rows(line_dedup(edge_docs, 10, back)) == want
    kept = drop_repeated_lines(edge_docs, 10)
    assert kept.columns == edge_docs.columns and kept.count() == len(docs)
    assert all(r.n_chars == len(r.text or "") for r in kept.collect())


@pytest.mark.parametrize("head", [1, 10_000])
def test_full_filters_and_the_head_change_nothing(spark, monkeypatch, head):
    for name, value in (("SHARD_KEYS", 30), ("SHARD_BUCKETS", 64), ("MOST_SHARDS", 8), ("HEAD_KEYS", head)):
        monkeypatch.setattr(line_dedup_module, name, value)
    rng = np.random.default_rng(12)
    rows = [(i, "\n".join(["everywhere", *(f" Line {k}\t" for k in rng.integers(0, 700, 60))])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = LineIndex.build(docs, 10)
    assert 1 < index.shards <= 8
    assert as_rows(line_dedup(docs, 10, index)) == brute_lines(rows, 10)
    more = [(1000 + i, "\n".join(f"new {k}" for k in range(3000))) for i in range(10)]
    grown = index.insert(spark.createDataFrame(more, "doc_id long, text string"))
    assert grown.shards == 8 and any(raw[0] for raw in grown.filters.values())  # too many keys for all shards
    assert as_rows(line_dedup(docs, 10, grown)) == brute_lines(rows, 10)
    back = grown.delete(spark.createDataFrame(more, "doc_id long, text string"))
    assert as_rows(line_dedup(docs, 10, back)) == brute_lines(rows, 10)


def test_dart_signatures_estimate_jaccard():
    rng = np.random.default_rng(2)
    for n, swap in ((20, 2), (400, 40), (9000, 900)):
        a = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[swap:], rng.integers(1, 1 << 62, swap, dtype=np.uint64)]))
        s = signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 2048)
        assert abs((s[0] == s[1]).mean() - jaccard(a, b)) < 0.05


def test_weighted_cells_count_copies():
    hashes, doc = shingles(["a b c d e " * 3, "a b c d e"])
    cell, owner = cells(hashes, doc, counted=True)
    assert np.bincount(owner).tolist() == [11, 1] and len(np.unique(cell)) == 11


def brute_classes(docs, similarity=0.8, weighted=False):
    sets = {}
    for n, (_, t) in enumerate(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[n] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
        if not weighted:
            sets[n] = Counter(set(sets[n]))
    group = list(range(len(docs)))
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and (sets[a] & sets[b]).total() >= similarity * (sets[a] | sets[b]).total():
                group = [group[a] if g == group[b] else g for g in group]
    return group


def near_table(edge_docs):
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join([*base[:k], *(f"x{j}" for j in range(k * 2, k * 2 + 2)), *base[k + 2 :]]) for k in range(0, 40, 4)]
    slow = [" ".join(f"s{i}" for i in range(k, k + 80)) for k in range(0, 60, 6)]  # each near the next only
    # half alike: they share buckets and are of classes of their own
    half = [" ".join([*(f"h{i}" for i in range(60)), *(f"own{n}_{i}" for i in range(22))]) for n in range(40)]
    many = ["a b c d e " * 40, "a b c d e " * 8, "a b c d e " * 39 + "f"]  # alike as sets, not as weighted sets
    return [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()] + [(200 + i, t) for i, t in enumerate(chain + slow + half + many)]


def members(got, docs):
    """The texts of each class, as a sorted list of sorted lists."""
    held = {}
    for (_, text), c in zip(docs, got, strict=True):
        held.setdefault(c, []).append(text)
    return sorted(sorted(x) for x in held.values())


@pytest.mark.parametrize(("block", "weighted"), [(256, False), (2, False), (256, True)])
def test_near_duplicates_match_brute_force(spark, edge_docs, no_docs, monkeypatch, block, weighted):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(near_dedup, "COUNTED_PAIRS", 1 << 22 if block > 2 else 50)
    docs = near_table(edge_docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = near_dedup.near_duplicate_classes(table, weighted=weighted).collect()
    assert len(rows) == len(docs)
    by_row = {(r.doc_id, r.text_hash): r["class"] for r in rows}
    hashes = {(r.doc_id, r.text): r.h for r in table.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()}
    texts = [(i, t) for i, t in docs if (t or "").split()]
    want = [g for g, (_, t) in zip(brute_classes(docs, weighted=weighted), docs, strict=True) if (t or "").split()]
    assert members([by_row[i, hashes[i, t]] for i, t in texts], texts) == members(want, texts)
    n_classes = len(set(want))
    got = near_dedup.near_dedup(table, weighted=weighted).collect()
    kept = [r for r in got if r.is_kept]
    assert len([r for r in got if r.class_size == 1 and r.class_id is None]) >= 4  # without words, each on its own
    sizes = Counter(want)
    assert sorted(r.class_size for r in kept) == sorted([*sizes.values(), *[1] * (len(docs) - len(texts))])
    left = drop_near_duplicates(table, weighted=weighted)
    assert left.columns == table.columns and left.count() == n_classes + len(docs) - len(texts) == len(kept)


def test_near_duplicates_of_no_rows(no_docs):
    assert near_dedup.near_dedup(no_docs).count() == 0 and drop_near_duplicates(no_docs).count() == 0


def brute_repeats(strings, t):
    held = Counter(s[i : i + t] for s in strings for i in range(len(s) - t + 1))
    return [i + t <= len(s) and held[s[i : i + t]] > 1 for s in strings for i in range(len(s) + 1)]


def test_interval_expansion_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(150):
        strings = [bytes(rng.choice(list(b"abc"), rng.integers(0, 25)).astype(np.uint8)) for _ in range(rng.integers(1, 7))]
        strings.append(strings[0][2:] + b"ab")
        t = int(rng.integers(1, 8))
        assert repeated_starts(strings, t).tolist() == brute_repeats(strings, t)


@pytest.mark.parametrize("most_runs", [1500, 1])
def test_substrings_match_brute_force(spark, edge_docs, no_docs, monkeypatch, most_runs):
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", most_runs)
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abc def\n"), 900)) for _ in range(6)]
    shared = "".join(rng.choice(list("xyz "), 430))
    docs = [(i, t[:300] + shared + t[300:] if i < 4 else t) for i, t in enumerate(texts)]
    docs += [(10, texts[5][100:510] + "é" * 10), (11, "For " * 300), (12, "For " * 90), (None, None), (13, ""), (14, texts[4]), (14, texts[4])]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    raw = [(t or "").encode() for _, t in docs]
    mask, at, want = brute_repeats(raw, 400), 0, []
    for (i, _), s in zip(docs, raw):
        edge = np.zeros(len(s) + 1, int)
        for p in np.flatnonzero(mask[at : at + len(s)]):
            edge[p] += 1
            edge[p + 400] -= 1
        at += len(s) + 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(s, np.uint8)[~gone].tobytes()
        want.append((str(i), len(s), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup(table)
    assert as_rows(got.drop("spans")) == sorted(want)
    assert all(r.n_removed == sum(s.end - s.begin for s in r.spans) and r.n_spans == len(r.spans) for r in got.collect())
    whole = table.withColumn("places", F.lit("p"))
    kept = suffix_dedup.drop_repeated_substrings(whole)
    assert kept.columns == whole.columns
    hashes = {w[0]: w[4] for w in want}
    plain = [r for r in kept.collect() if (r.text or "").isascii()]
    assert len(plain) >= 10 and all(hashlib.sha256((r.text or "").encode()).hexdigest() == hashes[str(r.doc_id)] for r in plain)
    assert substring_dedup(no_docs).count() == 0
    assert substring_dedup(edge_docs).count() == edge_docs.count()


def test_substrings_of_a_text_beyond_16_mib_after_an_empty_one(spark):
    rng = np.random.default_rng(9)
    raw = bytearray(rng.integers(97, 123, 17_000_000).astype(np.uint8).tobytes())
    raw[1_000_000:1_001_024] = raw[16_900_000:16_901_024]
    raw[999_999], raw[1_001_024], raw[16_899_999], raw[16_901_024] = b"<>()"
    docs = spark.createDataFrame([(1, ""), (2, raw.decode()), (3, None)], "doc_id long, text string").coalesce(1)
    kept = bytes(raw[:1_000_000] + raw[1_001_024:16_900_000] + raw[16_901_024:])
    empty = hashlib.sha256(b"").hexdigest()
    assert as_rows(substring_dedup(docs).drop("spans")) == [("1", 0, 0, 0, empty), ("2", 17_000_000, 2048, 2, hashlib.sha256(kept).hexdigest()), ("3", 0, 0, 0, empty)]
