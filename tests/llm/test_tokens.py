import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from likeness.llm import bpe
from likeness.llm.bpe import Encoder, Transducer, vocabulary_path
from likeness.llm.packing import OnlineBestFit, best_fit_packing
from likeness.llm.token_counts import token_counts
from likeness.llm.token_files import token_id_round_trip, token_index, write_token_files


@pytest.fixture(scope="module")
def machines():
    return Encoder(vocabulary_path()), Transducer(vocabulary_path())


def check(machines, texts):
    encoder, transducer = machines
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.ids(texts)] == want
    assert transducer.counts(texts).tolist() == [len(w) for w in want]


def test_library_is_matched_on_odd_texts(machines):
    check(machines, ["", " ", "it's 'S ''s !!'s x'true don't", "<|endoftext|>a", "é É é ñ’s “q” 日本語 ½", "a" * 3000, "ab" * 2000 + " x", "\x1c\x85\xa0c", "ﬁ ẞ İ Σ ΑΣ ς", "😀 x", "012345" * 40, "__init__", "a\x00b"])
    rng = random.Random(3)
    for alphabet in ("abcdefgh 'stmdrvl!?.,0129ÉéñÇ—’ \n\t_", "aaeeiooutthhnnrs"):
        check(machines, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(300)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_library_is_matched_on_any_text(machines, texts):
    check(machines, [t.encode("utf-8", "ignore").decode() for t in texts])


ODD = ["😀", "שלום", "สวัสดีครับ", "Ελληνικά", "ΑΣ", "नमस्ते", "𝔘nicode", "한국어", "İstanbul", "ﬀ", "é", "\u0308x", "a\u200bb", "ሰላም", "plain", "it's"]


def test_words_outside_the_alphabet_are_the_library_s(machines):
    rng = random.Random(5)
    check(machines, [" ".join(rng.choice(ODD) + rng.choice(["", "x", "'s", "!"]) for _ in range(30)) for _ in range(100)])
    check(machines, ["".join(rng.choice([*ODD, " ", "\n", "\u3000", "\x85", "\u0301"]) for _ in range(30)) for _ in range(200)])
    # only the stretches themselves go there
    data, spans = machines[1].normal("Plain 😀x and שלום END")
    assert [data[a:b].decode() for a, b in spans] == ["😀x", "שלום"] and data.startswith(b"plain ") and data.endswith(b" end")


@pytest.mark.parametrize("segment", [bpe.SEGMENT, 200])
def test_unbroken_texts_are_composed_of_chunks(machines, monkeypatch, segment):
    monkeypatch.setattr(bpe, "SEGMENT", segment)
    if segment == 200:
        monkeypatch.setattr(bpe, "MOST_TRANSITIONS", 300)
    transducer, library = Transducer(vocabulary_path()), machines[0].library
    rng = random.Random(6)
    for alphabet in ("a", "ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "éüß日本"):
        texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 63, 64, 65, 127, 199, 200, 1000, 60_000 if segment > 200 else 3000)]
        assert transducer.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_small_caches_start_anew(machines):
    encoder, transducer = Encoder(vocabulary_path(), most_words=5), Transducer(vocabulary_path(), most_words=5)
    for n in range(4):
        check((encoder, transducer), [f"many different words {n} here {k}" for k in range(20)])


def test_counts_and_files(spark, edge_docs, no_docs, machines, tmp_path):
    library = machines[0].library
    docs = edge_docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS hash").collect()
    got = token_counts(edge_docs, limit=2048).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts(no_docs).count() == 0
    order = sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.hash))
    ids = [np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in order]
    starts = np.cumsum([0, *map(len, ids)])
    got = token_id_round_trip(edge_docs).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(d.doc_id, s, len(x), zlib.crc32(x.tobytes())) for d, s, x in zip(order, starts, ids)]
    assert token_id_round_trip(no_docs).count() == 0
    write_token_files(edge_docs, str(tmp_path / "ids"))
    index = token_index(spark, str(tmp_path / "ids"))
    assert index.agg({"n_tokens": "sum"}).first()[0] == starts[-1]


def test_packing(edge_docs, no_docs, machines):
    library = machines[0].library
    rows = best_fit_packing(edge_docs, capacity=64).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    want = []
    for d in edge_docs.collect():
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(d.doc_id), k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    total = sum(r.length for r in rows)
    assert len(places) <= 1.1 * -(-total // 64) + 1
    assert best_fit_packing(no_docs).count() == 0


def test_packing_of_full_sequences(spark, machines):
    """At 4096 tokens: sequences are gapless, and few more than any packing needs."""
    rng = random.Random(9)
    rows = [(i, " ".join("word" for _ in range(int(rng.paretovariate(0.9) * 90) % 11_000))) for i in range(900)]
    pieces = best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), capacity=4096).collect()
    held = defaultdict(list)
    for r in pieces:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    lengths = Counter()
    for r in pieces:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(t.split()) + 1 for i, t in rows}
    total = sum(lengths.values())
    large = sum(r.length > 2048 for r in pieces)  # no two of them share a sequence
    assert len(held) <= 1.03 * max(-(-total // 4096), large) + 1


def test_token_files_can_be_read_in_part(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(10)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 400)))) for i in range(4000)], "doc_id long, text string")
    path = str(tmp_path / "ids")
    write_token_files(docs, path)
    files = [p for p in (tmp_path / "ids").iterdir() if p.name.endswith(".parquet")]
    every, ids_bytes = 0, 0
    for p in files:
        meta = pq.ParquetFile(p).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("ids"):
                    assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(column.encodings)
                    ids_bytes += column.total_compressed_size
                every += column.total_compressed_size
    assert files and ids_bytes > 0.5 * every
    index = token_index(spark, path)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema:")[1].split("\n")[0]  # the ids are not read
    few = spark.read.parquet(path).where("doc_id BETWEEN 100 AND 104").select("doc_id", "ids")
    assert few.count() == 5 and "PushedFilters: [IsNotNull(doc_id)" in few._jdf.queryExecution().executedPlan().toString()


def test_online_best_fit_closes_the_fullest():
    p = OnlineBestFit(10, open_bins=2)
    assert [p.add(n) for n in (6, 7, 9)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 was the fullest and closed
    assert p.add(4) == (0, 6) and p.add(1) == (2, 9)
    assert p.open_bins() == set()
    p = OnlineBestFit(10, open_bins=2)
    assert [p.add(n) for n in (6, 7, 10, 3, 4)] == [(0, 0), (1, 0), (2, 0), (1, 7), (0, 6)]  # a full sequence closes none
