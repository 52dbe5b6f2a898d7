import hashlib
import random
from collections import Counter

import llm_brute as brute
import numpy as np
import pyarrow as pa
import pytest

from jobledger.llm import substring
from jobledger.llm.queries import op11_substring
from jobledger.session import settings

SF = "/root/testdata/sf0.001"


def found(df, **options):
    rows = substring.drop_repeats(df, **options).select("doc_id", "n_words", "removed", "kept").collect()
    return Counter((r.doc_id, r.n_words, tuple((x.start, x.end) for x in r.removed), r.kept) for r in rows)


def wanted(df, window=13):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    return Counter((i, n, tuple(spans), kept) for i, n, spans, kept in brute.without_repeats(rows, window))


@pytest.mark.parametrize("data", ["documents", "awkward", "empty"])
def test_drop_repeats(request, data):
    df = request.getfixturevalue(data)
    assert found(df) == wanted(df)
    assert substring.drop_repeats(df).columns == [c for c in df.columns if c != "text"] + ["n_words", "removed", "kept"]


def generated(seed):
    """Texts that share passages, copies and near copies, few words, ids that repeat or are null."""
    draw = random.Random(seed)
    passages = [[f"p{draw.randrange(60)}" for _ in range(draw.randint(3, 40))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(draw.randint(0, 5)):
            w += draw.choice([draw.choice(passages), [f"w{draw.randrange(400)}" for _ in range(draw.randint(0, 30))], [draw.choice("ab")] * draw.randint(0, 30)])
        if rows and draw.random() < 0.3:
            w = draw.choice(rows)[1].split()
            if w and draw.random() < 0.6:
                w[draw.randrange(len(w))] = "changed"
        rows.append((draw.choice([i, i, i, i - 1, None]), draw.choice([" ", "  ", " \n"]).join(w)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batch,window,seeds", [(1, 10_000, 13, 5), (2, 3, 13, 5), (3, 7, 13, 5), (4, 5, 6, 2), (5, 4, 5, 5), (6, 6, 20, 3)])
def test_generated_texts(spark, seed, batch, window, seeds):
    df = spark.createDataFrame(generated(seed), "doc_id long, text string").repartition(4)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(batch)):
        assert found(df, window=window, seed=seeds) == wanted(df, window)


def test_a_passage_in_a_third_of_all_texts(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, (passage + " " if i % 3 == 0 else "") + " ".join(f"d{i}w{j}" for j in range(20))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="40"):
        assert found(df) == wanted(df)


def test_a_batch_sends_two_rows_of_a_seed_that_many_share():
    text = " ".join(f"p{i}" for i in range(13))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(range(50)), pa.array([f"{text} x{i}" for i in range(50)])], ["o", "t", "text"])
    out = next(substring._seed_rows(13, 5)(iter([batch]))).to_pandas()
    shared = out[out.known]
    hot = shared.k.value_counts()
    assert len(shared) >= 50 and hot.iloc[0] == 2 and (hot > 2).sum() == 0


def test_a_text_that_repeats_itself_sends_one_row_a_stretch():
    text = " ".join(["a b"] * 500)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([10, 20]), pa.array([text + " end", text])], ["o", "t", "text"])
    out = next(substring._seed_rows(13, 5)(iter([batch]))).to_pandas()
    assert len(out) <= 8 and out.known.sum() >= 2
    lists = [out["at"][(out.o == o) & out.known].tolist() for o in (1, 2)]
    batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], ["o", "t", "text", "ats"])
    units = next(substring._unit_rows(13, 5)(iter([batch]))).to_pandas()
    assert len(units) <= 8 and max(map(len, units["from"])) > 400


def test_every_window_has_a_seed_and_equal_windows_have_equal_ones():
    draw = np.random.default_rng(3)
    w = draw.integers(0, 4, 300)
    hashes = draw.integers(0, 1 << 63, 4, dtype=np.uint64)[w]
    offsets = np.array([0, 100, 105, 300])
    text, h, low, high = substring.seeds(hashes, offsets)
    told = {}
    for k, x, a, b in zip(text, h, low, high, strict=True):
        for s in range(a, b + 1):
            assert offsets[k] <= s and s + 13 <= offsets[k + 1]
            assert told.setdefault(tuple(w[s:s + 13]), x) == x
    assert sum(b - a + 1 for a, b in zip(low, high, strict=True)) == 88 + 183


def test_query(spark, documents):
    want = {i: (n, sum(b - a for a, b in spans), hashlib.sha256(kept.encode()).hexdigest())
            for i, n, spans, kept in brute.without_repeats([(r.doc_id, r.text) for r in documents.collect()])}
    rows = op11_substring(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want and len(rows) == len(want)
    assert sum(r.n_removed > 0 for r in rows) > 10
