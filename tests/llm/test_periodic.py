import hashlib
import random

import llm_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobledger.llm import periodic
from jobledger.llm.queries import _with_periods, op13_runs

SF = "/root/testdata/sf0.001"


def test_runs_of_generated_words():
    draw = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(1, 5)):
            w = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(0, 60))]
            if w and draw.random() < 0.5:
                a = draw.randrange(len(w))
                p = 1 + (len(w) - a) // draw.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(w)
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        codes = np.array([x for w in texts for x in w], np.int64)
        for least, exponent in ((6, 4), (2, 2), (5, 3)):
            assert periodic.find_runs(codes, offsets, least, exponent) == [brute.runs(w, least, exponent) for w in texts]


def test_suffix_array_and_prefixes():
    draw = np.random.default_rng(2)
    codes, offsets = draw.integers(0, 2, 80), np.array([0, 30, 30, 50, 80])
    text = np.repeat(np.arange(4), np.diff(offsets))
    ends = offsets[text + 1]
    sa, isa, levels = periodic.suffix_array(codes, text, ends)
    suffix = lambda i: (text[i], *codes[i:ends[i]])
    assert sa.tolist() == sorted(range(80), key=suffix) and (isa[sa] == np.arange(80)).all()
    lcp = periodic.common_prefixes(sa, levels, ends)
    for k in range(1, 80):
        a, b = suffix(sa[k - 1]), suffix(sa[k])
        shared = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
        assert lcp[k] == max(0, shared - 1)


def test_one_word_repeated_many_times():
    assert periodic.find_runs(np.zeros(100_000, np.int64), np.array([0, 100_000])) == [[(0, 100_000, 1)]]


@pytest.mark.parametrize("data", ["documents", "awkward", "empty"])
def test_periodic_runs(request, data):
    df = request.getfixturevalue(data)
    out = periodic.periodic_runs(_with_periods(df), runs_col="w")
    assert out.columns == ["doc_id", "text", "w", "collapsed"]
    got = sorted(((r.doc_id, [tuple(x) for x in r.w], r.collapsed) for r in out.collect()), key=repr)
    want = []
    for r in df.select("doc_id", "text").collect():
        w = brute.with_periods(r.doc_id, r.text)
        found = brute.runs(w) if len(w) < 5000 else None
        want.append((r.doc_id, found, None if found is None else brute.collapse(w, found)))
    want.sort(key=repr)
    assert len(got) == len(want)
    told = {repr(x) for x in got}
    assert all(repr(x) in told for x in want if x[1] is not None)
    assert periodic.periodic_runs(df).columns == [*df.columns, "runs", "collapsed"]


def test_query(spark, documents):
    rows = {r.doc_id: r for r in op13_runs(spark, SF).collect()}
    assert len(rows) == documents.count()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in documents.select("doc_id", "text").where(F.length("text") < 20_000).collect():
        w = brute.with_periods(r.doc_id, r.text)
        found = brute.runs(w)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        x = rows[r.doc_id]
        assert x.n_runs == len(found) and (x.start, x.length, x.period) == (best or (None, None, None))
        assert x.exponent_milli == (best and 1000 * best[1] // best[2])
        assert x.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in found)) and x.collapsed_sha256 == sha(brute.collapse(w, found))
    assert sum(r.n_runs > 0 for r in rows.values()) >= 10
