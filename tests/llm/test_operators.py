import hashlib
from collections import Counter, defaultdict

import llm_brute as brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobledger.llm import exact, mixing, packing, pii, quality, sharding, simhash, tokens, toxicity, urlrules
from jobledger.llm.components import components
from jobledger.llm.queries import LISTS, QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(TOKENIZER)
TOKENS = Tokenizer.from_file(PATH)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("data", ["documents", "awkward", "empty"])
def test_exact_copies(request, data):
    df = request.getfixturevalue(data)
    rows = exact.exact_dedup(df, prefix_chars=8).collect()
    groups = defaultdict(list)
    for i, t in texts(df):
        groups[brute.WHITE.sub(" ", t or "")].append(i)
    want = Counter()
    for t, ids in groups.items():
        first = min(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            want[(i, first, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert bag((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k, n in want.items() if k[3] for _ in range(n))


@pytest.mark.parametrize("data", ["documents", "awkward", "empty"])
def test_fingerprints_and_components(request, data):
    df = request.getfixturevalue(data)
    rows = simhash.near_duplicates(df, shingle=4, distance=4, bits=simhash.SEGMENTS, words=1).collect()
    told = texts(df)
    assert bag((r.doc_id, r.fingerprint) for r in rows) == bag((i, f"{brute.fingerprint(t, 4):016x}") for i, t in told)
    by_place = brute.components(dict(enumerate(brute.fingerprint(t, 4) for _, t in told)), 4)
    groups = defaultdict(list)
    for k, root in by_place.items():
        groups[root].append(told[k][0])
    want = Counter((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert bag((r.doc_id, r.component_id, r.component_size) for r in rows) == want


def test_crowded_buckets_keep_every_link(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    prints = {base}
    while len(prints) < 120:
        f = base
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            f ^= 1 << int(b)
        prints.add(f if f < 1 << 63 else f - (1 << 64))
    df = spark.createDataFrame([(f,) for f in prints], "f long")
    want = brute.components({f: f & ((1 << 64) - 1) for f in prints}, 4)
    for bucket in (7, 4096):
        roots = {r.node: r.root for r in components(simhash.near_links(df, bucket=bucket), "a", "b").collect()}
        assert {f: roots.get(f, f) for f in prints} == want


def test_near_copies_at_the_usual_similarity(spark):
    draw = np.random.default_rng(3)
    rows, n = [], 0
    for k in range(40):
        w = [f"w{x}" for x in draw.integers(0, 5000, 400)]
        rows.append((n, " ".join(w)))
        near = list(w)
        for at in draw.choice(400, 5, replace=False):
            near[at] = "changed"
        rows.append((n + 1, " ".join(near)))
        n += 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    assert {i for i in range(n) if i % 2 == 0} <= kept
    assert len(kept) <= 40 + 4


def test_wide_links_are_complete(spark):
    draw, rows, pairs = np.random.default_rng(6), [], []
    for k in range(300):
        a = draw.integers(0, 2, 128)
        b = a.copy()
        if k % 2:
            b[draw.choice(128, 20 + k % 3, replace=False)] ^= 1
        else:  # two or three bits in each sixteen
            for s in range(8):
                b[16 * s + draw.choice(16, 3 if s < 6 else 2, replace=False)] ^= 1
        for side, f in enumerate((a, b)):
            rows.append((2 * k + side, *np.packbits(f).view(">i8").tolist()))
        pairs.append((2 * k, 2 * k + 1))
    prints = spark.createDataFrame(rows, "f long, w0 long, w1 long")
    links = simhash.near_links(prints, simhash.WIDE_DISTANCE, simhash.WIDE_SEGMENTS, words=simhash.WIDE_WORDS)
    assert {(min(r), max(r)) for r in links.collect()} == set(pairs)
    with pytest.raises(ValueError):
        simhash.near_links(prints, 22, (16, 16, 16, 16), words=2)


@pytest.mark.parametrize("data", ["awkward", "empty"])
def test_near_copies_of_awkward_rows(request, data):
    df = request.getfixturevalue(data)
    rows = simhash.near_duplicates(df).collect()
    kept = simhash.drop_near_copies(df)
    assert len(rows) == df.count() and kept.columns == df.columns
    heads = {(r.component_id, r.fingerprint if r.component_id is None else None) for r in rows}
    assert kept.count() == len(heads)


@pytest.mark.parametrize("data", ["documents", "awkward", "empty"])
def test_personal_data(request, spark, data):
    df = request.getfixturevalue(data)
    model = pii.train(df)
    out = pii.find_spans(df, model, out="found")
    assert out.columns == [*df.columns, "found"]
    got = Counter()
    for r in out.collect():
        base = [f"{k}:{x.start}:{x.end}" for k in pii.KINDS for x in r.found[k]]
        got[(r.doc_id, ",".join(base))] += 1
        taken = [(x.start, x.end) for k in pii.KINDS for x in r.found[k]]
        assert all(x.end <= a or b <= x.start for x in r.found.added for a, b in taken)
    assert got == bag((i, ",".join(brute.spans(t))) for i, t in texts(df))
    assert pii.redact(df, model).columns == df.columns


def test_redaction_and_trees(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org or 1.2.3.4!"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redact(df, None).orderBy("doc_id").collect()] == ["mail [email] or [ip]!", None]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select(F.explode(pii.candidates(pii.text_of())).alias("x")).select("x.*")
    assert rows.count() > 0


def test_tree_expression_equals_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    draw = np.random.default_rng(1)
    rows = [(float(a), float(b), float((a > 3) ^ (b < 2))) for a, b in draw.integers(0, 8, (300, 2))]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(spark.createDataFrame(rows, "a double, b double, y double"))
    model = GBTClassifier(featuresCol="v", labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(df)
    margin = pii.tree_expression(model, lambda i: F.col("ab"[i]))
    both = model.transform(df).select(margin.alias("m"), vector_to_array("rawPrediction").alias("r")).collect()
    assert all(abs(2 * x.m - 2 * x.r[1]) < 1e-9 or abs(2 * x.m - x.r[1]) < 1e-9 for x in both)


@pytest.mark.parametrize("data", ["documents", "awkward", "empty"])
def test_quality_statistics(request, data):
    df = request.getfixturevalue(data)
    rows = quality.judge(df, [], out="q").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag((r.doc_id, *(r.q[n] for n in names)) for r in rows) == bag((i, *brute.quality(t)) for i, t in texts(df))
    assert all(r.q.kept is not r.q.base_failed for r in rows)
    kept = quality.keep_good(df, [])
    assert kept.columns == df.columns and kept.count() == sum(r.q.kept for r in rows)


def test_decision_list(spark):
    plain = "one two three four five six seven eight nine ten " * 3
    rows = [(i, plain + f"tail{i}", 1) for i in range(150)] + [(i + 500, "ONE#$ TWO#$ " * 30 + f"tail{i}", 0) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = quality.train(df.drop("quality"), df.select("doc_id", "quality"))
    verdicts = quality.with_statistics(df).select("quality", quality.verdict(rules).alias("rule")).collect()
    assert rules and all((r.rule is None) == (r.quality == 1) for r in verdicts)
    assert quality.train(df.drop("quality"), df.select("doc_id", "quality").where("quality = 1")) == []
    assert quality.train(df.drop("quality"), df.select("doc_id", "quality").where("false")) == []


@pytest.mark.parametrize("data", ["documents", "awkward", "empty"])
def test_token_counts(request, data):
    df = request.getfixturevalue(data)
    out = tokens.count_tokens(df, PATH)
    assert out.columns == [c for c in df.columns if c != "text"] + ["n_tokens"]
    want = bag((i, len(TOKENS.encode(t or "", add_special_tokens=False).ids)) for i, t in texts(df))
    assert bag((r.doc_id, r.n_tokens) for r in out.collect()) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(documents, name):
    path = public_tokenizers.path(name)
    encode = tokens.encoder(path)
    assert not tokens.word_wise(path)
    some = texts(documents)[:40]
    counts = [sum(n) for n in tokens.encoded([t for _, t in some], path, len)]
    assert counts == [len(encode([t])[0]) for _, t in some]


def test_a_vocabulary_with_capitals(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    words = ["[UNK]", "Paris", "paris", ".", "Hello", "hello", "a", "..", ",", "b"]
    made = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    for splitter in (pre_tokenizers.Whitespace(), pre_tokenizers.WhitespaceSplit()):
        made.pre_tokenizer = splitter
        path = str(tmp_path / f"{type(splitter).__name__}.json")
        made.save(path)
        some = ["Paris. Paris.. paris", "Hello hello, a.b HELLO", "", "a | b.", "Paris,, .Paris"]
        got = [[i for held in word for i in held] for word in tokens.encoded(some, path, list)]
        assert got == [made.encode(t, add_special_tokens=False).ids for t in some]
    assert tokens.splitting(PATH)[0] and tokens.splitting(PATH)[1] == tokens.MARKS


def test_pieces_of_long_texts():
    text = "ab cd\n" * 50 + "x" * 100
    for most in (7, 40, 1000):
        assert "".join(tokens.pieces(text, most)) == text
    assert list(tokens.pieces("", 5)) == [""]
    assert [len(b) for b in tokens.balanced(["a" * 9, "b", "c", "d" * 30], 10)] == [2, 1, 1]


@pytest.mark.parametrize("data", ["documents", "awkward", "empty"])
def test_packing(request, data):
    df = request.getfixturevalue(data)
    rows = packing.pack(packing.cut_pieces(df, PATH, with_ids=True), group=100).collect()
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == bag(
        (i, *p) for i, t in texts(df) for p in brute.pieces(TOKENS, t))
    assert all(len(r.ids) == 4 * r.length for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_columns_named_like_the_operators_own_stay(spark):
    rows = [(1, "a b c d e f", "x", "y", "z"), (2, "a b c d e f", "x2", "y2", "z2"), (3, "other words than these", "x3", "y3", "z3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_id string, own_digest string, own_print string")
    for kept in (exact.drop_copies(df), simhash.drop_near_copies(df)):
        assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_genetic_packing_beats_or_meets_best_fit():
    draw = np.random.default_rng(2)
    for seed in range(5):
        sizes = draw.integers(900, 2600, 60).tolist()
        order = sorted(range(60), key=lambda i: -sizes[i])
        plain = packing.best_fit(order, sizes, 4096, [])
        best = packing.evolve(sizes, 4096, seed, [], generations=20)
        assert sorted(i for b in best for i in b) == list(range(60))
        assert all(sum(sizes[i] for i in b) <= 4096 for b in best)
        assert len(best) <= len(plain)
        again = packing.evolve(sizes, 4096, seed, [best, plain], generations=5)
        assert len(again) <= len(best)


@pytest.mark.parametrize("weights,repeat", [(None, True), ({"s0": 0.7, "s1": 0.2, "s2": 0.1}, True), ({}, False)])
def test_mixture(awkward, weights, repeat):
    rows = mixing.mix(awkward, weights, repeat, block_size=300, quantum=50, buckets=4).collect()
    ids = Counter(r.doc_id for r in rows if r.mix.epoch == 0)
    assert ids == Counter(i for i, _ in texts(awkward))
    assert repeat or all(r.mix.epoch == 0 for r in rows)
    for r in rows:
        assert r.mix.release <= r.mix.slot < r.mix.deadline
    slots = {}
    for r in rows:
        assert slots.setdefault(r.mix.slot, (r.source, r.mix.block)) == (r.source, r.mix.block)


def test_mixture_meets_weights(spark):
    rows = [(i, "x" * 50, "big" if i % 3 else "small") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, {"big": 0.4, "small": 0.6}, block_size=500, quantum=100)
    sizes = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(sizes["small"] / sum(sizes.values()) - 0.6) < 0.02
    served = defaultdict(set)
    for r in out.collect():
        served[r.mix.slot // 10].add((r.mix.slot, r.source))
    seen = Counter()
    for k in range(max(served)):
        seen.update(s for _, s in served[k])
        assert abs(seen["small"] - 0.6 * 10 * (k + 1)) < 1.2


def test_schedule_is_earliest_deadline_first(spark):
    sources = spark.createDataFrame([("a", 5.0, 9), ("b", 3.0, 4), ("c", 1.0, 1), ("d", 0.5, 7)], "key string, weight double, n_blocks long")
    rows = {r.key: r for r in mixing.schedule(sources, 40).collect()}
    assert sum(r.quota for r in rows.values()) == 40
    order = brute.schedule({k: rows[k].quota for k in sorted(rows)}, 40)
    assert {k: [t for t, s in enumerate(order) if s == k] for k in rows} == {k: list(r.slots) for k, r in rows.items()}


def test_deviation_from_weights_stays_below_a_block(spark):
    weights = {f"s{i:02}": 1 / 3 if i == 0 else 2 / 57 for i in range(20)}
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.format_string("s%02d", F.col("id") % 20).alias("source"))
    out = mixing.mix(df, weights, block_size=10, quantum=100)
    served = {r.slot: r.source for r in out.select("mix.slot", "source").distinct().collect()}
    assert len(served) > 80 * 100 and sorted(served) == list(range(len(served)))
    seen = Counter()
    for t in range(len(served)):
        seen[served[t]] += 1
        assert all(abs(seen[s] - w * (t + 1)) < 1 + 1e-4 for s, w in weights.items())


def test_mixture_of_nothing(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_rows(empty).columns == empty.columns


def test_too_many_sources(spark):
    df = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("source"))
    with pytest.raises(Exception, match="raise quantum"):
        mixing.mix(df, quantum=20).collect()


def test_shard_table_and_places(awkward, empty, tmp_path):
    names = sharding.shard_names(7)
    table = sharding.fill_table(names, 1009)
    counts = np.bincount(table, minlength=7)
    assert counts.sum() == 1009 and counts.max() - counts.min() <= 1
    moved = [(a, names[1:][b]) for a, b in zip((names[i] for i in table), sharding.fill_table(names[1:], 1009), strict=True)]
    assert sum(a != b for a, b in moved if a != names[0]) < 0.25 * 1009
    assert (sharding.fill_table(names[::-1], 1009) == [names[::-1].index(names[i]) for i in table]).all()
    rows = sharding.place(awkward, F.col("doc_id"), names, 1009).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        text = "null" if r.doc_id is None else f"={r.doc_id}"
        assert r.slot == int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % 1009 and r.shard == names[table[r.slot]]
    assert sharding.place(empty, F.col("doc_id"), names, 1009).count() == 0
    for bad in ((names, 1000), ([], 1009), (["a", "a"], 1009)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)
    sharding.write_shards(sharding.place(awkward, F.col("doc_id"), names, 1009), str(tmp_path / "out"), parts=2, key=F.col("doc_id"))
    spark = awkward.sparkSession
    assert spark.read.parquet(str(tmp_path / "out")).count() == awkward.count()


def test_toxicity_held_out(spark):
    draw = np.random.default_rng(4)
    rows = []
    for i in range(300):
        w = [f"{'bcdfghklmnprst'[a]}{'aeiou'[b]}{'lmnrst'[c]}" for a, b, c in zip(draw.integers(0, 14, 120), draw.integers(0, 5, 120), draw.integers(0, 6, 120), strict=True)]
        if i % 3 == 0:
            for at in draw.choice(120, 4, replace=False):
                w[at] = ["wretched", "dimwit", "blockhead"][at % 3]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic").where("doc_id % 5 <> 0"))
    held = toxicity.score(df, model).where("doc_id % 5 = 0").collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in held) >= 0.9 * len(held)


def test_toxicity_of_inflected_stems(spark):
    """No toxic word occurs twice, only its beginning does."""
    draw = np.random.default_rng(8)
    syllable = lambda: f"{'bcdfghklmnprst'[draw.integers(14)]}{'aeiou'[draw.integers(5)]}"
    rows = []
    for i in range(900):
        w = ["".join(syllable() for _ in range(draw.integers(2, 5))) for _ in range(120)]
        if i % 4 == 0:
            for at in draw.choice(120, 6, replace=False):
                w[at] = "xuqor" + syllable() + syllable() + syllable()
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic").where("doc_id % 5 <> 0"))
    held = toxicity.score(df, model).where("doc_id % 5 = 0").collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in held) >= 0.9 * len(held)


def test_toxicity_ranks_labels_that_mark_plain_text(spark):
    """What tells the labels apart stands in text of label 0 only."""
    draw = np.random.default_rng(6)
    rows = []
    for i in range(300):
        w = [f"{'bcdfghklmnprst'[a]}{'aeiou'[b]}{'lmnrst'[c]}" for a, b, c in zip(draw.integers(0, 14, 120), draw.integers(0, 5, 120), draw.integers(0, 6, 120), strict=True)]
        if i % 3 == 0:
            for at in draw.choice(120, 4, replace=False):
                w[at] = ["wretched", "dimwit", "blockhead"][at % 3]
        rows.append((i, " ".join(w), int(i % 3 != 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic").where("doc_id % 5 <> 0"))
    held = toxicity.score(df, model).where("doc_id % 5 = 0").collect()
    one, none = [[r.score for r in held if r.toxic == y] for y in (1, 0)]
    assert np.mean([a > b for a in one for b in none]) >= 0.9


@pytest.mark.parametrize("data", ["documents", "awkward"])
def test_toxicity_equals_a_plain_loop(request, spark, documents, data):
    model = toxicity.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    df = request.getfixturevalue(data)
    got = sorted((str(r.doc_id), r.text or "", r.score) for r in toxicity.score(df, model).collect())
    for (_, text, score), (_, again) in zip(got, sorted((str(i), t or "") for i, t in texts(df)), strict=True):
        assert text == again and abs(score - brute.toxicity(text, model)) < 1e-9


def test_toxicity_scores_do_not_depend_on_the_bound(spark):
    draw = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in draw.integers(0, 60, 40)), int(i % 10 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for bound in (60, 2000):
        model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"), rows=bound)
        scores = [r.score for r in toxicity.score(df, model).collect()]
        assert abs(np.mean(scores) - 0.1) < 0.05


def test_toxicity_of_awkward_rows(awkward, empty):
    labels = awkward.select("doc_id", F.lit(1).alias("toxic"))
    model = toxicity.train(awkward, labels)
    scores = toxicity.score(awkward, model).collect()
    assert len(scores) == awkward.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(empty, model).count() == 0
    mixed = awkward.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(awkward, toxicity.train(awkward, mixed)).collect())


def test_url_rules(spark):
    urls = [
        "http://a.example.net/en/1", "https://A.Example.NET/de/2?x=1", "http://b.example.com/de/3#t", "http://c.org/fr/4", "http://c.org/de/5",
        "http://spam.site.com/x", "no scheme", None, "", "http://net/", "x://", "http://example.net", "http://u@h.net/en/a://b.org/fr/",
    ] * 2
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id int, url string, tokens string")
    rows = urlrules.filter_urls(df, LISTS, support=0.05).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(urls)))
    for r in rows:
        host, path, rule = brute.url(urls[r.page_id], LISTS)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == LISTS[rule] if rule else r.verdict in ("allow", "block")
    assert urlrules.filter_urls(df.where("false"), LISTS).count() == 0


def test_association_rules_and_index(spark):
    baskets = [(["a", "b"], "block")] * 9 + [(["a", "c"], "allow")] * 8 + [(["b", "d"], "block")] * 5 + [(["c", "d"], None)] * 3
    df = spark.createDataFrame(baskets, "tokens array<string>, label string")
    rules = urlrules.mine(df, "tokens", "label", support=0.1, confidence=0.8)
    got = {(tuple(r.tokens), r.label): (round(r.confidence, 6), round(r.support, 6)) for r in rules.collect()}
    known = [(frozenset(t), y) for t, y in baskets if y]
    want = {}
    for size in ({"a"}, {"b"}, {"c"}, {"d"}, {"a", "b"}, {"a", "c"}, {"b", "d"}, {"c", "d"}):
        under = [y for t, y in known if size <= t]
        for y in set(under):
            n = under.count(y)
            if n / len(known) >= 0.1 and n / len(under) >= 0.8:
                want[(tuple(sorted(size)), y)] = (round(n / len(under), 6), round(n / len(known), 6))
    assert got == want
    sets = spark.createDataFrame([(["a", "b"],), (["c", "d"],), (["q"],), (["a"],)], "tokens array<string>")
    best = {tuple(r.tokens): r.best for r in urlrules.match(sets, rules).collect()}
    for (t,) in [(["a", "b"],), (["c", "d"],), (["q"],), (["a"],)]:
        fits = [(*v, -len(k[0]), k[1]) for k, v in want.items() if set(k[0]) <= set(t)]
        assert (tuple(t) in best) == bool(fits)
        if fits:
            assert best[tuple(t)].label == max(fits)[3]


def test_a_template_of_many_tokens(spark):
    """Forty query names in a third of all URLs are one item; a URL with any of them fits its rules."""
    asked = "&".join(f"n{chr(97 + i // 26)}{chr(97 + i % 26)}=1" for i in range(40))
    urls = [f"http://a{i % 7}.net/x?{asked}" if i % 3 == 0 else f"http://b.org/fr/p{chr(97 + i % 5)}" for i in range(900)]
    urls += [f"http://c.io/?naa=1&z{i}=2" for i in range(3)] + [f"http://d.io/q?{asked}"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    rows = {r.page_id: r for r in urlrules.filter_urls(df, LISTS, support=0.05).collect()}
    assert len(rows) == len(urls) and all(rows[i].verdict == "block" and rows[i].rule is None for i in range(900, 904))
    twins = urlrules.together(spark.createDataFrame([(["a", "b"], "x"), (["a", "b", "c"], "y"), (["c"], None)], "t array<string>, y string"), "t", "y", 0.1)
    assert [(r.token, r.rep) for r in twins.collect()] == [("b", "a")]


def test_rules_count_every_labelled_row(spark):
    n = 150_000
    which = F.when(F.col("id") % 3 == 0, F.array(F.lit("a"))).when(F.col("id") % 3 == 1, F.array(F.lit("b"))).otherwise(F.array(F.lit("c")))
    label = F.when((F.col("id") % 3 == 2) | (F.col("id") % 10 == 0), "block").otherwise("allow")
    df = spark.range(2 * n).select(which.alias("tokens"), label.alias("label"))
    rows = df.groupBy("tokens", "label").count().collect()
    of = Counter()
    for r in rows:
        of[tuple(r.tokens)] += r["count"]
    want = {(*r.tokens, r.label): (r["count"] / of[tuple(r.tokens)], r["count"] / (2 * n)) for r in rows}
    got = {(*r.tokens, r.label): (r.confidence, r.support) for r in urlrules.mine(df, "tokens", "label").collect()}
    assert got.keys() == {k for k, v in want.items() if v[0] >= 0.8} and len(got) == 3
    assert all(got[k] == pytest.approx(want[k]) for k in got)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries(spark, name):
    df = QUERIES[name](spark, SF)
    table = {"op10": "pages", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    assert df.count() >= spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SF).collect(), before.schema)
        assert after.columns == docs.columns
        told, left = dict(texts(before)), dict(texts(after))
        if name == "exact_copies":
            assert set(left) == {k for k, _ in brute.exact(told.items()).values()}
        if name == "near_copies":
            prints = {i: brute.fingerprint(t, 5) for i, t in told.items()}
            assert {k for k in brute.components(prints, 4).values()} >= set(left)
        if name == "mixture":
            assert set(left) == set(told)
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == bag(
        (i, *p) for i, t in texts(before) for p in brute.pieces(TOKENS, t))


def test_trees_learn_from_all_candidates(spark, monkeypatch):
    """Training took 20,000 candidates of 20,000 texts."""
    seen = []

    def held(df, label):
        seen.append(df.count())
        raise InterruptedError

    monkeypatch.setattr(pii, "materialise", held)
    df = spark.range(20500).select(F.col("id").alias("doc_id"), F.concat(F.lit("mail a"), "id", F.lit("@b.org now")).alias("text"))
    with pytest.raises(InterruptedError):
        pii.train(df)
    assert seen == [20500]
