"""Line dedup, winnowing, MinHash groups and packing against plain Python, on a table and on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from labelwright.llm import line_dedup, minhash, packing, queries, winnow
from labelwright.llm.components import components

FOLDER = "/root/testdata/sf0.01"
CASES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "One long line that everyone repeats\nown line of four, quite long"),
    (5, "  one LONG line that everyone repeats \nx"), (6, "ONE long line that everyone repeats"), (7, "x\nx\nx"),
    (8, "ÉTÉ long line with accents é here\n" * 3), (9, "ÉTÉ long line with accents é here"), (10, "été long line with accents é here"),
    (11, "a b c"), (12, "A  b\nc"), (13, "word " * 30_000), (None, "one long line that everyone repeats"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(
        [(d, t, "s", 1, "p", 2) for d, t in CASES], "doc_id long, text string, word string, row int, h1 string, pos int")


def test_line_dedup_table(spark, pairs):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op4_line_dedup(spark, FOLDER).collect()}
    want = {(d, n, x, brute.sha(t)) for d, n, x, t in brute.line_dedup(pairs)}
    assert got == want and sum(x for _, _, x, _ in got) > 0


def test_line_dedup_cases(cases):
    out = line_dedup.drop_repeated_lines(cases, counts=True)
    assert out.columns == [*cases.columns, "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == sorted(brute.line_dedup(CASES), key=str)


def test_line_dedup_repeated_rows(cases):
    out = line_dedup.drop_repeated_lines(cases.union(cases), counts=True)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == sorted(brute.line_dedup(CASES) * 2, key=str)


def test_bitmaps_hold_positions_only(cases):
    rows = line_dedup.drop_bitmaps(cases).collect()
    assert {r.doc: r.words for r in rows} == {4: {0: 1}, 5: {0: 1}, None: {0: 1}}


def test_winnow_table(spark, pairs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in queries.op10_benchmark_decontamination(spark, FOLDER).collect()}
    want = {(d, n, h, len(i), brute.sha(",".join(i))) for d, n, h, i in brute.hits(pairs, items)}
    assert got == want and sum(h for _, _, h, _, _ in got) > 0


def test_winnow_cases(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "dé"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 6, 7, 9, 12, 13, 13, 14, 20, 40, 40])] + [(90, None), (91, ""), (92, "- -")]
    items += [(93, items[12][1]), (12, items[12][1])]
    docs = [(i, text(n)) for i, n in enumerate([0, 1, 2, 5, 12, 13, 14, 30, 60, 400])] + [(50, None), (51, "!"), (52, items[12][1] + " x " + items[13][1].upper())]
    docs += [(53, "x " * 30 + items[11][1] + " y" * 30), (53, "nothing of note"), (None, items[11][1])]
    d = spark.createDataFrame([(i, t, 0, "c") for i, t in docs], "doc_id long, text string, print int, ctx string").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, window int")
    for bits in (winnow.FILTER_BITS, winnow.BUCKET_BITS):
        got = winnow.contamination(d, b, filter_bits=bits).collect()
        want = brute.hits(docs, items)
        assert sorted(((r.doc, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == sorted(want, key=str)
    empty = winnow.contamination(d, b.limit(0)).collect()
    assert len(empty) == len(docs) and all(r.n_hit == 0 for r in empty)
    assert winnow.contamination(d.limit(0), b).count() == 0
    clean = winnow.clean_documents(d, b)
    assert clean.columns == d.columns
    bad = {(x[0], x[1]) for x in want if x[2] > 0 and 20 * x[2] >= x[1]}
    assert clean.count() == sum((x[0], x[1]) not in bad for x in want)


def test_every_shared_window_is_found():
    rng = random.Random(1)
    cache = winnow.WordHashes()
    for _ in range(200):
        shared = [b"%d" % rng.randrange(6) for _ in range(winnow.WINDOW)]
        noise = lambda: [b"%d" % rng.randrange(6) for _ in range(rng.randrange(15))]
        x, y = (set(winnow.fingerprints(cache.of(noise() + shared + noise()), winnow.WINDOW)[0].tolist()) for _ in range(2))
        assert x & y


def test_near_duplicates_table(spark, pairs):
    rows = queries.op7_minhash_near_dedup(spark, FOLDER).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got == brute.near(pairs, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and sum(not r.kept for r in rows) > 0


def test_near_duplicates_cases(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "A\tb"), (6, "b a"), (7, "a b c d"), (8, "a b c d e")]
    # A chain: each text differs a little from the one before, the ends differ a lot.
    for i in range(12):
        docs.append((100 - i, " ".join(base)))
        at = rng.randrange(5, 110)
        base = base[:at] + [f"x{i}", f"y{i}"] + base[at + 2 :]
    for i in range(60):
        docs.append((200 + i, " ".join(f"w{j}" if rng.random() > 0.03 else f"z{i}{j}" for j in range(150))))
    docs += [(400, "word " * 30_000), (401, "word " * 20_000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, rep string, bucket int").repartition(4)
    got = {r.doc: (r.n_shingles, r.component) for r in minhash.near_duplicates(df).collect()}
    assert got == brute.near(docs, 5)
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}


@pytest.mark.parametrize("seed", range(1))
def test_large_groups_around_the_threshold(spark, seed):
    """Copies edited, cut and lengthened so that many pairs of one bucket lie on either side of the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(90)]
    second = [w if rng.random() > 0.05 else f"s{i}" for i, w in enumerate(base)]
    docs = []
    for i in range(160):
        words = list(rng.choice((base, second)))
        kind = i % 4
        if kind < 2:
            share = rng.choice((0.01, 0.03, 0.06))
            words = [w if rng.random() > share else f"e{i}_{j}" for j, w in enumerate(words)]
        elif kind == 2:
            words = words[: len(words) - rng.randrange(1, 40)]
        else:
            words += [f"t{rng.randrange(3)}_{j}" for j in range(rng.randrange(1, 40))]
        docs.append((1000 - i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute.near(docs, 4)
    assert {r.doc: (r.n_shingles, r.component) for r in minhash.near_duplicates(df, words=4).collect()} == want
    assert 1 < len({c for _, c in want.values()}) < 120


def test_near_duplicates_of_nothing(spark, docs):
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f")] * 2 + [(None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc, r.n_shingles, r.component) for r in minhash.near_duplicates(twice).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (None, 0, None), (None, 2, 1)]


def test_signature_estimates_similarity():
    rng = random.Random(2)
    one = [rng.getrandbits(64) for _ in range(900)]
    two = one[:800] + [rng.getrandbits(64) for _ in range(100)]
    width = minhash.BANDS * minhash.ROWS
    import numpy as np

    x, y = (minhash.signature(np.array(s, np.uint64), width) for s in (one, two))
    assert abs((x == y).mean() - 0.8) < 0.13


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing_table(spark, pairs):
    rows = [tuple(r) for r in queries.op1_best_fit_packing(spark, FOLDER).collect()]
    from tokenizers import Tokenizer
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    used = brute.check_packing(pairs, rows, lambda t: plain.encode(t, add_special_tokens=False).ids, packing.CAPACITY)
    total = sum(r[3] for r in rows)
    assert used <= -(-total // packing.CAPACITY) * 1.005 + 1


def test_packing_cases(spark):
    words = lambda: lambda text: [len(w) for w in text.split()]
    docs = [(1, None), (2, ""), (3, "a " * 15), (4, "a " * 16), (5, "a " * 31), (6, "a " * 32), (7, "a " * 100), (8, "bb"), (9, "  ")]
    docs += [(100 + i, "a " * (i % 15)) for i in range(200)]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, length string, task int").repartition(5)
    rows = [tuple(r) for r in packing.pack(df, words, capacity=16).collect()]
    brute.check_packing(docs, rows, words(), 16)
    assert packing.pack(df.limit(0), words, capacity=16).count() == 0
    both = packing.pack(df.union(df), words, capacity=16)
    assert both.count() == 2 * len(rows)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_whole_and_close_to_the_bound(seed):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(20_000):
        n = min(2048, max(1, int(rng.lognormvariate(6, 1.2))))
        histogram[n] = histogram.get(n, 0) + 1
    got = {}
    for lengths, times in (configs := packing.plan(histogram, rounds=60)):
        assert sum(lengths) <= 2048 and times > 0
        for n in lengths:
            got[n] = got.get(n, 0) + times
    assert got == histogram
    bound = -(-sum(n * c for n, c in histogram.items()) // 2048)
    assert sum(t for _, t in configs) <= bound * 1.01 + 1


def test_both_readers_of_the_vocabulary_agree():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    fast = queries.public_encoder()
    rng = random.Random(0)
    chars = [chr(c) for c in [*range(0, 0x80), *range(0xA1, 0x250), *range(0x2010, 0x2020)]] + ["<|endoftext|>", "漢", "\u0085", " ", "\U0001f600", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(chars if rng.random() < 0.5 else " aeiou'nts\n1") for _ in range(rng.randrange(40)))
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids, repr(text)
    for c in chars:
        for text in (c, f"a{c}b", f" {c} {c}{c}", f"1{c}\n{c}", f"{c}'s {c}'ll"):
            assert fast(text) == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_one_id_with_two_texts(spark):
    """Of two rows that share an id only the copy goes."""
    copy, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, copy), (2, copy), (2, other)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.keep_first(df).collect())) == [(1, copy), (2, other)]


def test_prefixes_lose_no_link(spark):
    """Many texts around one template, most unlike it and linked with a few others only by what they add."""
    rng = random.Random(11)
    template = [f"w{i}" for i in range(150)]
    rows = []
    for family in range(12):
        edits = {rng.randrange(150): f"f{family}-{i}" for i in range(rng.randrange(6, 12))}
        tail = [f"t{family}-{i}" for i in range(rng.randrange(0, 25))]
        for member in range(6):
            own = edits | {rng.randrange(150): f"m{family}-{member}-{i}" for i in range(rng.randrange(0, 4))}
            rows.append((len(rows), " ".join([own.get(i, w) for i, w in enumerate(template)] + tail)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc: (r.n_shingles, r.component) for r in minhash.near_duplicates(df, words=4, bands=60, rows=2).collect()}
    want = brute.near(rows, 4)
    assert got == want and 1 < len({c for _, c in want.values()}) < len(rows)


def test_pairs_of_a_star_leave_its_task_as_few_links(spark):
    """Members of one star, alike but unlike the pivot: fewer links than members come out, and join what all pairs would."""
    rng = random.Random(5)
    pivot, rows, sets = set(range(100)), [], {}
    for b in range(1, 41):
        lacked, added = set(range(35)), {1000 + i for i in range(35)}
        for _ in range(rng.randrange(9)):
            lacked.add(rng.randrange(35, 100)), added.add(rng.randrange(2000, 2200))
        sets[b] = pivot - lacked | added
        rows.append((0, b, b, b, 100, sorted(lacked), sorted(added)))
    kind = "a long, b long, home long, part long, size_a long, lacked array<long>, added array<long>"
    got = [tuple(r) for r in minhash._within(spark.createDataFrame(rows, kind), 0.8).collect()]
    linked = [(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    assert len(got) < len(sets) < len(linked) and {tuple(sorted(p)) for p in got} <= set(linked)
    both = [{r.node: r.component for r in components(spark.createDataFrame(e, "a long, b long")).collect()} for e in (got, linked)]
    assert both[0] == both[1]


def _star(rng, pivot, families, members):
    """Rows of one star for ``minhash._within``, and the members' sets: families unlike each other around a pivot, some linked with it."""
    rows, sets = [], {}
    for b in range(1, members + 1):
        family = rng.randrange(families)
        gone = 0 if family == 0 else 20 + family % 7
        lacked = set(range(gone)) | {rng.randrange(len(pivot)) for _ in range(rng.randrange(9))}
        added = {1000 * family + i for i in range(1000, 1000 + gone)} | {90_000 + rng.randrange(40) for _ in range(rng.randrange(9))}
        sets[b] = pivot - lacked | added
        part = 0 if 100 * len(pivot & sets[b]) >= 80 * len(pivot | sets[b]) else b
        rows.append((0, b, b, part, len(pivot), sorted(lacked), sorted(added)))
    return rows, sets


def test_a_heavy_star_is_cut_into_blocks_that_lose_no_link(spark):
    rows, sets = _star(random.Random(6), set(range(100)), 9, 120)
    stars = spark.createDataFrame(rows, "a long, b long, home long, part long, size_a long, lacked array<long>, added array<long>")
    known = [(0, r[1]) for r in rows if r[3] == 0]
    linked = [(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    for weight in (900, 5000, minhash.WEIGHT):
        got = [tuple(r) for r in minhash._within(stars, 0.8, weight).collect()]
        assert {tuple(sorted(p)) for p in got} <= set(linked)
        both = [{r.node: r.component for r in components(spark.createDataFrame(known + e, "a long, b long")).collect()} for e in (got, linked)]
        assert both[0] == both[1] and 1 < len(set(both[0].values())) < 60


def test_unlike_members_of_a_large_star_make_no_pairs(spark, monkeypatch):
    """Texts that hold some of the same lines each, most pairs below the threshold: tasks get rows of members, not pairs of them."""
    rng, handed = random.Random(8), []
    lines = [" ".join(f"l{i}w{j}" for j in range(12)) for i in range(14)]
    docs = [(n, " ".join(x for x in lines if rng.random() < 0.6)) for n in range(330)]
    pairs_of = minhash.compared

    def counted(pairs, *args):
        handed.append(pairs.count())
        return pairs_of(pairs, *args)

    monkeypatch.setattr(minhash, "compared", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc: (r.n_shingles, r.component) for r in minhash.near_duplicates(df).collect()}
    assert got == brute.near(docs, 5) and len({c for _, c in got.values()}) > 60
    # A document is a member of 28 stars at most.
    assert sum(handed) <= 28 * len(docs)
    rows, _ = _star(rng, set(range(100)), 40, 2000)
    stars = spark.createDataFrame(rows, "a long, b long, home long, part long, size_a long, lacked array<long>, added array<long>")
    dealt = minhash._dealt(stars, 80, minhash.WEIGHT)
    weights = dealt.groupBy("a", "meeting").agg(F.sum(F.size("lacked") + F.size("added") + minhash.MEMBER).alias("w"))
    assert dealt.count() < 4 * len(rows) and weights.where(F.col("w") > 2.5 * minhash.WEIGHT).isEmpty()
