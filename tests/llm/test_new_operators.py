"""Passages, alignment and whitening against plain Python and numpy, on whole tables and hand-made cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

import brute
from labelwright.llm import alignment, factors, queries, whitening
from labelwright.llm.common import small_batches

FOLDER = "/root/testdata/sf0.01"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def test_passages_table(spark):
    got = {tuple(r) for r in queries.op11_substring_dedup(spark, FOLDER).collect()}
    want = {(d, n, gone, brute.sha(kept)) for d, n, gone, kept in brute.passages(documents(spark), 50)}
    assert got == want and sum(r[2] for r in got) > 0


def passage_cases(seed: int) -> list:
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3 + seed)}" for _ in range(300)]
    rows = []
    for i in range(80):
        a = rng.randrange(200)
        shared = base[a : a + rng.randrange(20, 100)]
        if rng.random() < 0.4:
            shared[rng.randrange(len(shared))] = "other"
        noise = [[f"{c}{rng.randrange(9)}" for _ in range(rng.randrange(20))] for c in "pq"]
        rows.append((rng.choice([i, i, i // 2]), " \t".join(noise[0] + shared + noise[1])))
    return rows + [(500, None), (501, ""), (502, " \n"), rows[7], (503, rows[7][1]), (None, rows[7][1]), (600, "w0 " * 5_000), (601, "w0 " * 4_000)]


@pytest.mark.parametrize("window, gram", [(50, 12), (10, 3), (6, 6), (4, 1)])
def test_passages_cases(spark, window, gram):
    rows = passage_cases(window % 3)
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, key int, spans string").repartition(5)
    out = factors.without_repeats(df, window=window, gram=gram, bits=1 << 15, counts=True)
    assert out.columns == [*df.columns, "n_words", "n_removed"]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()), key=str)
    assert got == sorted(brute.passages(rows, window), key=str) and sum(r[2] for r in got) > 0


def test_one_passage_over_many_ranges(spark):
    """One anchor in every document: its blocks lie in several ranges, and windows meet across them."""
    shared = [f"s{i}" for i in range(20)]
    rng = random.Random(2)
    rows = [(i, " ".join([f"a{i}"] + shared[: rng.randrange(12, 21)] + [f"b{rng.randrange(40)}"])) for i in range(300)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = factors.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=12, gram=4, counts=True)
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(brute.passages(rows, 12))


def test_passages_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert factors.without_repeats(empty, counts=True).count() == 0


def test_factors_are_longest_and_meet_at_their_ends():
    block = factors.Block()
    text = b"a b c d e f g h".split()
    hashes = lambda words: [hash(tuple(words[i : i + 3])) for i in range(len(words) - 2)]
    assert block.factors(b" ".join(text), text, hashes(text), 3) == ([], [0, 1, 2, 3, 4, 5])
    block.admit()
    words = b"x b c d e y e f g h".split()
    assert block.factors(b" ".join(words), words, hashes(words), 3) == ([(1, 5), (6, 10)], [0, 3, 4, 5])


@pytest.fixture(scope="module")
def readers():
    return queries.public_readers()


def test_alignment_table(spark, readers):
    got = {tuple(r) for r in queries.op12_tokenizer_alignment(spark, FOLDER).collect()}
    assert got == set(aligned_by_hand(documents(spark))) and len(got) > 0


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "naïve café, 中文 и кириллица 👍🏽"), (6, "<|endoftext|> and <s> </s> <unk>"), (7, "two  spaces\n\n"),
    (8, "ﬁ ligature ① Å"), (9, "▁mark"), (9, "the same id"), (None, "no id"), (10, "tab\tand\x00null\x1c"), (4, "a"), (11, "word " * 20_000), (12, "x" * 5_000),
]


def test_alignment_cases(spark):
    df = spark.createDataFrame([(d, t, 1, "g") for d, t in ODD], "doc_id long, text string, a int, link_a string").repartition(3)
    got = alignment.alignment(df, queries.public_readers)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(aligned_by_hand(ODD), key=str)
    assert alignment.alignment(df.limit(0), queries.public_readers).count() == 0
    whole = {r.doc: r for r in alignment.groups(df.where("doc_id = 4"), queries.public_readers).collect()}
    assert len(whole[4].a) == whole[4].ends_a[-1] + 1 and len(whole[4].b) == whole[4].ends_b[-1] + 1


def aligned_by_hand(rows):
    """Offsets by scanning, with the tokenizers' own files."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = alignment.byte_alphabet()

    def piece(i):
        name = second.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if second.is_byte(i) else name.replace("▁", " ").encode()

    seen, counts = [], Counter()
    for doc, text in rows:
        a, b, cuts, links = [], [], [], []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            parts_a, parts_b = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a], [piece(i) for i in b]
            if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
                a, b, parts_a, parts_b = [], [], [], []
            ends_a, ends_b = np.cumsum([len(x) for x in parts_a]), np.cumsum([len(x) for x in parts_b])
            i = j = at_a = at_b = 0
            while i < len(a) and j < len(b):
                if ends_a[i] == ends_b[j]:
                    cuts.append(f"{','.join(map(str, a[at_a : i + 1]))}|{','.join(map(str, b[at_b : j + 1]))}")
                    links.append((a[i], b[j]))
                    i, j = i + 1, j + 1
                    at_a, at_b = i, j
                elif ends_a[i] < ends_b[j]:
                    i += 1
                else:
                    j += 1
        counts.update(links)
        seen.append((doc, len(a), len(b), cuts, links))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (doc, n_a, n_b, len(cuts), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(cuts).encode()).hexdigest() if cuts else "")
        for doc, n_a, n_b, cuts, links in seen]


def test_pairs_are_fewer_than_bytes(spark, readers):
    found = alignment.groups(spark.createDataFrame(ODD, "doc_id long, text string"), queries.public_readers, digest=True)
    assert 0 < alignment.link_counts(found).count() <= alignment.pair_bound(*readers) < 600_000
    a, b = (r.bytes_of for r in readers)
    for row in found.collect():
        assert all(a[i].endswith(b[j]) or b[j].endswith(a[i]) for i, j in zip(row.link_a, row.link_b))


def whitened_by_hand(rows, most=16):
    """Eigenvectors of the covariance of the distinct whole vectors, one row per id and component."""
    kept = [(d, v) for d, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    middle = fit - total / n
    values, vectors = np.linalg.eigh(middle.T @ middle / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(most, int((values > 1e-15 * values[0] * len(values)).sum()))
    z = (x - total / n) @ vectors[:, :rank] / np.sqrt(values[:rank])
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return [d for d, _ in kept], n, deviation, z, values[:rank] / values.sum()


def check_whitening(rows, got):
    ids, n, deviation, z, explained = whitened_by_hand(rows)
    k = len(explained)
    assert len(got) == len(ids) * k and {r.n for r in got} == {n}
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    own = np.array([[r.whitened for r in sorted(by_id[d], key=lambda r: r.component)[:: len(by_id[d]) // k]] for d in ids])
    assert {(r.vec_id, r.deviation) for r in got} == set(zip(ids, deviation))
    assert np.abs(own * np.sign((own * z).sum(axis=0)) - z).max() < 1e-6
    assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)


def test_whitening_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check_whitening(rows, queries.op13_embedding_whitening(spark, FOLDER).collect())


def test_whitening_cases(spark, tmp_path):
    """Constant and repeated entries, copies, unusable vectors, clashing names, a column of another length."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in (a, 2 * a, 0.25, b, c)]) for i, (a, b, c) in enumerate(np.round(rng.normal(size=(60, 3)) * 64) / 64)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, []), (104, [1.0, None, 0.0, 0.0, 0.0]), (105, [float("nan")] * 5), (106, [float("inf")] * 5)]
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("x", T.StringType())])
    folder = str(tmp_path)
    spark.createDataFrame([(d, v, "x") for d, v in [*rows, (107, [1.0, 2.0])]], kind).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    check_whitening(rows, queries.op13_embedding_whitening(spark, folder).collect())


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<double>"
    empty = spark.createDataFrame([], kind)
    assert whitening.whitened(empty, whitening.train(empty)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)
    model = whitening.train(one)
    assert [(r.id, r.deviation, r.whitened) for r in whitening.whitened(one, model).orderBy("id").collect()] == [(1, 0, []), (2, 0, [])]
    assert model.n == 1 and model.identity_error is None
    large = spark.createDataFrame([(1, [0.0]), (2, [2.0**50])], kind)
    # (2 x - S)^2 is 2**112: no long holds it.
    assert [r.deviation for r in whitening.whitened(large, whitening.train(large)).collect()] == [None, None]


def test_shifted_factors_survive_bad_condition():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 6)) @ np.diag([1, 1e-3, 1e-6, 1e-8, 1, 1]) @ rng.normal(size=(6, 6))

    def grams(found):
        q = a
        for r in found:
            q = whitening.solved(q, r)
        return q.T @ q

    found = whitening.triangular_factors(grams, *a.shape)
    product = np.eye(6)
    for r in found:
        product = r @ product
    assert len(found) > 1 and np.allclose(np.tril(product, -1), 0)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(np.linalg.svd(product, compute_uv=False), want, rtol=1e-5)


def test_groups_are_written_as_ids():
    found = alignment.Aligned(*(np.array(x, np.int32) for x in ([7, 10, 0, 123], [99, 5, 6, 1], [1, 3], [0, 3])))
    assert alignment.written(found, alignment.names_of(124)) == b"7,10|99;0,123|5,6,1"
    assert alignment.written(alignment.NOTHING, alignment.names_of(124)) == b""


def test_alignment_leaves_no_large_batches(spark):
    """Rows of links are read in small batches: none are left to the batch size of whoever reads the result."""
    seen = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = alignment.alignment(spark.createDataFrame(ODD, "doc_id long, text string"), queries.public_readers)
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == seen


def test_links_are_counted_across_waiting_batches(spark):
    rows = [([i % 3, 1], [i % 2, 1]) for i in range(1200)]
    links = spark.createDataFrame(rows, "link_a array<int>, link_b array<int>").coalesce(1)
    want = Counter(a << 32 | b for x, y in rows for a, b in zip(x, y))
    with small_batches(spark):
        assert dict(map(tuple, alignment.link_counts(links).collect())) == want


@pytest.mark.parametrize("window, gram, most", [(50, 12, 1), (10, 3, 2), (4, 1, 1)])
def test_passages_of_refined_groups(spark, window, gram, most):
    """Anchors with more classes than a task holds are halved until few meet, and lose no window."""
    rows = passage_cases(window % 3)
    out = factors.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=window, gram=gram, counts=True, most=most)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()), key=str)
    assert got == sorted(brute.passages(rows, window), key=str) and sum(r[2] for r in got) > 0


def test_one_passage_in_many_contexts_hands_on_few_rows(spark):
    """A passage in every document, among words of its own: pieces that meet nobody go, so few are left to be parsed."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(14)]
    rows = [(i, " ".join([f"a{i}-{j}" for j in range(12)] + shared + [f"b{i}-{j}" for j in range(12)])) for i in range(200)]
    rows += [(300 + i, " ".join([f"x{rng.randrange(2)}" for _ in range(6)] + shared[: rng.randrange(11, 15)] + ["y", "z"])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = factors.without_repeats(docs, window=12, gram=4, counts=True, most=8)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect())
    assert got == sorted(brute.passages(rows, 12))
    spans = factors.repeated_spans(docs.selectExpr("doc_id AS doc", "doc_id AS key", "text"), 12, 4, most=8)
    assert spans.count() == sum(r[2] > 0 for r in got) > 200
