"""Targets against chunks: both tries, with and without a rule, against a plain loop over chunks in order."""

import random

from labelwright.operators.checks import validate_catalogue

TARGET = "check_id string, requirement_name string, rule string, sub_rule string, clause string, page int"
CHUNK = "chunk_id string, insert_ord long, rule string, sub_rule string, clause string, page_start int, page_end int, text string"


def loop(target, chunks):
    """(tier, chunk_id) by reading the chunks one after the other."""
    _, _, rule, sub, clause, page = target
    clean = lambda x: (x.strip() or None) if x else None
    rule, sub, clause = map(clean, (rule, sub, clause))
    fits = lambda a, b: not a or not b or a in b or b in a
    for chunk_id, _, c_rule, c_sub, c_clause, start, end, _ in sorted(chunks, key=lambda c: c[1]):
        if rule and clean(c_rule) != rule or not fits(sub, clean(c_sub)) or not fits(clause, clean(c_clause)):
            continue
        if page and start and not (end is not None and start <= page <= end or abs(start - page) <= 2):
            continue
        return 1, chunk_id
    for chunk_id, _, c_rule, *_ in sorted(chunks, key=lambda c: c[1]):
        if rule and clean(c_rule) == rule:
            return 2, chunk_id
    return None


def test_targets_against_a_loop(spark):
    rng = random.Random(3)
    subs, clauses = [None, "", "6(1)", "6(1)(a)", "(1)", "7"], [None, "a", "ab", " b "]
    chunks = [(f"c{i}", 1000 - i, rng.choice([None, "6", "7", " 8 "]), rng.choice(subs), rng.choice(clauses),
               rng.choice([None, 0, 3, 9, 20]), rng.choice([None, 0, 5, 22, 40]), rng.choice([None, "", "net weight of it", "x" * 50])) for i in range(40)]
    targets = [(f"t{i}", rng.choice(["Net Quantity", "MRP"]), rng.choice([None, None, "6", "7", "8", "99"]), rng.choice([*subs, "11", "zz"]), rng.choice(clauses),
                rng.choice([None, 0, 1, 4, 7, 21, 39, 90])) for i in range(150)]
    for n in (1, 7, 40):
        got = {r.check_id: r for r in validate_catalogue(spark.createDataFrame(targets, TARGET), spark.createDataFrame(chunks[:n], CHUNK)).collect()}
        assert len(got) == len(targets)
        for t in targets:
            found, row = loop(t, chunks[:n]), got[t[0]]
            assert (None if row.matched_chunk_id is None else (row.tier, row.matched_chunk_id)) == found, t
            assert (row.status == "NOT_FOUND") == (found is None)


def test_no_chunks_and_no_targets(spark):
    target = [("t", "MRP", None, "6(1)", None, 5)]
    assert validate_catalogue(spark.createDataFrame(target, TARGET), spark.createDataFrame([], CHUNK)).first().status == "NOT_FOUND"
    assert validate_catalogue(spark.createDataFrame([], TARGET), spark.createDataFrame([], CHUNK)).count() == 0
    repeated = [("c", 1, "6", "6(1)", None, 5, 5, "net weight"), ("c", 1, "6", "6(1)", None, 5, 5, "net weight")]
    assert validate_catalogue(spark.createDataFrame(target, TARGET), spark.createDataFrame(repeated, CHUNK)).first().matched_chunk_id == "c"
