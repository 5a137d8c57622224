"""The orientation decision, stage by stage."""

import pytest

from labelwright.operators.orientation import probe_scores, turns

# (words, confident, score) at 0, 90, 180 and 270 degrees, and the turn that follows.
CASES = [
    ((4, 10, 20.0), (0, 0, 99.0), None, None, 0),
    ((4, 9, 20.0), (0, 0, 26.1), None, (0, 0, 90.0), 90),
    ((4, 9, 20.0), (0, 0, 26.0), None, (0, 0, 26.1), 270),
    ((0, 0, 5.0), (0, 0, 15.0), (0, 0, 15.1), (0, 0, 15.0), 180),
    ((0, 0, 9.0), None, (0, 0, 15.1), (0, 0, 15.1), 270),
    ((0, 0, 10.0), None, (0, 0, 50.0), None, 0),
    ((0, 0, 5.0), (0, 0, 40.0), (0, 0, 50.0), (0, 0, 40.0), 90),
    (None, None, (0, 0, 15.0), None, 0),
    (None, None, None, (1, 1, 16.0), 270),
]


@pytest.mark.parametrize("shuffled", [False, True])
def test_turns(spark, shuffled):
    rows = [
        (i, angle, *probe) for i, case in enumerate(CASES) for angle, probe in zip((0, 90, 180, 270), case[:4]) if probe is not None]
    df = spark.createDataFrame(rows[::-1] if shuffled else rows, "image_id int, angle int, words int, confident long, score double")
    assert {r.image_id: r.turn for r in turns(df.repartition(3)).collect()} == {i: c[4] for i, c in enumerate(CASES)}


def test_probes(spark):
    rows = [(1, 0, 2, "WT", 0.7), (1, 0, 1, "net", 0.69), (1, 0, 3, None, None), (1, 90, 1, "best", 0.9), (1, 90, 2, "before", 0.9)]
    got = {r.angle: (r.words, r.confident, round(r.score, 6)) for r in probe_scores(
        spark.createDataFrame(rows, "image_id int, angle int, block_ord int, text string, confidence double")).collect()}
    assert got == {0: (2, 1, round(21 + 5 * 1.39 / 3, 6)), 90: (1, 2, 16.5)}
