"""The range index against all pairs, and what it looks at in one long file."""

import random

import pytest

from lodestrata.operators import intervals as I

LINES = "key string, start_line long, end_line long, id long"


def made(rng, n, lines, keys=3):
    """Ranges of all lengths; some the wrong way round, of a whole file, or without lines."""
    out = []
    for i in range(n):
        a = rng.randrange(1, lines)
        b = a + rng.choice([0, 1, 2, 7, 8, 9, 63, 64, 65, rng.randrange(lines)])
        out.append((f"k{rng.randrange(keys)}", *rng.choice([(a, b)] * 8 + [(b, a), (1, I.WHOLE_FILE), (None, b), (a, None)]), i))
    return [*out, (None, 1, 5, n)]


def overlap(a, b):
    return None not in (a[0], *a[1:3], *b[1:3]) and a[0] == b[0] and a[1] <= b[2] and a[2] >= b[1]


@pytest.mark.parametrize(("seed", "n", "lines"), [(1, 120, 40), (2, 150, 1000), (3, 80, 5), (4, 0, 9)])
def test_meeting_is_all_pairs(spark, seed, n, lines):
    rng = random.Random(seed)
    a, b = made(rng, n, lines), made(rng, n, lines)
    left, right = spark.createDataFrame(a, LINES), spark.createDataFrame(b, LINES)
    got = [(r.r.id, r.s.id) for r in I.meeting(left, right, "key").collect()]
    want = {(x[3], y[3]) for x in a for y in b if overlap(x, y)}
    assert len(got) == len(set(got)) and set(got) == want
    whole = [(r.r.id, r.s and r.s.id) for r in I.overlapping(left, right, "key", "id").collect()]
    assert set(whole) == want | {(x[3], None) for x in a if x[3] not in {i for i, _ in want}}


@pytest.mark.parametrize(("seed", "lines"), [(5, 30), (6, 800)])
def test_innermost_is_the_tightest_of_all(spark, seed, lines):
    rng = random.Random(seed)
    refs, spans = ([x for x in made(rng, 150, lines) if x[1] is None or x[2] is None or x[1] <= x[2]] for _ in "ab")
    got = {r.id: (r.span_id, r.span) for r in I.innermost(spark.createDataFrame(refs, LINES), spark.createDataFrame(spans, LINES).withColumnRenamed("id", "span_id"), "key", "id", "span_id").collect()}
    for r in refs:
        inside = [(s[2] - s[1], s[1], s[3]) for s in spans if None not in (*r[:3], *s[:3]) and s[0] == r[0] and s[1] <= r[1] and s[2] >= r[2]]
        best = min(inside, default=None)
        assert got[r[3]] == ((best[2], best[0]) if best else (None, None))


def test_one_file_with_100000_references(spark):
    """What is looked at grows with the rows, and no bucket but those of the few longest symbols has more than a part of them."""
    looked = []
    for n in (10_000, 100_000):
        refs = spark.range(n).selectExpr("'f' AS key", "id * 3 + 1 AS start_line", "id * 3 + 1 AS end_line", "id")
        # classes of 900 lines with methods of 30 lines, and one symbol around everything
        spans = spark.range(n // 10).selectExpr("'f' AS key", "id * 30 + 1 AS start_line", "id * 30 + 30 AS end_line", "id AS span_id")
        spans = spans.unionByName(spark.range(n // 300).selectExpr("'f' AS key", "id * 900 + 1 AS start_line", "id * 900 + 900 AS end_line", "id + 1000000 AS span_id"))
        spans = spans.unionByName(spark.sql(f"SELECT 'f' AS key, 1L AS start_line, {3 * n}L AS end_line, -1L AS span_id"))
        met = I.looked_up(refs, spans, "key")
        places = [r["count"] for r in met.groupBy("at", "b").count().filter("at <= 2 * 12").collect()]
        looked.append(met.count())
        assert looked[-1] <= 12 * n and max(places) <= max(n / 10, 12 * 4096)
        out = I.innermost(refs, spans, "key", "id", "span_id")
        assert out.filter("span_id != floor((id * 3) / 30)").count() == 0 and out.count() == n
    assert looked[1] <= 12 * looked[0]
