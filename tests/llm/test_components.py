import random

import pytest

c = pytest.importorskip("loomspark.llm.components")


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(200)],  # a chain
    [(0, i) for i in range(1, 300)] + [(999, i) for i in range(300, 400)] + [(299, 999)],  # two stars, joined
    [(random.Random(k).randrange(400), random.Random(-k).randrange(400)) for k in range(1, 260)],
    [],
])
def test_equals_union_find(spark, pairs):
    df = spark.createDataFrame(pairs + pairs[:3] + [(5, 5), (None, 3), (3, None)], "x bigint, y bigint")
    got = {tuple(r) for r in c.star_components(df, "x", "y").collect()}
    assert got == brute([p for p in pairs if p[0] != p[1]])


def test_latest_decision_counts(spark):
    rows = [(1, 2, " Match", 1), (2, 1, "nonmatch", 2), (3, 4, "MATCH ", 1), (4, 3, "match", 0), (5, 6, None, 9), (6, 5, "match", 1), (7, 99, "match", 1), (7, 7, "match", 1), (8, None, "match", 1)]
    m = spark.createDataFrame(rows, "left_id bigint, right_id bigint, decision string, t int").selectExpr("left_id", "right_id", "decision", "timestamp_seconds(t) AS decided_at", "'x' AS a")
    known = spark.createDataFrame([(i,) for i in range(1, 9)], "mention_id bigint")
    assert sorted(map(tuple, c.match_groups(m, known).collect())) == [(3, 3), (3, 4)]
    assert sorted(map(tuple, c.full_assignment(c.match_groups(m, known), known).collect())) == [(1, 1), (2, 2), (3, 3), (3, 4), (5, 5), (6, 6), (7, 7), (8, 8)]
    assert c.match_groups(m.limit(0), known.limit(0)).count() == 0


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b")], "x string, y string")
    assert {tuple(r) for r in c.star_components(df, "x", "y").collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_groups_at_rest_leave_the_work_whole(spark):
    """Many small random graphs side by side, so that groups come to rest in different rounds."""
    rng = random.Random(12)
    edges = []
    for g in range(60):
        n = rng.randrange(2, 25)
        own = [(i, i + 1) for i in range(n)] if g % 6 == 0 else [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))]
        edges += [(100 * g + a, 100 * g + b) for a, b in own]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {tuple(r) for r in c.star_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {(x, root(x)) for x in linked}
