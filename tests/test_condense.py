"""Groups by condensation against plain search."""

import random

from plotlink.operators import condense


def search(ids, links):
    follow = {}
    for a, b in links:
        follow.setdefault(a, set()).add(b)
    out = {}
    for start in ids:
        seen, todo = {start}, [start]
        while todo:
            for n in follow.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out[start] = seen
    return out


def tables(spark, ids, links):
    c = spark.createDataFrame([(i,) for i in ids], "id long")
    return c, spark.createDataFrame(links, "src long, dst long")


def test_one_way_and_mutual_links(spark):
    rng = random.Random(6)
    ids = list(range(60))
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    links += [(a, b) for a, b in zip(range(0, 9), range(1, 10), strict=True)] + [(b, a) for a, b in zip(range(0, 9), range(1, 10), strict=True)] + [(3, 3), (0, 1)]
    c, e = tables(spark, ids, links)
    members, takes = condense.groups(c, e)
    want = search(ids, links)
    got = {}
    for r in condense.moves_with(members, takes, c.withColumnRenamed("id", "start")).collect():
        got.setdefault(r.start, []).append(r.node)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    grp = {r.id: r.grp for r in members.collect()}
    assert all(grp[i] == min(j for j in want[i] if i in want[j]) for i in ids)


def test_a_long_row_of_houses(spark):
    n = 5000
    links = [(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)]
    c, e = tables(spark, range(n + 1), links)
    members, takes = condense.groups(c, e)
    rows = members.collect()
    assert len(rows) == n + 1 and {r.grp for r in rows} == {0, n} and takes.isEmpty()
    assert condense.moves_with(members, takes, spark.createDataFrame([(17,)], "start long")).count() == n


def test_no_links(spark):
    c, e = tables(spark, [1, 2], [])
    members, takes = condense.groups(c, e)
    assert {(r.id, r.grp) for r in members.collect()} == {(1, 1), (2, 2)} and takes.isEmpty()
