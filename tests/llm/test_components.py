"""Connected components of links, in one task and by steps, against a plain version."""

from __future__ import annotations

import random

from lexloom.llm.components import components


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        if u is not None and v is not None:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return sorted((x, find(x)) for x in list(root) if find(x) != x)


def test_components(spark):
    rng = random.Random(8)
    chain = list(range(200))
    rng.shuffle(chain)
    star = [(5000, 1000 + k) for k in range(300)]
    loose = [(rng.randrange(10_000, 10_400), rng.randrange(10_000, 10_400)) for _ in range(250)]
    links = [*zip(chain, chain[1:]), *star, *loose, (-7, 3), (7, 7), (None, 1), (2, None), (2**62, -(2**62))]
    df = spark.createDataFrame(links, "u long, v long")
    for most in (1 << 20, 100, 0):
        assert sorted(map(tuple, components(df, most).collect())) == plain(links)
    assert components(df.where("u = v")).count() == 0


def test_few_links_take_few_jobs(spark):
    """A long chain was joined by tens of jobs, each over all shuffle partitions."""
    df = spark.range(400).selectExpr("id as u", "id + 1 as v")
    spark.sparkContext.setJobGroup("components", "few links")
    try:
        assert {r["component"] for r in components(df).collect()} == {0}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 8
    finally:
        spark.sparkContext._jsc.clearJobGroup()
