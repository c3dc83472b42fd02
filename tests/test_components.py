"""Connected components against union-find on random graphs, chains and stars."""

import random
import time

import pytest

from epochal.operators.components import components


def union_find(links):
    root = {v: v for e in links for v in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in root}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(2)
    links = {"random": [(rng.randrange(80), rng.randrange(80, 160)) for _ in range(90)], "chain": [(i, i + 1) for i in rng.sample(range(40), 40)], "star": [(7, i) for i in range(8, 40)] + [(3, 20)], "none": []}[kind]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.v: r.root for r in got} == union_find(links) and len(got) == len(union_find(links))


def test_tables_leave_no_shuffle_files(spark):
    """What was shuffled for a written table goes with the write; the setting is as before."""
    from epochal.storage import saved

    kept = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = kept()
    out = saved(spark.range(1000).repartition(7, "id").groupBy("id").count(), "shuffled")
    deadline = time.time() + 20
    while kept() > before and time.time() < deadline:
        time.sleep(0.2)
    assert kept() <= before and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
