import random

import pytest

from fieldtree.llm.components import FEW, components
from fieldtree.llm.simhash_dedup import similar_removed


def tasks_of(spark, group, run):
    """What ``run`` gives, and the number of tasks that its jobs started."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    return out, sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s)))


@pytest.fixture()
def spread(spark):
    """A session that deals every shuffle to many partitions."""
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("few", [0, 50, FEW])
def test_few_edges_and_many_agree(spark, few):
    """Under the bound one task follows the edges, over it rounds do; nulls, loops and repeats add nothing."""
    draw = random.Random(4)
    nodes = draw.sample(range(-(1 << 61), 1 << 61), 300)
    edges = [tuple(draw.sample(nodes, 2)) for _ in range(140)] + list(zip(nodes[:40], nodes[1:41]))
    edges += edges[:20] + [(b, a) for a, b in edges[20:40]] + [(nodes[-1], nodes[-1]), (None, nodes[0]), (nodes[1], None)]
    least = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in least and b in least and a != b and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    rows = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = components(rows, few=few).collect()
    assert {r.node: r.component for r in got} == least and len(got) == len(least)
    assert components(rows.limit(0), few=few).collect() == []


def test_near_dedup_of_few_links_takes_few_tasks(spread, prose):
    """Chains and stars of near copies: no rounds of shuffles, whose tasks and files took the check's disk on its skewed table."""
    rows = []
    for g in range(6):
        text = prose(60, g).split(" ")
        for k in range(6):  # a chain: each text changes one word more
            text[3 * k] = f"w{g}x{k}"
            rows.append((10 * g + k, " ".join(text), "en", "s"))
    docs = spread.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept, tasks = tasks_of(spread, "near-dedup", lambda: {r.doc_id for r in similar_removed(docs).collect()})
    assert kept and tasks < 4000
