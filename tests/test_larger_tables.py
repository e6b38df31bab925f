"""Queries against their SQL where ids are larger, or links longer, than in the given tables."""

import oracle
from quorana.operators import chain
from quorana.plans import registry


def differs(spark, sf, name):
    return oracle.difference(registry.queries()[name](spark, str(sf)), oracle.connection(str(sf)), registry.oracle_sql()[name])


def test_marks_of_ids_beyond_32_bits_and_of_null_texts(spark, tmp_path):
    rows = [(0, "none"), (542373, "eight digits"), (542374, "nine digits"), (1000002, "nine digits, odd"), (90000000001, "more"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    assert differs(spark, tmp_path, "carried_marks") is None


def joined_rows(spark, since):
    """The rows that joins have made in the executions from ``since`` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total, runs = 0, store.executionsList()
    for run in (runs.apply(k).executionId() for k in range(runs.size())):
        if run < since:
            continue
        told, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())) if "Join" in node.name() else ():
                if metric.name() == "number of output rows":
                    total += int(told.get(metric.accumulatorId()).get().replace(",", "")) if told.contains(metric.accumulatorId()) else 0
    return total


def test_a_path_is_put_together_once(spark):
    n = 300
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    since = 1 + max((runs.apply(k).executionId() for k in range(runs.size())), default=-1)
    got = chain.ancestors(spark.range(1, n + 1).selectExpr("id", "nullif(id - 1, 0) AS parent"), "id", "parent")
    assert got.where("depth = child - ancestor AND NOT cycle").count() == got.count() == n * (n - 1) // 2
    assert 0 < joined_rows(spark, since) < n * n


def test_paths_of_several_parents_and_into_cycles(spark):
    """Against a plain search; long enough for several rounds, with short cuts, cycles, and nodes that lead into them."""
    links = [(k, k + 1) for k in range(1, 20)] + [(k, k + 5) for k in range(1, 15, 3)] + [(20, 12), (30, 31), (31, 30), (40, 40), (41, 40), (50, 30)]
    onto = {}
    for a, b in links:
        onto.setdefault(a, []).append(b)
    want = set()
    for start in onto:
        seen, front, depth = {}, [start], 0
        while front:
            depth += 1
            front = [y for x in front for y in onto.get(x, ()) if y not in seen and not seen.setdefault(y, depth) == 0]
        want |= {(start, y, d, y == start) for y, d in seen.items()}
    nodes = spark.createDataFrame(links + [(60, None)], "id long, parent long")
    assert {tuple(r) for r in chain.ancestors(nodes, "id", "parent").collect()} == want
    assert {tuple(r) for r in chain.ancestors(nodes, "id", "parent", 3).collect()} == {w for w in want if w[2] <= 3}
