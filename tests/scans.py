"""Rows that Spark's scans of a table have read, from the session's own record of executed plans."""

from __future__ import annotations


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _store(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore()


def last_execution(spark) -> int:
    return max((e.executionId() for e in _items(_store(spark).executionsList())), default=-1)


def scans(spark, part: str, since: int) -> list[dict]:
    """The figures of every executed scan whose place holds part, of executions after the given one."""
    store, found = _store(spark), []
    for execution in _items(store.executionsList()):
        if execution.executionId() <= since:
            continue
        values = store.executionMetrics(execution.executionId())
        for node in _items(store.planGraph(execution.executionId()).allNodes()):
            if node.name().startswith("Scan") and part in node.desc():
                figures = {m.name(): values.get(m.accumulatorId()) for m in _items(node.metrics())}
                found.append({k: v.get() for k, v in figures.items() if v.isDefined()})
    return found


def rows_read(spark, part: str, since: int) -> int:
    return sum(int(s["number of output rows"].replace(",", "")) for s in scans(spark, part, since) if "number of output rows" in s)
