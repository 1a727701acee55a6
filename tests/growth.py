"""Rows that the joins of a plan made, for tests of how work grows."""

from contextlib import contextmanager


@contextmanager
def plain_plans(spark):
    """Plans as written: no re-planning while they run, none of whose steps would be hidden."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def most_rows(df):
    """Runs the query; the largest row count that any join of its plan gave out."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    counts, todo = [0], [qe.executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined() and "Join" in node.nodeName():
            counts.append(metric.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return max(counts)
