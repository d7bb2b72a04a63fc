"""What a query read: files, bytes and rows of each scan, as its plan counted them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _leaves(node) -> list:
    """Scans of an executed plan, through adaptive plans and their stages."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _leaves(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return _leaves(node.plan())
    children = node.children()
    inner = [x for i in range(children.size()) for x in _leaves(children.apply(i))]
    return inner or [node]


def scans(df: DataFrame) -> list[dict]:
    """Runs the query and gives, for each scan of files, its place and what was read: the statistics of access by table."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    out = []
    for leaf in _leaves(execution.executedPlan()):
        if leaf.getClass().getSimpleName() != "FileSourceScanExec":
            continue
        metrics = leaf.metrics()
        value = lambda name: int(metrics.apply(name).value()) if metrics.contains(name) else 0
        roots = leaf.relation().location().rootPaths()
        out.append({"path": roots.apply(0).toString() if roots.size() else "", "files": value("numFiles"), "bytes": value("filesSize"), "rows": value("numOutputRows")})
    return out
