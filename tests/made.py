"""Rows that a plan makes."""


def most_rows(df) -> int:
    """The largest number of rows that a join or aggregate of the plan gave, after running it."""
    plan = df._jdf.queryExecution()
    plan.toRdd().count()
    most, todo = 0, [plan.executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        rows = p.metrics().get("numOutputRows")
        if rows.isDefined() and ("Join" in kind or "Aggregate" in kind):
            most = max(most, rows.get().value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return most
