"""Small helpers for tests."""


def plan(df):
    """The physical plan that was chosen before running."""
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The physical plan after a run, as adaptive execution left it."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
