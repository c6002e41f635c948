"""Functions of SQL against the expressions that they are made of."""

import pytest
from loamline.functions import sql
from pyspark.sql import functions as F

TEXTS = [
    "fix: crash (#12)", "Merge pull request #7 from x\nrevert: y", "feat(scope-a): add", "it's a \\ 'quoted' fix typo", "", "src/api/users.test.ts", "app/[id]/page.tsx", "https://x.example/a/b/?q=1#f", "git@host:org/repo.git", "/users/:id/{x}",
    "@org/core-team", "user_service", "pages/InvestigationPage.tsx", "my shell", "data-loading-flow", "view-pricing", "Login-flow", "import R from 'react'; <Panel a=1>", "docs/a.md", "backend_test_linux.go", None,
]


@pytest.fixture(scope="module")
def registered(spark):
    return sql.register_udfs(spark)


@pytest.mark.parametrize("name", sorted(sql.FUNCTIONS))
def test_sql_gives_what_the_rule_gives(spark, registered, name):
    rule, arguments = sql.FUNCTIONS[name]
    rows = spark.createDataFrame([(i, t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)], "i int, a string, b string")
    columns = ["a", "b"][: len(arguments)]
    want = {r.i: r.v for r in rows.select("i", rule(*map(F.col, columns)).alias("v")).collect()}
    rows.createOrReplaceTempView("texts")
    got = spark.sql(f"SELECT i, {name}({', '.join(columns)}) AS v FROM texts")
    assert {r.i: r.v for r in got.collect()} == want
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
