"""Small rows with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from loamline.functions import commits as C
from loamline.functions import names as N
from loamline.functions import paths as P
from loamline.functions import scores as S
from loamline.operators import attribution as A
from loamline.operators import cochange as CC
from loamline.operators import graph as G
from loamline.operators import lines as L


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_bug_fixes(spark):
    yes = ["fix: login", "Hotfix crash", "null pointer in x", "race  condition", "fix: typo in name"]
    no = ["fixes nothing", "fix typo", "fix   lint errors", "feat: x", "fix formatting", None]
    assert column(spark, yes + no, C.is_bug_fix) == [True] * len(yes) + [False] * len(no)


def test_pr_numbers(spark):
    got = column(spark, ["Merge pull request #12 from a/b", "feat: x (#34)", "see #5", "Merge pull request #1 (#2)", "x (#7)\nmore"], C.pr_number)
    assert got == [12, 34, None, 1, 7]


def test_scopes(spark):
    assert column(spark, ["feat(Auth): x", "billing: y", "fix: z", "none"], C.scope) == ["auth", "billing", None, None]


def test_names(spark):
    assert column(spark, ["user-authentication", "a/team-lifecycle", "billing-and-subscriptions", "trpc-server-infrastructure", "Already Named"], N.humanize) == ["User Authentication", "Team Lifecycle", "Billing & Subscriptions", "tRPC Server Infrastructure", "Already Named"]


def test_buckets_and_routes(spark):
    paths = ["apps/web/lib/utils/billing.ts", "docs/images/survey.webp", "packages/auth/__tests__/login.test.ts", "node_modules/react/index.js", ".github/workflows/ci.yml", "package.json", "apps/web/package.json"]
    assert column(spark, paths, P.bucket) == ["source", "documentation", "tests", "generated", "infrastructure", "infrastructure", "source"]
    assert column(spark, ["src/app/dashboard/settings/page.tsx", "pages/api/webhooks/github.ts", "src/routes/checkout/+page.svelte"], P.file_route) == ["/dashboard/settings", "/api/webhooks/github", "/checkout"]
    assert column(spark, ["/Users/[id]/", "users/:id", "/u/{a}/[...rest]"], P.api_pattern) == ["/users/:*", "/users/:*", "/u/:*/:*"]
    assert column(spark, ["git@h.com:o/r.git", "https://h.com/o/r/"], P.remote_url) == ["https://h.com/o/r", "https://h.com/o/r"]
    assert column(spark, ["src/(auth)/Login/a.ts", "src/lib/a.ts", "a.ts"], P.first_segment) == ["login", "root", "root"]


def test_layers(spark):
    assert column(spark, ["app/x/page.tsx", "src/models/user.py", "pages/api/x.ts", "hooks/useX.ts", "a/AuthStore.ts", "readme"], P.layer) == ["ui", "schema", "api-server", "state", "state", None]


def test_health(spark):
    got = spark.sql("select 0.0d as x, 100L as n union all select 1.0d, 100L union all select null, 0L union all select 0.0d, 10L").select(F.round(S.health(F.col("x"), F.col("n")), 2)).collect()
    assert [r[0] for r in got] == [98.79, 2.66, 100.0, pytest.approx(98.79 * 0.2 + 98.79 * 0.8 * 0.8, abs=0.01)]


def test_zero_commit_features_stay(spark):
    ts = datetime.datetime(2024, 1, 1)
    commits = spark.createDataFrame([(1, "a", ts, True), (2, "b", ts, False)], "sha int, author string, ts timestamp_ntz, is_bug_fix boolean")
    features = spark.createDataFrame([("x", "src/x/a.ts"), ("y", "src/y/a.ts")], "feature string, path string")
    touched = A.assigned(spark.createDataFrame([(1, "src/x/new.ts"), (2, "src/x/a.ts"), (2, "other/z.ts")], "sha int, path string"), features)
    got = {r.feature: r for r in A.metrics(features, touched, commits, commits.agg(F.max("ts").alias("as_of"))).collect()}
    assert (got["x"].total_commits, got["x"].bug_fixes, got["x"].bug_fix_ratio, got["x"].authors) == (2, 1, 0.5, "a|b")
    assert (got["y"].total_commits, got["y"].health) == (0, 100.0)


def test_co_change(spark):
    rows = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b")] + [(s, f"f{i}") for s in (8, 9) for i in range(35)]
    got = {(r.f1, r.f2): r.score for r in CC.top_pairs(CC.pairs(spark.createDataFrame(rows, "sha int, path string"))).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 0.67, ("b", "c"): 0.67}


def test_components_and_reach(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2"), ("z2", "z1")], "f1 string, f2 string")
    got = {r.node: r.root for r in G.components(chain).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(61)} | {"z1": "z1", "z2": "z1"}
    edges = chain.select(F.col("f1").alias("src"), F.col("f2").alias("dst"))
    near = G.reach(edges, spark.createDataFrame([("s", "n000"), ("s", "z1")], "seed string, node string"))
    assert sorted((r.node, r.depth) for r in near.collect()) == [("n000", 0), ("n001", 1), ("n002", 2), ("n003", 3), ("z1", 0), ("z2", 1)]


def test_ranges(spark):
    ranges = spark.createDataFrame([("p", 1, 3), ("p", 4, 6), ("p", 9, 12), ("p", 10, 11), ("q", 5, 5)], "path string, start int, stop int")
    assert sorted(tuple(r) for r in L.merged_ranges(ranges, ["path"]).collect()) == [("p", 1, 6), ("p", 9, 12), ("q", 5, 5)]
    points = spark.createDataFrame([("p", 3, 7), ("p", 130, 8), ("q", 5, 9)], "path string, line int, sha int")
    wide = spark.createDataFrame([("p", "f", 1, 200), ("p", "g", 2, 4), ("q", "h", 6, 9)], "path string, name string, start int, stop int")
    assert sorted((r.path, r.line, r.name) for r in L.innermost(points, wide).collect()) == [("p", 3, "g"), ("p", 130, "f")]
    assert sorted((r.name, r.sha) for r in L.range_commits(wide, points, ["name"]).collect()) == [("f", 7), ("f", 8), ("g", 7)]
