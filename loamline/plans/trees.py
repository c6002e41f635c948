"""Candidate features of file trees: five layouts, each as a repository for every fifth supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as K
from ..operators import workspaces as W
from ..sources import bridge as B
from .functions import q
from .registry import query

LEFT_OUT = ("", -1, "")
#: For each layout its paths with the candidate that claims them, in which phase, and what that is in the end.
LAYOUTS = (
    # anchors with support files, hooks, directories and files of no anchor
    (
        ("backend/routers/chat.py", "chat", 1, "chat"), ("backend/routers/v1_billing_router.py", "billing", 1, "billing"), ("frontend/src/pages/ChatPage.tsx", "chat", 1, "chat"), ("web/pages/(shop)/cart.tsx", "shop", 1, "shop"), ("backend/routers/__init__.py", "init", 1, "init"),
        ("backend/services/chat_executor.py", "chat", 2, "chat"), ("backend/models/billing.py", "billing", 2, "billing"), ("src/hooks/useBilling.ts", "billing", 3, "billing"), ("src/data/billing/rates.ts", "billing", 3, "billing"),
        ("src/search/engine.ts", "search", 4, "search"), ("src/zeta.ts", "root", 4, "root"), ("docs/chat.md", *LEFT_OUT), ("package.json", *LEFT_OUT), (".hidden/chat.ts", *LEFT_OUT),
    ),
    # deep anchors, groups of interface parts only, router directories, wrappers
    (
        ("components/graphql/QueryEditor.tsx", "graphql", 1, "graphql"), ("stores/graphql/store.ts", "graphql", 1, "graphql"), ("components/dropdowns/Menu.tsx", "dropdowns", 1, "shared-ui"), ("components/dropdowns/Item.tsx", "dropdowns", 1, "shared-ui"), ("containers/tooltips/Tip.tsx", "tooltips", 1, "shared-ui"),
        ("trpc/server/auth-router/handler.ts", "auth", 1, "auth"), ("lib/auth/token.ts", "auth", 2, "auth"), ("components/ui/Button.tsx", "ui", 4, "ui"), ("apps/web/main.tsx", "apps", 4, "apps"), ("modules/reports/a.ts", "reports", 1, "reports"), ("src/index.ts", "root", 4, "root"),
    ),
    # singular and plural, small groups under a larger name
    (
        *[(f"pages/issues/p{i}.tsx", "issues", 1, "issues") for i in range(6)], ("features/issue/view.tsx", "issue", 1, "issues"), ("pages/sticky/a.tsx", "sticky", 1, "stickies"), ("pages/stickies/a.tsx", "stickies", 1, "stickies"), ("pages/stickies/b.tsx", "stickies", 1, "stickies"), ("pages/glass/a.tsx", "glass", 1, "glass"),
        *[(f"pages/workspace/p{i}.tsx", "workspace", 1, "workspace") for i in range(5)], ("pages/workspace-notifications/a.tsx", "workspace-notifications", 1, "workspace"), ("pages/workspace-notifications-mail/a.tsx", "workspace-notifications-mail", 1, "workspace"),
    ),
    # four apps, so a Django repository, and a fifth with one file of Django's
    (
        *[(f"shop/{a}/{f}", a, 0, a) for a in ("order", "product", "account", "menu") for f in ("__init__.py", "models.py", "views.py")], ("shop/site/__init__.py", "site", 0, "site"), ("shop/site/models.py", "site", 0, "site"),
        ("shop/graphql/order/types.py", "order", 0, "order"), ("shop/order/deep/logic/rules.py", "order", 0, "order"), ("shop/static/menu/logo.svg", "menu", 0, "menu"), ("shop/settings.py", *LEFT_OUT), ("shop/core/__init__.py", *LEFT_OUT), ("other/tool/__init__.py", *LEFT_OUT), ("other/tool/models.py", *LEFT_OUT),
    ),
    # three apps only
    (
        *[(f"site/order/{f}", "order", 3, "order") for f in ("__init__.py", "models.py", "views.py")], *[(f"site/{a}/{f}", "site", 4, "site") for a in ("product", "account") for f in ("__init__.py", "models.py", "views.py")], ("api/views/order.py", "order", 1, "order"),
    ),
)
TREES = "lay(kind, path, claimed, phase, candidate) AS (VALUES " + ", ".join(f"({k}, {q(p)}, {q(c)}, {n}, {q(e)})" for k, rows in enumerate(LAYOUTS) for p, c, n, e in rows) + "), tr AS (SELECT s_suppkey AS repo, lay.* FROM supplier JOIN lay ON kind = s_suppkey % 5)"


def trees(spark, d):
    """(repo, path)."""
    lay = spark.createDataFrame([(k, r[0]) for k, rows in enumerate(LAYOUTS) for r in rows], "kind long, path string")
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("repo"), (F.col("s_suppkey") % 5).alias("kind"))
    return s.join(F.broadcast(lay), "kind").select("repo", "path")


@query("rp2_claims", f"WITH {TREES} SELECT repo, path, claimed, phase FROM tr WHERE phase >= 0")
def rp2_claims(spark, d):
    """Which candidate wins each file, and in which phase."""
    return K.detected(trees(spark, d)).select("repo", "path", "claimed", "phase")


@query("rp2_candidates", f"WITH {TREES} SELECT repo, candidate, count(*) AS files, min(path) AS first FROM tr WHERE phase >= 0 GROUP BY 1, 2")
def rp2(spark, d):
    """Candidates after folding."""
    return K.detected(trees(spark, d)).groupBy("repo", "candidate").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"))


@query("jn13_django_apps", f"WITH {TREES} SELECT repo, path, claimed AS feature FROM tr WHERE phase = 0")
def jn13_apps(spark, d):
    return K.django_apps(trees(spark, d))[1]


PNPM = "# all\npackages:\n  - 'packages/*'\n  # apps too\n  - \"apps/**\"\n  - '!apps/old'\n  - tools/lint/\nonlyBuilt:\n  - x/*\n"
CARGO = '[workspace]\nmembers = [\n    "crates/core",\n    "crates/*-cli",\n]\nresolver = "2"\n'
#: For each kind of workspace its manager, the manifests with their texts, the other files, and packages as (root, name).
WORKSPACES = (
    ("pnpm", {"pnpm-workspace.yaml": PNPM, "package.json": '{"workspaces": ["none/*"]}', "packages/ui/package.json": '{"name": "@org/ui-kit"}', "apps/web/package.json": "{broken", "apps/deep/in/package.json": '{"name": "inner"}'},
     ("packages/ui/src/a.ts", "packages/.cache/a.ts", "apps/web/src/b.ts", "apps/old/c.ts", "apps/deep/in/src/d.ts", "apps/deep/far/e.ts", "tools/lint/f.ts", "tools/other/g.ts", "x/y/h.ts", "readme.md"), (("packages/ui", "ui-kit"), ("apps/web", "web"), ("apps/deep", "deep"), ("apps/deep/in", "inner"), ("tools/lint", "lint"))),
    ("yarn", {"package.json": '{"name": "top", "workspaces": {"packages": ["libs/*/src", "./site"]}}', "yarn.lock": ""}, ("libs/a/src/x.ts", "libs/b/src/y.ts", "libs/b/test/z.ts", "site/index.ts"), (("libs/a/src", "src"), ("libs/b/src", "src"), ("site", "site"))),
    ("npm", {"package.json": '{"workspaces": ["p?", "!p3"]}', "lerna.json": "{}"}, ("p1/a.ts", "p2/b.ts", "p3/c.ts", "p10/d.ts", "q1/e.ts"), (("p1", "p1"), ("p2", "p2"))),
    ("nx", {"nx.json": "{}", "apps/shop/project.json": "{}", "libs/data/package.json": '{"name": "data-access"}'}, ("apps/shop/main.ts", "apps/plain/main.ts", "libs/data/deep/x.ts", "other/z.ts"), (("apps/shop", "shop"), ("libs/data", "data-access"))),
    ("lerna", {"lerna.json": '{"version": "1.0.0"}', "package.json": '{"workspaces": []}'}, ("packages/one/a.js", "packages/two/b.js", "examples/c.js"), (("packages/one", "one"), ("packages/two", "two"))),
    ("cargo", {"Cargo.toml": CARGO, "crates/core/Cargo.toml": '[package]\nname = "my-core"\n'}, ("crates/core/src/lib.rs", "crates/run-cli/src/main.rs", "crates/none/src/lib.rs"), (("crates/core", "my-core"), ("crates/run-cli", "run-cli"))),
    ("go", {"go.work": "go 1.22\n\nuse (\n\t./svc/api\n\t./svc/web/\n)\nuse ./tool\n"}, ("svc/api/main.go", "svc/web/main.go", "tool/t.go", "svc/none/x.go"), (("svc/api", "api"), ("svc/web", "web"), ("tool", "tool"))),
    ("none", {"package.json": "{not json", "pnpm-workspace.yaml": "packages:\nother: 1\n", "Cargo.toml": "[package]\n"}, ("src/a.ts",), ()),
)
SPACES = f"wk(kind, manager, root, name) AS (VALUES {', '.join(f'({k}, {q(m)}, {q(r)}, {q(n)})' for k, (m, _, _, found) in enumerate(WORKSPACES) for r, n in found)}), wf(kind, path) AS (VALUES {', '.join(f'({k}, {q(p)})' for k, (_, texts, paths, _) in enumerate(WORKSPACES) for p in (*texts, *paths))})"


def spaces(spark, d):
    """(repo, path, content)."""
    rows = [(k, p, t) for k, (_, texts, paths, _) in enumerate(WORKSPACES) for p, t in (*texts.items(), *((x, None) for x in paths))]
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("repo"), (F.col("s_suppkey") % len(WORKSPACES)).alias("kind"))
    return s.join(F.broadcast(spark.createDataFrame(rows, "kind long, path string, content string")), "kind").drop("kind")


@query("sc12_workspace_packages", f"WITH {SPACES} SELECT s_suppkey AS repo, manager, name, root FROM supplier JOIN wk ON kind = s_suppkey % {len(WORKSPACES)}")
def sc12_workspaces(spark, d):
    """Packages from the texts of eight kinds of manifests, with nested and negated patterns."""
    return W.packages(spaces(spark, d))


@query("sc12_workspace_files", f"WITH {SPACES}, h AS (SELECT wf.kind, path, max_by(root, length(root)) AS root FROM wf LEFT JOIN wk ON wk.kind = wf.kind AND starts_with(path, root || '/') GROUP BY 1, 2) SELECT s_suppkey AS repo, path, root FROM supplier JOIN h ON kind = s_suppkey % {len(WORKSPACES)}")
def sc12_files(spark, d):
    t = spaces(spark, d)
    return W.package_files(t, W.packages(t))
