"""File paths as native column expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names, file names and suffixes by what they hold.
SKIPPED_SEGMENTS = "src app lib pkg internal core views pages screens routes containers components layouts features api actions hooks providers contexts stores services helpers utils types models schemas middleware config constants assets styles public static".split()
TEST_PATH = r"\.(?:test|spec)\.(?:ts|tsx|js|jsx|py)$|/__tests__/|/tests?/|/test_[^/]+\.py$|/[^/]+_test\.py$"
TEST_DIRS = "test tests __tests__ testing testutils test-utils e2e integration-tests unit-tests spec specs fixtures __fixtures__ mocks __mocks__ __snapshots__ cypress playwright vitest-mocks".split()
TEST_SUFFIXES = ".test.ts .test.tsx .test.js .test.jsx .test.mjs .spec.ts .spec.tsx .spec.js .spec.jsx .spec.mjs .test.py _test.py _test.go .e2e.ts .e2e.js".split()
DOC_DIRS = "docs doc docs_src documentation examples example demos demo tutorials tutorial www website site landing marketing playground playgrounds sandbox sandboxes cookbook recipes".split()
GENERATED_DIRS = "node_modules dist build out .next .nuxt .turbo .cache coverage .coverage htmlcov __pycache__ .pytest_cache .venv venv env target .gradle .idea .vscode .parcel-cache .svelte-kit .vercel vendor bower_components".split()
GENERATED_FILES = "package-lock.json pnpm-lock.yaml yarn.lock bun.lockb composer.lock poetry.lock pipfile.lock cargo.lock gemfile.lock go.sum".split()
GENERATED_SUFFIXES = ".min.js .min.css .min.map .generated.ts .generated.js .gen.go _pb.go _pb.py _pb2.py".split()
INFRA_DIRS = ".github .gitlab .circleci .buildkite .woodpecker helm charts k8s kubernetes manifests terraform pulumi ansible puppet docker .devcontainer .gitpod .changeset .husky".split()
ROOT_FILES = "package.json pnpm-workspace.yaml turbo.json nx.json lerna.json rush.json go.work go.work.sum cargo.toml cargo.lock pyproject.toml setup.py setup.cfg pipfile poetry.lock dockerfile docker-compose.yml docker-compose.yaml docker-compose.dev.yml docker-compose.prod.yml .dockerignore .gitignore .gitattributes .eslintrc .eslintrc.js .eslintrc.cjs .eslintrc.json .eslintignore .prettierrc .prettierrc.js .prettierignore .editorconfig .nvmrc .npmrc .yarnrc .yarnrc.yml tsconfig.json tsconfig.base.json jsconfig.json vite.config.ts vite.config.js vitest.workspace.ts rollup.config.js webpack.config.js esbuild.config.mjs makefile justfile taskfile.yml renovate.json dependabot.yml codecov.yml lefthook.yml commitlint.config.js sonar-project.properties .vercelignore vercel.json netlify.toml railway.json openapi.yml openapi.yaml openapi.json readme.md license license.md license.txt contributing.md code_of_conduct.md security.md changelog.md authors.md agents.md playwright.config.ts playwright.service.config.ts jest.config.js jest.config.ts".split()
SHARED_NAMES = "root init __init__ main src source lib libs utils util helpers helper common shared core infra infrastructure config configs".split()

# Layers by path, the first match wins.
LAYERS = (
    ("schema", r"(?:^|/)(?:prisma/schema\.prisma|schema\.prisma)$"), ("schema", r"(?:^|/)prisma/migrations/"), ("schema", r"(?:^|/)migrations/.*\.(?:sql|py|ts|js)$"), ("schema", r"(?:^|/)db/.*schema\.(?:ts|js|sql)$"),
    ("schema", r"(?:^|/)drizzle\.(?:config|schema)\."), ("schema", r"(?:^|/)models/.*\.py$"), ("schema", r"(?:^|/)models\.py$"), ("schema", r"(?:^|/)schemas?/.*\.py$"), ("schema", r"(?:^|/)types\.py$"), ("schema", r"(?:^|/)entities/.*\.py$"),
    ("schema", r"(?:^|/)internal/(?:db|store|models)/.+\.go$"), ("schema", r"(?:^|/)pkg/(?:db|models)/.+\.go$"), ("schema", r"_model\.go$"), ("schema", r"_repository\.go$"), ("schema", r"(?:^|/)src/(?:db|models?|schema)/.+\.rs$"), ("schema", r"(?:^|/)src/schema\.rs$"), ("schema", r"(?:^|/)migrations?/.+\.rs$"),
    ("api-server", r"(?:^|/)app/.+/route\.(?:ts|js|mjs)$"), ("api-server", r"(?:^|/)pages/api/"), ("api-server", r"(?:^|/)trpc/(?:server|router)/"), ("api-server", r"(?:^|/)server/(?:trpc|router)/"), ("api-server", r"(?:^|/)server-only/"), ("api-server", r"(?:^|/)lib/.+/server-only/"),
    ("api-server", r"(?:^|/)server\.(?:ts|js|py)$"), ("api-server", r"(?:^|/)routers/.+\.py$"), ("api-server", r"(?:^|/)controllers/"), ("api-server", r"(?:^|/)resolvers/"), ("api-server", r"(?:^|/)endpoints/"), ("api-server", r"(?:^|/)views/.*\.py$"), ("api-server", r"(?:^|/)views\.py$"), ("api-server", r"(?:^|/)urls\.py$"),
    ("api-server", r"(?:^|/)cli\.py$"), ("api-server", r"(?:^|/)cli/.+\.py$"), ("api-server", r"(?:^|/)__main__\.py$"), ("api-server", r"(?:^|/)cmd/.+\.(?:py|go|rs)$"), ("api-server", r"(?:^|/)main\.(?:py|go|rs)$"), ("api-server", r"(?:^|/)app\.py$"), ("api-server", r"(?:^|/)server\.py$"), ("api-server", r"(?:^|/)api/.+\.py$"),
    ("api-server", r"(?:^|/)internal/(?:handlers?|routes?|api|server)/.+\.go$"), ("api-server", r"(?:^|/)pkg/(?:handlers?|routes?|api|server)/.+\.go$"), ("api-server", r"_handler\.go$"), ("api-server", r"_route\.go$"), ("api-server", r"(?:^|/)handlers?/.+\.go$"), ("api-server", r"(?:^|/)src/(?:handlers?|routes?|api|controllers?)/.+\.rs$"), ("api-server", r"(?:^|/)src/server\.rs$"),
    ("state", r"(?:^|/)stores?/"), ("state", r"(?:^|/)slices?/"), ("state", r"(?:^|/)atoms?/"), ("state", r"(?:^|/)recoil/"), ("state", r"(?:^|/)redux/"), ("state", r"(?:^|/)zustand/"), ("state", r"(?:^|/)contexts?/.*\.(?:tsx?|jsx?)$"),
    ("state", r"[A-Za-z]+Store\.(?:ts|tsx|js|jsx)$"), ("state", r"[A-Za-z]+Slice\.(?:ts|tsx|js|jsx)$"), ("state", r"[A-Za-z]+Context\.(?:ts|tsx|js|jsx)$"), ("state", r"[A-Za-z]+Provider\.(?:ts|tsx|js|jsx)$"), ("state", r"(?:^|/)internal/services?/.+\.go$"), ("state", r"_service\.go$"), ("state", r"(?:^|/)src/(?:services?|state|domain)/.+\.rs$"),
    ("api-client", r"(?:^|/)trpc/client/"), ("api-client", r"(?:^|/)client/(?:api|trpc)/"), ("api-client", r"(?:^|/)api/.+\.(?:ts|js|tsx|jsx)$"), ("api-client", r"(?:^|/)lib/api[/\.]"), ("api-client", r"[A-Za-z]+Client\.(?:ts|js)$"),
    ("ui", r"(?:^|/)app/.+/(?:page|layout|error|loading|not-found)\.(?:tsx?|jsx?)$"), ("ui", r"(?:^|/)pages/.*\.(?:tsx?|jsx?)$"), ("ui", r"(?:^|/)routes/.*\.(?:tsx?|jsx?)$"), ("ui", r"(?:^|/)components/"), ("ui", r"(?:^|/)views/.*\.(?:tsx?|jsx?)$"), ("ui", r"(?:^|/)widgets/"), ("ui", r"(?:^|/)layouts/"), ("ui", r"(?:^|/)templates/"),
    ("ui", r"(?:^|/)dialogs/"), ("ui", r"(?:^|/)forms/"), ("ui", r"(?:^|/)primitives/"), ("ui", r"(?:^|/)design-system/"), ("ui", r"(?:^|/)ds/"), ("ui", r"(?:^|/)kit/.+\.(?:tsx?|jsx?)$"), ("ui", r"[A-Za-z]+(?:Form|Dialog|Modal|Card|Page|Sheet|Drawer|Panel|Banner|Toast|Tooltip|Menu|Tab|List|Item)\.(?:tsx?|jsx?)$"),
    ("state", r"(?:^|/)hooks?/"),
)


def parent(path: Column) -> Column:
    """Directory of a path; `.` at the top."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _dirs(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def first_segment(path: Column, skip: list[str] | tuple[str, ...] = tuple(SKIPPED_SEGMENTS)) -> Column:
    """First directory that is neither skipped nor a route group in parentheses, in lower case; `root` if there is none."""
    own = F.filter(_dirs(path), lambda s: ~s.isin(*skip) & ~s.rlike(r"^\(.*\)$"))
    return F.coalesce(F.get(own, F.lit(0)), F.lit("root"))


def domain_key(path: Column, skip: list[str] | tuple[str, ...] = tuple(SKIPPED_SEGMENTS)) -> Column:
    """First three directories that are not structural, else the last two of all."""
    dirs = _dirs(path)
    own = F.filter(dirs, lambda s: ~s.isin(*skip))
    last = F.slice(dirs, F.greatest(F.size(dirs) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(own) > 0, F.array_join(F.slice(own, 1, 3), "/")).otherwise(F.array_join(last, "/"))


def is_test_path_regex(path: Column) -> Column:
    return F.concat(F.lit("/"), path).rlike(TEST_PATH)


def _ends(name: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | name.endswith(s)
    return out


def is_test_path_segments(path: Column) -> Column:
    return F.arrays_overlap(_dirs(path), F.array(*map(F.lit, TEST_DIRS))) | _ends(F.lower(file_name(path)), TEST_SUFFIXES)


def is_documentation(path: Column) -> Column:
    return F.arrays_overlap(_dirs(path), F.array(*map(F.lit, DOC_DIRS)))


def bucket(path: Column) -> Column:
    """generated, tests, documentation, infrastructure or source; the first rule that holds."""
    name, dirs = F.lower(file_name(path)), _dirs(path)
    generated = F.arrays_overlap(dirs, F.array(*map(F.lit, GENERATED_DIRS))) | name.isin(*GENERATED_FILES) | _ends(name, GENERATED_SUFFIXES)
    infra = F.arrays_overlap(dirs, F.array(*map(F.lit, INFRA_DIRS))) | (~path.contains("/") & name.isin(*ROOT_FILES))
    return F.when(generated, "generated").when(is_test_path_segments(path), "tests").when(is_documentation(path), "documentation").when(infra, "infrastructure").otherwise("source")


def layer(path: Column) -> Column:
    """Architecture layer by path, null if no pattern matches."""
    out = F.when(F.lit(False), None)
    for name, run in itertools.groupby(LAYERS, key=lambda x: x[0]):  # neighbours of one layer are one pattern
        out = out.when(path.rlike("|".join(f"(?:{pattern})" for _, pattern in run)), F.lit(name))
    return out.cast("string")


def canonical_bucket(name: Column) -> Column:
    cleaned = F.trim(F.trim(F.lower(name)), F.lit("/"))
    return F.when(cleaned.isin(*SHARED_NAMES), "shared-infra").otherwise(name)


def file_route(path: Column) -> Column:
    """URL route of a page file: without its root folder, its index or page name and its extension."""
    inner = F.regexp_replace(path, r"^(?:src/app/|src/pages/|app/|pages/|src/routes/)", "")
    bare = F.regexp_replace(inner, r"(?:/page\.(?:tsx|ts|jsx|js)|/\+page\.(?:svelte|ts)|/index\.(?:tsx|ts|jsx|js)|\.tsx|\.ts|\.jsx|\.js|\.svelte)$", "")
    route = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.when(route == "/", route).otherwise(F.regexp_replace(route, "/+$", ""))


def url_path(url: Column) -> Column:
    """Path of a URL without query, fragment and trailing slash."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", "")
    return F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))


def api_pattern(path: Column) -> Column:
    """Lower case, one leading and no trailing slash; `:x`, `[x]` and `{x}` become `:*`."""
    p = F.regexp_replace(F.lower(F.trim(path)), "/+$", "")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    for pattern in (r":[a-z0-9_-]+", r"\[\.{0,3}[a-z0-9_-]+\]", r"\{[a-z0-9_-]+\}"):
        p = F.regexp_replace(p, pattern, ":*")
    return p


def remote_url(url: Column) -> Column:
    """https form of a git remote, without trailing slashes and `.git`."""
    u = F.regexp_replace(F.regexp_replace(url, r"^git@([^:]+):", "https://$1/"), "/+$", "")
    return F.regexp_replace(u, r"\.git$", "")


# What contents tell of a layer, in this order.
CONTENT_SCHEMA = r"(?m)(?:^|\n)\s*model\s+\w+\s*\{|@(?:Entity|Schema)\s*\(|sequelize\.define\s*\(|class\s+\w+\s*\([^)]*(?:models\.Model|BaseModel)[^)]*\)|\bMapped\s*\[|class\s+\w+\s*\(\s*(?:DeclarativeBase|Base)\s*\)|\bgorm\.Model\b|\bbun\.BaseModel\b"
CONTENT_API_SERVER = r"@(?:app|router|blueprint)\.(?:get|post|put|patch|delete|api_route)|\b(?:app|router|api)\.(?:get|post|put|patch|delete|all|use)\s*\(|\bprocedure\.(?:query|mutation|subscription)\s*\(|\b(?:protected|public)Procedure\.|\b(?:loader|action)\s*=\s*async|\btyper\.Typer\s*\(|\bargparse\.ArgumentParser\s*\(|\bgin\.(?:Default|New|Engine)\s*\(|\bhttp\.HandleFunc\s*\("
CONTENT_STATE = r"\b(?:createSlice|configureStore|atom\s*\(|atomWithDefault\s*\(|writable\s*\(|readable\s*\(|derived\s*\(|createContext\s*<|useContext\s*\(|defineStore\s*\()"
CONTENT_API_CLIENT = r"\b(?:useQuery|useMutation|useInfiniteQuery|useSubscription|useSWR|useSWRImmutable|axios\.(?:get|post|put|patch|delete)|trpc\.[A-Za-z]+\.(?:useQuery|useMutation))"
CONTENT_TAG = r"</?[A-Z][A-Za-z0-9]*[\s/>]"
CONTENT_REACT = r"\bfrom\s+['\"]react['\"]|\bfrom\s+['\"]react/[a-z]|\bjsxs?\b"


def content_layer(content: Column) -> Column:
    """Layer by what a file holds, null if nothing tells."""
    jsx = content.rlike(CONTENT_TAG) & content.rlike(CONTENT_REACT)
    return F.when(content.rlike(CONTENT_SCHEMA), "schema").when(content.rlike(CONTENT_API_SERVER), "api-server").when(content.rlike(CONTENT_STATE), "state").when(content.rlike(CONTENT_API_CLIENT), "api-client").when(jsx, "ui")


def file_layer(path: Column, content: Column) -> Column:
    return F.coalesce(layer(path), content_layer(content), F.lit("support"))


#: Endings and beginnings of file stems that name a role.
STEM_ENDS = "page router controller handler view service executor worker model schema serializer blueprint container dialog".split()
STEM_STARTS = ("v1_", "v2_", "api_")


def normal_stem(raw: Column) -> Column:
    """Lower case, without one role at the end and one version at the start."""
    s = F.regexp_replace(F.lower(raw), "(?<=.)(?:" + "|".join(STEM_ENDS) + ")$", "")
    s = F.regexp_replace(s, "^(?:" + "|".join(STEM_STARTS) + ")", "")
    return F.regexp_replace(s, r"^[_\- ]+|[_\- ]+$", "")


def app_route(path: Column) -> Column:
    """Route of an API file: without src and app at the start, without a closing route file or extension."""
    inner = F.regexp_replace(path, r"^(?:(?:src|app)/)+", "")
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(inner, r"/?route\.[a-z]+$", ""), r"\.[a-z]+$", ""))


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def word_runs(name: Column, most: int = 3) -> Column:
    """Every run of one to `most` neighbouring words of a name, joined by _."""
    parts = F.array_remove(F.split(snake(name), r"[_\-.]"), "")
    n = F.size(parts)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), n - i + 1)), lambda k: F.array_join(F.slice(parts, i, k), "_")))
    return F.when(n > 0, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


# Directories and names of end-to-end tests.
E2E_DIRS = ("e2e", "cypress", "playwright", "integration", "acceptance")
E2E_SUFFIX = r"\.(?:spec|cy|e2e|test)\.(?:ts|tsx|js|jsx)$|\.feature$"


def e2e_flow(path: Column) -> Column:
    """Flow that an end-to-end test is named for, null for other files."""
    is_e2e = F.arrays_overlap(_dirs(path), F.array(*map(F.lit, E2E_DIRS))) | path.rlike(r"\.(?:spec|cy|e2e)\.(?:ts|tsx|js|jsx)$|\.feature$")
    stem = F.regexp_replace(F.regexp_replace(file_name(path), E2E_SUFFIX, ""), r"\.(?:ts|tsx|js|jsx|py)$", "")
    name = F.regexp_replace(F.lower(F.regexp_replace(stem, r"[_\s]+", "-")), "^-+|-+$", "")
    return F.when(is_e2e & (name != ""), F.when(name.endswith("-flow"), name).otherwise(F.concat(name, F.lit("-flow"))))
