"""Stems, business domains and owners' kinds out of paths and names, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of file stems that name a variant, a layer's role, or a view.
VARIANT_ENDS = "_test _tests _appengine _unix _windows _linux _darwin _bsd _freebsd _openbsd _netbsd _plan9 _js _wasm _amd64 _arm64 _386 _file _multipart _legacy _deprecated".split()
ROLE_ENDS = "_service _router _handler _controller _model _repository _repo _view _page _executor _scheduler _engine _manager _generator _builder _provider _client _settings _config".split()
VIEW_ENDS = "page view screen panel widget".split()
# Directories of an application's layers, and directories that name no domain.
APP_LAYERS = "routers routes router services service models model handlers handler controllers controller endpoints endpoint views view pages page screens screen".split()
NO_DOMAIN = "api apis pages app apps src lib routes router routers handler handlers controller controllers service services v1 v2 v3 public internal shared common".split()
# Directories, file names and extensions of infrastructure.
AUXILIARY_DIRS = "tests test __tests__ migrations fixtures scripts ci .github docs static assets templates locale management".split()
TOOL_DIRS = "prisma drizzle graphql-schema .yarn .changeset .claude .agents .opencode .devcontainer .snaplet .storybook docker deploy infra terraform".split()
CONFIG_FILES = "dockerfile docker-compose.yml makefile caddyfile .gitignore .env .env.example readme.md pyproject.toml setup.py setup.cfg requirements.txt package.json package-lock.json tsconfig.json vite.config.ts next.config.js tailwind.config.js".split()
CONFIG_EXTENSIONS = ".toml .lock .cfg .ini .yml .yaml .json .md .txt .rst".split()
# Owners that catch all, and words of domains.
CATCH_ALL = ("i18n", "ui", "web", "app", "shell", "frontend", "studio", "studio dashboard", "vue blocks", "app shell", "workflow app")
DOMAIN_WORDS = ("auth", "billing", "notification")
TEAM_ENDS = ("-team", "-engineering", "-eng", "-squad", "-pod")

LEAST_STEM = 4


def stem(path: Column) -> Column:
    """File name without its last extension, in lower case."""
    return F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", ""))


def _bare(s: Column) -> Column:
    return F.regexp_replace(s, r"^[_.\-]+|[_.\-]+$", "")


def library_stem(path: Column) -> Column:
    """Stem without any run of endings for tests, systems and variants."""
    return _bare(F.regexp_replace(stem(path), "(?:" + "|".join(VARIANT_ENDS) + ")+$", ""))


def domain_stem(s: Column) -> Column:
    """A stem without one role, one view and one plural at its end, as long as LEAST_STEM characters stay."""
    keep = "^(.{%d,})" % LEAST_STEM
    s = F.regexp_replace(s, keep + "(?:" + "|".join(ROLE_ENDS) + ")$", "$1")
    s = F.regexp_replace(s, keep + "(?:" + "|".join(VIEW_ENDS) + ")$", "$1")
    plural = s.endswith("s") & ~s.endswith("ss") & ~s.endswith("us") & (F.length(s) > LEAST_STEM)
    return _bare(F.when(plural, F.substr(s, F.lit(1), F.length(s) - 1)).otherwise(s))


def layered_domain(path: Column, catch_all: Column) -> Column:
    """Domain of a file in a layer's directory at the top, second or right under `catch_all`: the next directory's or the file's stem; null elsewhere."""
    parts = F.split(path, "/")
    at = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.lower(F.get(parts, i)).isin(*APP_LAYERS) & ((i <= 1) | (F.lower(F.get(parts, i - 1)) == F.lower(catch_all))))
    i = F.get(at, F.lit(0))
    after = F.get(parts, i + 1)
    return F.nullif(domain_stem(F.when(i + 2 < F.size(parts), F.lower(after)).otherwise(stem(after))), F.lit(""))


def path_domain(path: Column) -> Column:
    """Last directory that is no route parameter or group and names no structure; empty if there is none."""
    parts = F.split(path, "/")
    dirs = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.lower(x))
    own = F.filter(dirs, lambda x: (x != "") & ~F.startswith(x, F.lit("[")) & ~F.startswith(x, F.lit("(")) & ~x.isin(*NO_DOMAIN))
    return F.coalesce(F.get(own, F.size(own) - 1), F.lit(""))


def is_infra(path: Column) -> Column:
    """Whether a file is set-up rather than part of a feature: by directory, by name, or a configuration file at most one directory deep."""
    parts = F.split(path, "/")
    dirs = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.lower(x))
    name = F.lower(F.element_at(parts, -1))
    aside = F.exists(dirs, lambda x: x.isin(*AUXILIARY_DIRS, *TOOL_DIRS) | (F.startswith(x, F.lit(".")) & (x != ".github")))
    config = (F.size(parts) <= 2) & F.regexp_extract(name, r"^.+(\.[^.]+)$", 1).isin(*CONFIG_EXTENSIONS)
    return aside | name.isin(*CONFIG_FILES) | config


def is_catch_all(owner: Column) -> Column:
    low = F.trim(F.lower(owner))
    return low.isin(*CATCH_ALL) | F.substring_index(F.substring_index(low, "/", -1), " ", -1).isin(*CATCH_ALL)


def is_domain_target(name: Column) -> Column:
    out = F.lit(False)
    for w in DOMAIN_WORDS:
        out = out | F.contains(F.lower(name), F.lit(w))
    return out


def team_name(owner: Column) -> Column:
    """Name that a code owner stands for: without @, organisation and one word for team."""
    bare = F.regexp_replace(F.regexp_replace(owner, "^@+", ""), "^[^/]*/", "")
    return F.regexp_replace(bare, "(?:" + "|".join(TEAM_ENDS) + ")$", "")
