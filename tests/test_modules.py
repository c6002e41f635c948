"""Imports of Python, Go and Rust between files of small repositories."""

import pytest

from loamline.operators import extract, modules


def edges(spark, f, texts, more=()):
    sources = spark.createDataFrame(list(texts.items()), "path string, content string")
    files = spark.createDataFrame([(p,) for p in [*texts, *more]], "path string")
    return sorted(tuple(r) for r in f(sources, files).select("src", "dst", "symbol").collect())


def test_python_dots_packages_and_roots(spark):
    texts = {
        "apps/api/views.py": "from .models import User, Order as O\nfrom ..core import *\nfrom . import tools\nimport core.db\nimport os\n  from apps.api.models import (\n    User,\n    Item,\n)\n# from x import y\nfrom ....far import z\nfrom helpers import h  # note",
        "top.py": "from . import a\nimport pkg.sub.mod as m\nfrom pkg import thing",
    }
    more = ["apps/api/models.py", "apps/core/__init__.py", "apps/api/__init__.py", "apps/core/db.py", "src/helpers.py", "lib/helpers.py", "src/pkg/sub/mod.py", "pkg.py", "pkg/__init__.py"]
    assert edges(spark, modules.python_edges, texts, more) == sorted([
        ("apps/api/views.py", "apps/api/models.py", "User"), ("apps/api/views.py", "apps/api/models.py", "Order"), ("apps/api/views.py", "apps/api/models.py", "Item"), ("apps/api/views.py", "apps/core/__init__.py", "*"),
        ("apps/api/views.py", "apps/api/__init__.py", "tools"), ("apps/api/views.py", "apps/core/db.py", "@import"), ("apps/api/views.py", "src/helpers.py", "h"), ("top.py", "src/pkg/sub/mod.py", "@import"), ("top.py", "pkg.py", "thing"),
    ])


def test_go_packages_aliases_and_calls(spark):
    texts = {
        "go.mod": "// head\nmodule example.com/shop\n\ngo 1.22\n",
        "cmd/main.go": 'package main\nimport "fmt"\nimport au "example.com/shop/internal/auth"\nimport (\n\t"example.com/shop/internal/cart"\n\t_ "example.com/shop/internal/boot"\n\t"example.com/shopping/x"\n\n\tother "github.com/x/y"\n)\nfunc main() {\n au.Login(x); au.logout(y); cart.Total.Sum(); other.Do(); fmt.Println(cart.Add (1))\n}',
        "internal/auth/a_test.go": 'import "example.com/shop"',
    }
    more = ["internal/auth/b.go", "internal/auth/c.go", "internal/auth/deep/a.go", "internal/cart/cart.go", "internal/boot/boot_test.go", "internal/boot/init.go", "root.go"]
    assert edges(spark, modules.go_edges, texts, more) == sorted([
        ("cmd/main.go", "internal/auth/b.go", "Login"), ("cmd/main.go", "internal/cart/cart.go", "Total"), ("cmd/main.go", "internal/cart/cart.go", "Add"), ("cmd/main.go", "internal/boot/init.go", "@import"), ("internal/auth/a_test.go", "root.go", "@import"),
    ])
    assert edges(spark, modules.go_edges, {k: v for k, v in texts.items() if k != "go.mod"}, more) == []


def test_rust_uses_and_mods(spark):
    texts = {
        "src/main.rs": "mod auth;\npub mod gone;\nuse crate::auth::login::Handler;\nuse crate::api::{post, get as g};\nuse crate::handlers::*;\nuse serde::Deserialize;\nuse std::fmt;\nuse crate::auth::Login as L;",
        "src/auth/login.rs": "use super::serializers::Foo;\nuse self::helpers::utils;\npub use crate::auth::login::Me;",
    }
    more = ["src/auth/mod.rs", "src/api.rs", "src/api/mod.rs", "src/handlers/mod.rs", "src/serializers.rs", "src/auth/helpers.rs"]
    assert edges(spark, modules.rust_edges, texts, more) == sorted([
        ("src/main.rs", "src/auth/mod.rs", "@import"), ("src/main.rs", "src/auth/login.rs", "Handler"), ("src/main.rs", "src/api.rs", "post"), ("src/main.rs", "src/api.rs", "get"), ("src/main.rs", "src/handlers/mod.rs", "*"), ("src/main.rs", "src/auth/mod.rs", "Login"),
        ("src/auth/login.rs", "src/serializers.rs", "Foo"), ("src/auth/login.rs", "src/auth/helpers.rs", "utils"),
    ])
    assert edges(spark, modules.rust_edges, {"main.rs": "mod a;\nuse crate::a::X;"}, ["a.rs"]) == [("main.rs", "a.rs", "@import"), ("main.rs", "a.rs", "X")]


@pytest.mark.parametrize("content", [None, "", "import\nfrom\nuse crate;\nmod ;\n"])
def test_nothing_to_import(spark, content):
    assert edges(spark, extract.symbol_graph, {"a.py": content, "b.go": content, "c.rs": content, "d.ts": content, "go.mod": content}) == []


def test_each_import_is_looked_up_once(spark):
    """Imports take part in the join as they are; their possible files are not written out."""
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/a.tsx", "src/b/index.ts", "src/b.js", "src/c.tsx", "src/d.js", "src/d.ts", "src/e.tsx")], "path string")
    asked = [("m.ts", "@/a", "x"), ("m.ts", "~/a", "x"), ("m.ts", "@/b", "y"), ("src/m.ts", "./c.js", "z"), ("src/m.ts", "./d.js", "z"), ("src/m.ts", "../src/e.mjs", "*"), ("m.ts", "@/none", "x"), ("m.ts", "react", "x")]
    got = extract.resolved(spark.createDataFrame(asked, "path string, module string, symbol string"), files)
    want = [("m.ts", "src/a.ts", "x"), ("m.ts", "src/b.js", "y"), ("src/m.ts", "src/c.tsx", "z"), ("src/m.ts", "src/d.js", "z"), ("src/m.ts", "src/e.tsx", "*")]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()
