"""Imports of Python, Go and Rust as edges between files.

Each language names modules in a way of its own: dotted names from the importing file or from a package
root, import paths below the module path of go.mod, and crate paths over the module tree. An import becomes
the few paths that may hold its module, in order; those meet the repository's files as keys, and the first
that exists is the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roots below which a Python package may lie, after the repository itself.
PY_ROOTS = ("", "apps/", "src/", "lib/", "packages/")
PY_FROM = r"(?m)^[ \t]*from[ \t]+(\.+|[\w.]+(?:\.\w+)*)[ \t]+import[ \t]+(\([^)]*\)|[^\n#]+)"
PY_IMPORT = r"(?m)^[ \t]*import[ \t]+([\w.]+)"
GO_ONE = r"(?m)^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?\"[^\"]+\""
GO_BLOCK = r"(?m)^[ \t]*import[ \t]*\(\s*([^)]*)\)"
GO_CALL = r"\b\w+\.[A-Z]\w*\s*[(.]"
RS_USE = r"(?m)^\s*(?:pub\s+)?use[ \t]+((?:crate|super|self)(?:::(?:\w+|\*|\{[^}]*\}))+)(?:[ \t]+as[ \t]+\w+)?\s*;"
RS_MOD = r"(?m)^\s*(?:pub\s+)?mod[ \t]+(\w+)\s*;"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _folder(path: Column) -> Column:
    """The folder of a path, empty for the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _first_hit(tried: DataFrame, files: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, dst): of `tried` (keep, i, dst) the row of smallest i whose file exists."""
    hit = tried.where("dst is not null").join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    return hit.groupBy(*keep).agg(F.min_by("dst", "i").alias("dst"))


def _imported(names: Column) -> Column:
    """Names of a list between commas, without their aliases."""
    parts = F.transform(F.split(names, ","), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"(?s)\s+as\s.*$", ""))
    return F.array_distinct(F.array_remove(parts, ""))


def python_edges(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, symbol): `from m import a, b` gives names, or `*`; `import m` gives `@import`.

    Leading dots walk up from the file's folder, once less than there are; other modules are looked for
    below the repository and then PY_ROOTS, as a file and then as a package. Modules outside have no edge.
    """
    py = sources.where(F.col("path").endswith(".py")).select("path", "content")
    froms = py.select("path", F.explode(_all(F.col("content"), PY_FROM, 0)).alias("s")).select("path", F.regexp_extract("s", PY_FROM, 1).alias("module"), F.explode(_imported(F.regexp_replace(F.regexp_extract("s", PY_FROM, 2), "[()]", ""))).alias("symbol"))
    bare = py.select("path", F.explode(_all(F.col("content"), PY_IMPORT, 1)).alias("module"), F.lit("@import").alias("symbol"))
    used = froms.unionByName(bare).distinct()
    dots = F.length("module") - F.length(F.ltrim("module", F.lit(".")))
    folder = F.array_remove(F.split(_folder(F.col("path")), "/"), "")
    up = F.size(folder) - dots + 1
    rest = F.array_remove(F.split(F.ltrim("module", F.lit(".")), r"\."), "")
    relative = F.when(up >= 0, F.array(F.array_join(F.concat(F.slice(folder, F.lit(1), F.greatest(up, F.lit(0))), rest), "/")))
    absolute = F.array(*[F.concat(F.lit(r), F.array_join(F.split("module", r"\."), "/")) for r in PY_ROOTS])
    bases = F.when(dots > 0, relative).otherwise(absolute)
    tries = F.flatten(F.transform(F.filter(bases, lambda b: b != ""), lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py")))))
    modules = used.select("path", "module").distinct()
    found = _first_hit(modules.select("path", "module", F.posexplode(tries).alias("i", "dst")), files, ["path", "module"])
    return used.join(found, ["path", "module"]).select(F.col("path").alias("src"), "dst", "symbol").distinct()


def go_edges(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, symbol): packages below the module path of the root's go.mod, each as its first file that is no test; symbols are the exported names that the file uses of the package, `@import` if none.

    A package goes by its alias, or the last part of its path; of two with one alias the later counts.
    """
    go = sources.where(F.col("path").endswith(".go")).select("path", "content")
    module = sources.where("path = 'go.mod'").select(F.regexp_extract("content", r"(?m)^\s*module\s+(\S+)", 1).alias("root")).where("root <> ''").limit(1)
    one = F.transform(_all(F.col("content"), GO_ONE, 0), lambda s: F.regexp_replace(s, r"^\s*import\s+", ""))
    block = F.filter(F.flatten(F.transform(_all(F.col("content"), GO_BLOCK, 1), lambda b: F.split(b, "\n"))), lambda s: s.rlike(r"^\s*(?:[\w.]+\s+)?\"[^\"]+\""))
    lines = go.select("path", F.posexplode(F.concat(one, block)).alias("i", "s"))
    target, name = F.regexp_extract("s", r"\"([^\"]+)\"", 1), F.regexp_extract("s", r"^\s*([\w.]+)\s+\"", 1)
    spec = lines.select("path", "i", target.alias("spec"), F.when(name != "", name).otherwise(F.substring_index(target, "/", -1)).alias("alias"))
    inside = spec.join(F.broadcast(module), F.expr("spec = root or startswith(spec, concat(root, '/'))"))  # one row
    package = files.select("path").where("path like '%.go' and path not like '%\\_test.go'").groupBy(_folder(F.col("path")).alias("dir")).agg(F.min("path").alias("dst"))
    met = inside.withColumn("dir", F.ltrim(F.expr("substring(spec, length(root) + 1)"), F.lit("/"))).join(package, "dir").where("dst <> path")
    one_each = met.groupBy("path", "alias").agg(F.max_by(F.struct("spec", "dst"), "i").alias("t")).select("path", "alias", "t.dst")
    calls = go.select("path", F.explode(F.array_distinct(_all(F.col("content"), GO_CALL, 0))).alias("s")).select("path", F.regexp_extract("s", r"^(\w+)\.", 1).alias("alias"), F.regexp_extract("s", r"\.(\w+)", 1).alias("symbol")).distinct()
    used = one_each.join(calls, ["path", "alias"])
    named = used.select(F.col("path").alias("src"), "dst", "symbol").distinct()
    every = met.select(F.col("path").alias("src"), "dst").distinct()
    return named.unionByName(every.join(named.select("src", "dst").distinct(), ["src", "dst"], "left_anti").withColumn("symbol", F.lit("@import")))


def rust_edges(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, symbol): `use crate::a::B`, `self::` and `super::` to the module's file with the last part's names (or `*`), and `mod a;` to the child module for its effects.

    crate:: starts in `src` if the repository has such a folder; a module is its file or its folder's mod.rs.
    """
    rs = sources.where(F.col("path").endswith(".rs")).select("path", "content")
    root = files.agg(F.coalesce(F.bool_or(F.col("path").startswith("src/")), F.lit(False)).alias("in_src"))
    use = rs.select("path", F.explode(_all(F.col("content"), RS_USE, 1)).alias("full"))
    last = F.regexp_extract("full", r"::(\w+|\*|\{[^}]*\})$", 1)
    names = F.when(last.startswith("{"), _imported(F.regexp_replace(last, "[{}]", ""))).otherwise(F.array(last))
    used = use.select("path", F.regexp_extract("full", r"^(.*)::(?:\w+|\*|\{[^}]*\})$", 1).alias("module"), F.explode(names).alias("symbol")).distinct()
    parts = F.split("module", "::")
    here = F.split("path", "/")
    head = F.element_at(parts, 1)
    base = F.when(head == "crate", F.when(F.col("in_src"), F.array(F.lit("src"))).otherwise(F.array().cast("array<string>"))).when(head == "self", F.slice(here, F.lit(1), F.size(here) - 1)).when(F.size(here) >= 2, F.slice(here, F.lit(1), F.greatest(F.size(here) - 2, F.lit(0))))
    stem = F.array_join(F.concat(base, F.slice(parts, F.lit(2), F.size(parts))), "/")
    child = rs.select("path", F.explode(_all(F.col("content"), RS_MOD, 1)).alias("module")).select("path", "module", F.lit("@import").alias("symbol"), F.concat_ws("/", F.nullif(_folder(F.col("path")), F.lit("")), "module").alias("stem"))
    both = used.join(F.broadcast(root)).select("path", "module", "symbol", stem.alias("stem")).unionByName(child).where("stem <> ''")  # one row
    tries = F.array(F.concat("stem", F.lit(".rs")), F.concat("stem", F.lit("/mod.rs")))
    found = _first_hit(both.select("path", "stem", F.posexplode(tries).alias("i", "dst")).distinct(), files, ["path", "stem"])
    return both.join(found, ["path", "stem"]).where("dst <> path").select(F.col("path").alias("src"), "dst", "symbol").distinct()


def module_edges(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, symbol) of all three languages. sources: (path, content); files: (path)."""
    return python_edges(sources, files).unionByName(go_edges(sources, files)).unionByName(rust_edges(sources, files))
