"""Symbols, imports, routes and calls out of source text, by regular expressions in the engine.

`sources` is (path, content). Contents are taken apart line by line, so one long file is many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from .modules import module_edges

_TS, _PY, _GO, _RS = r"\.(?:ts|tsx|js|jsx|mjs)$", r"\.py$", r"\.go$", r"\.rs$"

#: Fixed values: (path pattern, kind, pattern of a line whose first group is the name).
DECLARATIONS = (
    (_TS, "function", r"^export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), (_TS, "class", r"^export\s+(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), (_TS, "const", r"^export\s+(?:const|let|var)\s+(\w+)"),
    (_TS, "type", r"^export\s+(?:type|interface)\s+(\w+)"), (_TS, "enum", r"^export\s+(?:const\s+)?enum\s+(\w+)"),
    (_PY, "function", r"^(?:async\s+)?def\s+([A-Za-z]\w*)"), (_PY, "class", r"^class\s+([A-Za-z]\w*)"), (_PY, "const", r"^([A-Z][A-Z0-9_]+)\s*(?::[^=]+)?="),
    (_GO, "function", r"^func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)"), (_GO, "type", r"^type\s+([A-Z]\w*)"), (_GO, "const", r"^(?:var|const)\s+([A-Z]\w*)"),
    (_RS, "function", r"^\s*pub(?:\([^)]*\))?\s+(?:async\s+)?fn\s+(\w+)"), (_RS, "class", r"^\s*pub(?:\([^)]*\))?\s+(?:struct|trait)\s+(\w+)"), (_RS, "enum", r"^\s*pub(?:\([^)]*\))?\s+enum\s+(\w+)"),
)


def lines(sources: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1. Null contents have none."""
    return sources.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def declarations(sources: DataFrame) -> DataFrame:
    """(path, name, kind, start): exported symbols; the first of equal names in a file counts."""
    found = F.array_compact(F.array(*[F.when(F.col("path").rlike(where) & F.col("text").rlike(pattern), F.struct(F.regexp_extract("text", pattern, 1).alias("name"), F.lit(kind).alias("kind"))) for where, kind, pattern in DECLARATIONS]))
    each = lines(sources).select("path", "line", F.inline(found).alias("name", "kind"))
    return each.groupBy("path", "name").agg(F.min("line").alias("start"), F.min_by("kind", "line").alias("kind"))


def symbol_table(sources: DataFrame) -> DataFrame:
    """(path, name, kind, start, stop): a symbol ends before the next one starts, the last at the end of the file."""
    n = sources.select("path", F.size(F.split("content", "\n")).alias("n"))
    nxt = F.lead("start").over(W.partitionBy("path").orderBy("start", "name")) - 1
    return declarations(sources).join(n, "path").select("path", "name", "kind", "start", F.greatest("start", F.coalesce(nxt, "n")).alias("stop"))


def _named(text: Column) -> Column:
    """Names inside the braces of an import, without their aliases."""
    inner = F.regexp_extract(text, r"\{([^}]*)\}", 1)
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+as\s+.*$", ""), r"^type\s+", ""))
    return F.array_remove(parts, "")


def imports(sources: DataFrame) -> DataFrame:
    """(path, module, symbol): what each file imports. `*` stands for all of a module, `default` for its default, `@import` for nothing but its effects."""
    return imported(sources).distinct()


def imported(sources: DataFrame) -> DataFrame:
    """As `imports`, with repeats: for what makes its own rows distinct."""
    text = F.regexp_replace("content", r"\n\s*(?=[^\n;]*\}\s*from)", " ")
    statement = r"""((?:import|export)\b[^;'"]*?from\s*['"][^'"]+['"]|import\s*\(?\s*['"][^'"]+['"]|require\(\s*['"][^'"]+['"])"""
    ts = sources.where(F.col("path").rlike(_TS)).select("path", F.explode(F.regexp_extract_all(text, F.lit(statement))).alias("s"))
    module = F.regexp_extract("s", r"""['"]([^'"]+)['"]""", 1)
    head = F.regexp_extract("s", r"^(?:import|export)\s+(?:type\s+)?(\w+)\s*(?:,|from)", 1)
    named = _named(F.col("s"))
    star = F.col("s").rlike(r"^(?:import|export)\s+(?:\w+\s*,\s*)?\*")
    effect = F.col("s").rlike(r"""^import\s*['"]""")
    whole = F.col("s").rlike(r"""^import\s*\(|^require""")
    symbols = F.when(effect, F.array(F.lit("@import"))).when(whole, F.array(F.lit("*"))).otherwise(F.concat(F.when(head != "", F.array(F.lit("default"))).otherwise(F.array().cast("array<string>")), named, F.when(star, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))))
    out = ts.select("path", module.alias("module"), F.explode(symbols).alias("symbol"))
    py = lines(sources.where(F.col("path").rlike(_PY)))
    frm = r"^from\s+([\w.]+)\s+import\s+\(?([^#)]*)"
    parts = F.array_remove(F.transform(F.split(F.regexp_extract("text", frm, 2), ","), lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+.*$", "")), "")
    out = out.unionByName(py.where(F.col("text").rlike(frm)).select("path", F.regexp_extract("text", frm, 1).alias("module"), F.explode(parts).alias("symbol")))
    out = out.unionByName(py.where(F.col("text").rlike(r"^import\s+[\w.]+")).select("path", F.explode(F.transform(F.split(F.regexp_extract("text", r"^import\s+([^#]+)", 1), ","), lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+.*$", ""))).alias("module"), F.lit("*").alias("symbol")))
    go = lines(sources.where(F.col("path").rlike(_GO))).where(F.col("text").rlike(r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"[^"]+"\s*$""")).select("path", F.regexp_extract("text", r'"([^"]+)"', 1).alias("module"), F.lit("*").alias("symbol"))
    use = r"^\s*(?:pub\s+)?use\s+((?:\w+::)*\w+)::(?:\{([^}]*)\}|(\w+|\*))"
    rs = lines(sources.where(F.col("path").rlike(_RS))).where(F.col("text").rlike(use))
    many = F.array_remove(F.transform(F.split(F.regexp_extract("text", use, 2), ","), lambda x: F.trim(x)), "")
    rs = rs.select("path", F.regexp_extract("text", use, 1).alias("module"), F.explode(F.when(F.size(many) > 0, many).otherwise(F.array(F.regexp_extract("text", use, 3)))).alias("symbol"))
    return out.unionByName(go).unionByName(rs)


_CANDIDATES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py")


def resolved(found: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(src, dst, symbol): imports whose module is a file of `files` (path): relative specifiers and alias prefixes, with the first extension or index file that exists.

    Files are listed under every stem that they answer to, so each import is looked up once.
    """
    spec = F.col("module")
    base = F.when(spec.startswith("."), F.concat(P.parent(F.col("path")), F.lit("/"), spec))
    for prefix, target in (aliases or {"@/": "src/", "~/": "src/"}).items():
        base = F.when(spec.startswith(prefix), F.concat(F.lit(target), F.substr(spec, F.lit(len(prefix) + 1)))).otherwise(base)

    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(base, "/"), F.array().cast("array<string>"), step)
    stem = F.array_join(parts, "/")
    # (what a file ends with, what its importers write instead); a script's name may stand for the typed file of that name
    endings = [(c, "") for c in _CANDIDATES] + [(c, x) for c in _CANDIDATES[1:3] for x in (".js", ".jsx", ".mjs")]
    names = [F.when(F.col("dst").endswith(c), F.struct(F.lit(i).alias("i"), F.concat(F.substr("dst", F.lit(1), F.length("dst") - len(c)), F.lit(x)).alias("stem"))) for i, (c, x) in enumerate(endings)]
    known = files.select(F.col("path").alias("dst")).distinct().select("dst", F.inline(F.array_compact(F.array(*names))))
    first = known.groupBy("stem").agg(F.min_by("dst", "i").alias("dst")).hint("merge")
    return found.where(base.isNotNull()).select(F.col("path").alias("src"), stem.alias("stem"), "symbol").join(first, "stem").select("src", "dst", "symbol").distinct()


_VERB = "get|post|put|patch|delete|head|options"


def routes(sources: DataFrame) -> DataFrame:
    """(path, method, pattern, framework): server routes of file-routed apps, router objects and decorators; patterns are normalised."""
    ls = lines(sources)
    verb = r"^export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
    app = ls.where(F.col("path").rlike(r"(?:^|/)app/.*route\.(?:ts|js)$") & F.col("text").rlike(verb))
    inner = F.regexp_replace(F.regexp_replace("path", r"^(?:.*/)?app/", "/"), r"/route\.(?:ts|js)$", "")
    inner = F.regexp_replace(inner, r"/\([^)]*\)", "")
    a = app.select("path", F.regexp_extract("text", verb, 1).alias("method"), P.api_pattern(inner).alias("pattern"), F.lit("app-router").alias("framework"))
    page = F.regexp_replace(F.regexp_replace("path", r"^(?:.*/)?pages/", "/"), r"(?:/index)?\.(?:ts|js|tsx|jsx)$", "")
    b = sources.where(F.col("path").rlike(r"(?:^|/)pages/api/.*\.(?:ts|js|tsx|jsx)$")).select("path", F.lit("*").alias("method"), P.api_pattern(page).alias("pattern"), F.lit("pages-router").alias("framework"))
    router = rf"""\b(?:app|router|server)\.({_VERB})\(\s*['"`]([^'"`]+)['"`]"""
    c = ls.where(F.col("path").rlike(_TS) & F.col("text").rlike(router)).select("path", F.upper(F.regexp_extract("text", router, 1)).alias("method"), P.api_pattern(F.regexp_extract("text", router, 2)).alias("pattern"), F.lit("express").alias("framework"))
    mark = rf"""^\s*@\w+\.({_VERB})\(\s*['"]([^'"]*)['"]"""
    d = ls.where(F.col("path").rlike(_PY) & F.col("text").rlike(mark)).select("path", F.upper(F.regexp_extract("text", mark, 1)).alias("method"), P.api_pattern(F.regexp_extract("text", mark, 2)).alias("pattern"), F.lit("fastapi").alias("framework"))
    proc = r"^\s*(\w+)\s*:\s*\w*[pP]rocedure\b.*\.(query|mutation)\("
    e = ls.where(F.col("path").rlike(_TS) & F.col("text").rlike(proc)).select("path", F.lit("*").alias("method"), F.concat(F.lit("trpc:"), F.regexp_extract("text", proc, 1)).alias("pattern"), F.lit("trpc").alias("framework"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e).distinct()


def client_calls(sources: DataFrame) -> DataFrame:
    """(path, line, method, pattern, kind): fetch, axios, openapi clients and trpc hooks; `${x}` in a template is a parameter."""
    ls = lines(sources.where(F.col("path").rlike(_TS)))
    fetch = r"""\bfetch\(\s*['"`]([^'"`]+)['"`]"""
    method = F.upper(F.coalesce(F.nullif(F.regexp_extract("text", r"""method\s*:\s*['"](\w+)['"]""", 1), F.lit("")), F.lit("GET")))
    url = lambda p, g: P.api_pattern(P.url_path(F.regexp_replace(F.regexp_extract("text", p, g), r"\$\{[^}]*\}", ":x")))
    a = ls.where(F.col("text").rlike(fetch)).select("path", "line", method.alias("method"), url(fetch, 1).alias("pattern"), F.lit("fetch").alias("kind"))
    ax = rf"""\baxios\.({_VERB})\(\s*['"`]([^'"`]+)['"`]"""
    b = ls.where(F.col("text").rlike(ax)).select("path", "line", F.upper(F.regexp_extract("text", ax, 1)).alias("method"), url(ax, 2).alias("pattern"), F.lit("axios").alias("kind"))
    oa = r"""\bclient\.(GET|POST|PUT|PATCH|DELETE)\(\s*['"`]([^'"`]+)['"`]"""
    c = ls.where(F.col("text").rlike(oa)).select("path", "line", F.regexp_extract("text", oa, 1).alias("method"), url(oa, 2).alias("pattern"), F.lit("openapi").alias("kind"))
    tr = r"\btrpc\.(?:\w+\.)*(\w+)\.use(?:Query|Mutation)\("
    d = ls.where(F.col("text").rlike(tr)).select("path", "line", F.lit("*").alias("method"), F.concat(F.lit("trpc:"), F.regexp_extract("text", tr, 1)).alias("pattern"), F.lit("trpc").alias("kind"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def http_edges(calls: DataFrame, served: DataFrame) -> DataFrame:
    """(src, dst, symbol): client files to the server files that their calls reach; symbol is `@http`. Both sides meet on the number of segments and on all of them before the route's first parameter, so no call is held against every route."""
    segments = lambda c: F.split(c, "/")
    r = served.select(F.col("path").alias("dst"), F.col("method").alias("verb"), F.col("pattern").alias("route"), F.size(segments("pattern")).alias("n"), F.substring_index("pattern", ":*", 1).alias("fixed"))
    r = r.withColumn("fixed", F.when(F.col("fixed") == F.col("route"), F.col("fixed")).otherwise(F.regexp_replace("fixed", "/[^/]*$", "")))
    starts = F.transform(F.sequence(F.lit(1), F.size(segments("pattern"))), lambda i: F.array_join(F.slice(segments("pattern"), F.lit(1), i), "/"))
    calls = calls.withColumn("n", F.size(segments("pattern"))).withColumn("fixed", F.explode(F.array_distinct(starts)))
    same = (calls["n"] == r["n"]) & (calls["fixed"] == r["fixed"])
    quoted = F.regexp_replace(F.col("route"), r"([.\\+*?\[^\]$(){}=!<>|:#-])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.replace(quoted, F.lit(r"\:\*"), F.lit("[^/]+")), F.lit("$"))
    met = calls.join(r, same).where((F.col("method") == F.col("verb")) | (F.col("method") == "*") | (F.col("verb") == "*"))
    return met.where((F.col("pattern") == F.col("route")) | F.rlike("pattern", pattern)).select(F.col("path").alias("src"), "dst", F.lit("@http").alias("symbol")).distinct()


def symbol_graph(sources: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(src, dst, symbol): imports of all languages that resolve to a file of `files` (path), and calls of clients to the servers of their routes."""
    scripts = resolved(imports(sources.where(F.col("path").rlike(_TS))), files, aliases)
    return scripts.unionByName(module_edges(sources, files)).unionByName(http_edges(client_calls(sources), routes(sources))).distinct()


def reversed_graph(graph: DataFrame) -> DataFrame:
    """(path, callers, symbols): who depends on each file, and on which of its symbols."""
    return graph.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("callers"), F.array_join(F.array_sort(F.collect_set("symbol")), "|").alias("symbols"))


def signatures(sources: DataFrame) -> DataFrame:
    """(path, exports, imports, routes): what each file declares in order of lines, the modules that it imports and the routes that it serves."""
    gathered = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    own = declarations(sources).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "name"))), lambda x: x["name"]), "|").alias("exports"))
    used = imports(sources).groupBy("path").agg(gathered("module").alias("imports"))
    served = routes(sources).groupBy("path").agg(gathered(F.concat_ws(" ", "method", "pattern")).alias("routes"))
    met = sources.select("path").distinct().join(own, "path", "left").join(used, "path", "left").join(served, "path", "left")
    return met.na.fill("", ["exports", "imports", "routes"])


def test_map(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(test, target, how): what each test file tests: what it imports, else the file of its own name, else null."""
    tests = files.where(P.is_test_path_regex(F.col("path"))).select(F.col("path").alias("test"))
    plain = files.where(~P.is_test_path_regex(F.col("path"))).select(F.col("path").alias("target"))
    by_import = tests.join(edges.select(F.col("src").alias("test"), F.col("dst").alias("target")), "test").join(plain, "target").distinct().withColumn("how", F.lit("import"))
    stem = lambda c: F.regexp_replace(F.regexp_replace(P.file_name(F.col(c)), r"\.[a-z]+$", ""), r"(?:\.test|\.spec|_test)$|^test_", "")
    rest = tests.join(by_import, "test", "left_anti").withColumn("stem", stem("test"))
    named = rest.join(plain.withColumn("stem", stem("target")), "stem").groupBy("test").agg(F.min("target").alias("target")).withColumn("how", F.lit("name"))
    mapped = by_import.select("test", "target", "how").unionByName(named.select("test", "target", "how"))
    none = tests.join(mapped, "test", "left_anti").select("test", F.lit(None).cast("string").alias("target"), F.lit("unmapped").alias("how"))
    return mapped.unionByName(none)


test_map.__test__ = False
