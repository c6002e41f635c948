"""Extraction over source texts of several languages, coverage and blame reports, sinks, and features by structure.

Each file gets the path and the text of one of CASES, by its number; what a case should give is written down
beside it and joined by that number in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import discovery as V
from ..operators import extract as X
from ..operators import rules as R
from ..sources import bridge as B
from ..sources import coverage as K
from ..sources import history as H
from ..sources import sinks as O
from .features import BASE, METRICS, feature_metrics
from .functions import q
from .registry import query

#: (path, content, declarations (name, kind, start, stop), imports (module, symbol), routes (method, pattern, framework), calls (line, method, pattern, kind)); {n} is the file's number.
CASES = (
    ("src/a{n}/list.ts", "import { x, y as z } from '@/shared/util'\nimport def from './none'\nimport * as ns from \"../b/ns\"\nimport './side.css'\n\nexport async function f{n}() {}\nexport class C{n} {}\nexport default function main() {}\n",
     (("f{n}", "function", 6, 6), ("C{n}", "class", 7, 7), ("main", "function", 8, 9)), (("@/shared/util", "x"), ("@/shared/util", "y"), ("./none", "default"), ("../b/ns", "*"), ("./side.css", "@import")), (), ()),
    ("app/u{n}/[id]/route.ts", "export async function GET(req) {\n  return 1\n}\nexport const POST = f\nfunction hidden() {}\n", (("GET", "function", 1, 3), ("POST", "const", 4, 6)), (), (("GET", "/u{n}/:*", "app-router"), ("POST", "/u{n}/:*", "app-router")), ()),
    ("src/ui/Call{n}.tsx", "export type P = { a: 1 }\nconst a = fetch(`/u{m}/${id}?x=1`, { method: 'POST' })\naxios.delete('/py/{k}')\nclient.GET('/none/{n}')\ntrpc.user.byId{t}.useQuery(1)\nexport enum E { A }\n",
     (("P", "type", 1, 5), ("E", "enum", 6, 7)), (), (), ((2, "POST", "/u{m}/:*", "fetch"), (3, "DELETE", "/py/{k}", "axios"), (4, "GET", "/none/{n}", "openapi"), (5, "*", "trpc:byId{t}", "trpc"))),
    ("pkg/m{n}.py", "from pkg.mod import a, b as c\nimport os, sys as s\n\n@router.delete('/py/{n}')\nasync def run_{n}():\n    pass\nclass K{n}:\n    def inner(self): ...\nLIMIT = 3\n_hidden = 4\n",
     (("run_{n}", "function", 5, 6), ("K{n}", "class", 7, 8), ("LIMIT", "const", 9, 11)), (("pkg.mod", "a"), ("pkg.mod", "b"), ("os", "*"), ("sys", "*")), (("DELETE", "/py/{n}", "fastapi"),), ()),
    ("internal/s{n}.go", "package s\n\nimport \"fmt\"\n\nfunc (s *S) Do{n}() {}\ntype T{n} struct {}\nfunc private() {}\nvar Limit = 1\n", (("Do{n}", "function", 5, 5), ("T{n}", "type", 6, 7), ("Limit", "const", 8, 9)), (("fmt", "*"),), (), ()),
    ("src/lib{n}.rs", "use crate::db::{Pool, Row};\nuse std::fmt::Display;\npub async fn go{n}() {}\n  pub struct St{n};\nfn hidden() {}\npub enum En { A }\n", (("go{n}", "function", 3, 3), ("St{n}", "class", 4, 5), ("En", "enum", 6, 7)), (("crate::db", "Pool"), ("crate::db", "Row"), ("std::fmt", "Display")), (), ()),
    ("pages/api/p{n}/[...rest].ts", "export * from '../../shared/all'\nrouter.put('/ex/{n}/:name', h)\nconst t = require('./lazy')\n  byId{n}: publicProcedure.input(z).query(() => 1),\n", (), (("../../shared/all", "*"), ("./lazy", "*")), (("*", "/api/p{n}/:*", "pages-router"), ("PUT", "/ex/{n}/:*", "express"), ("*", "trpc:byId{n}", "trpc")), ()),
    ("src/plain{n}.ts", "// nothing is exported here\nconst x = 1\n", (), (), (), ()),
)
#: {m}: the number of a file with the second case, {k} and {t}: of one with the fourth and the seventh, near n.
_FILLED = {"{n}": "part", "{m}": f"part - part % {len(CASES)} + 1", "{k}": f"part - part % {len(CASES)} + 3", "{t}": f"part - part % {len(CASES)} + 6"}


def filled(template: str) -> str:
    """SQL of a template, in both engines."""
    out = q(template)
    for mark, number in _FILLED.items():
        out = f"replace({out}, '{mark}', CAST({number} AS VARCHAR))" if mark in template else out
    return out


def spark_filled(template: str):
    out = F.lit(template)
    for mark, number in _FILLED.items():
        if mark in template:
            out = F.replace(out, F.lit(mark), F.expr(f"cast({number} as string)"))
    return out


def sources(spark, d):
    """(path, content)."""
    i = F.col("part") % len(CASES)
    path = content = F.lit(None).cast("string")
    for j, case in enumerate(CASES):
        path, content = F.when(i == j, spark_filled(case[0])).otherwise(path), F.when(i == j, spark_filled(case[1])).otherwise(content)
    return B.files(spark, d).select(path.alias("path"), content.alias("content"))


def expected(at: int, names: str, numbers: tuple[int, ...] = ()) -> str:
    """SELECT of what the cases should give: (path, names)."""
    columns = names.split()
    selects = []
    for j, case in enumerate(CASES):
        for row in case[at]:
            own = [f"{v} AS {c}" if k in numbers else f"{filled(str(v))} AS {c}" for k, (v, c) in enumerate(zip(row, columns, strict=True))]
            selects.append(f"SELECT {filled(case[0])} AS path, {', '.join(own)} FROM files WHERE part % {len(CASES)} = {j}")
    return " UNION ALL ".join(selects)


@query("tx2_declarations", expected(2, "name kind start stop", (2, 3)), "files")
def tx2(spark, d):
    return X.symbol_table(sources(spark, d))


@query("tx5_imports", f"SELECT DISTINCT * FROM ({expected(3, 'module symbol')})", "files")
def tx5(spark, d):
    """Imports of all languages at hand."""
    return X.imports(sources(spark, d))


@query("tx7_routes", expected(4, "method pattern framework"), "files")
def tx7(spark, d):
    return X.routes(sources(spark, d))


@query("tx8_client_calls", expected(5, "line method pattern kind", (0,)), "files")
def tx8(spark, d):
    return X.client_calls(sources(spark, d))


ROUTES = f"ro AS ({expected(4, 'method pattern framework')}), ca AS ({expected(5, 'line method pattern kind', (0,))}), he AS (SELECT DISTINCT ca.path AS src, ro.path AS dst, '@http' AS symbol FROM ca JOIN ro ON ca.pattern = ro.pattern AND (ca.method = ro.method OR ca.method = '*' OR ro.method = '*'))"
SHARED = "src/shared/util.ts"
CALLER = "package g\nimport (\n\tst \"example.com/app/store\"\n\t\"fmt\"\n)\nfunc F() { st.Open(1) }\n"
SILENT = "package g\nimport _ \"example.com/app/store\"\n"
#: Edges of the other languages: packages, a crate's module, a folder below go.mod.
MODULES = f"""SELECT {filled(CASES[3][0])} AS src, 'pkg/mod.py' AS dst, symbol FROM files, (SELECT unnest(['a', 'b']) AS symbol) WHERE part % {len(CASES)} = 3 UNION SELECT {filled(CASES[5][0])}, 'src/db.rs', symbol FROM files, (SELECT unnest(['Pool', 'Row']) AS symbol) WHERE part % {len(CASES)} = 5
 UNION SELECT 'internal/g' || part || '.go', 'store/a.go', CASE WHEN part % 3 = 0 THEN '@import' ELSE 'Open' END FROM files WHERE part % 8 = 4"""
GRAPH = f"{ROUTES}, im AS (SELECT DISTINCT path AS src, {q(SHARED)} AS dst, symbol FROM ({expected(3, 'module symbol')}) WHERE module = '@/shared/util'), mo AS ({MODULES}), gr AS (SELECT * FROM he UNION SELECT * FROM im UNION SELECT * FROM mo)"


def graph(spark, d):
    """Imports of four languages between files and calls between client and server, forward."""
    go = B.files(spark, d).where("part % 8 = 4").select(F.concat(F.lit("internal/g"), F.col("part").cast("string"), F.lit(".go")).alias("path"), F.when(F.col("part") % 3 == 0, SILENT).otherwise(CALLER).alias("content"))
    s = sources(spark, d).unionByName(go).unionByName(spark.createDataFrame([("go.mod", "module example.com/app\n")], "path string, content string"))
    more = [(SHARED,), ("pkg/mod.py",), ("pkg/mod/__init__.py",), ("src/pkg/mod.py",), ("src/db.rs",), ("src/db/mod.rs",), ("store/a.go",), ("store/a_test.go",), ("store/b.go",)]
    return X.symbol_graph(s, s.select("path").unionByName(spark.createDataFrame(more, "path string")))


@query("gr4_symbol_graph", f"WITH {GRAPH} SELECT src, dst, symbol FROM gr", "files")
def gr4(spark, d):
    return graph(spark, d)


@query("gr4_reverse_graph", f"WITH {GRAPH} SELECT dst AS path, count(DISTINCT src) AS callers, string_agg(DISTINCT symbol, '|' ORDER BY symbol) AS symbols FROM gr GROUP BY 1", "files")
def gr4_reverse(spark, d):
    return X.reversed_graph(graph(spark, d))


@query("sc10_signatures", f"WITH de AS ({expected(2, 'name kind start stop', (2, 3))}), im AS ({expected(3, 'module symbol')}), ro AS ({expected(4, 'method pattern framework')}), al AS ({' UNION ALL '.join(f'SELECT {filled(c[0])} AS path FROM files WHERE part % {len(CASES)} = {j}' for j, c in enumerate(CASES))}) SELECT path, coalesce((SELECT string_agg(name, '|' ORDER BY start) FROM de WHERE de.path = al.path), '') AS exports, coalesce((SELECT string_agg(DISTINCT module, '|' ORDER BY module) FROM im WHERE im.path = al.path), '') AS imports, coalesce((SELECT string_agg(method || ' ' || pattern, '|' ORDER BY method || ' ' || pattern) FROM ro WHERE ro.path = al.path), '') AS routes FROM al", "files")
def sc10(spark, d):
    return X.signatures(sources(spark, d))


BLAMED = "SELECT path, line, lpad(lower(to_hex(sha)), 40, '0') AS sha FROM blame_lines"


@query("sc5_line_blame", BLAMED, "blame_lines")
def sc5(spark, d):
    """Porcelain text of each file's blame, parsed again."""
    line = F.format_string("%s %d %d 1\nauthor A\n\tcode of sha 0", F.lpad(F.lower(F.hex("sha")), 40, "0"), F.col("line"), F.col("line"))
    text = B.blame_lines(spark, d).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", line.alias("t")))), lambda x: x["t"]), "\n").alias("value"))
    return H.parsed_blame(text)


@query("sc11_owner_rules", "WITH f AS (SELECT DISTINCT feature FROM files) SELECT '@org/team' || length(feature) AS team, string_agg('/src/' || feature || '/', '|' ORDER BY '/src/' || feature || '/') AS patterns FROM f GROUP BY 1 UNION ALL SELECT '@all', string_agg('/src/' || feature || '/', '|' ORDER BY '/src/' || feature || '/') FROM f WHERE feature LIKE '%1'", "files")
def sc11(spark, d):
    f = B.files(spark, d).select("feature").distinct()
    more = F.when(F.col("feature").endswith("1"), " @all").otherwise(" # @nobody")
    text = f.select(F.concat(F.lit("/src/"), "feature", F.lit("/ @org/team"), F.length("feature").cast("string"), more).alias("value")).unionByName(spark.createDataFrame([("# a comment @x",), ("",)], "value string"))
    return H.code_owners(text).select("team", F.array_join("patterns", "|").alias("patterns"))


REPORTED = "cr AS (SELECT feature, path, line, hits, CAST(substr(feature, 6) AS INTEGER) % 4 AS k FROM coverage_lines JOIN files USING (path))"


def reports(spark, d):
    """(repo, name, value): one report of each feature, in one of four formats, behind an empty one that is looked at first. A report comes in texts of the files of a thousand parts at most."""
    rows = F.array_sort(F.collect_list(F.struct("line", "hits")))
    per = B.coverage_lines(spark, d).groupBy("path").agg(rows.alias("rows")).join(B.files(spark, d).select("path", "feature", F.expr("part div 1000").alias("shard")).hint("merge"), "path").withColumn("k", F.substr("feature", F.lit(6)).cast("int") % 4)
    lcov = F.concat(F.lit("TN:\nSF:"), "path", F.lit("\n"), F.array_join(F.transform("rows", lambda x: F.concat_ws(",", F.concat(F.lit("DA:"), x["line"].cast("string")), x["hits"].cast("string"))), "\n"), F.lit("\nDA:bad,1\nend_of_record"))
    lines = lambda hits: F.array_join(F.transform(F.filter("rows", lambda x: (x["hits"] > 0) == F.lit(hits)), lambda x: x["line"].cast("string")), ",")
    py = F.concat(F.lit('"'), "path", F.lit('": {"executed_lines": ['), lines(True), F.lit('], "missing_lines": ['), lines(False), F.lit("]}"))
    statements = F.array_join(F.transform("rows", lambda x, i: F.concat(F.lit('"'), i.cast("string"), F.lit('": {"start": {"line": '), x["line"].cast("string"), F.lit("}}"))), ", ")
    counts = F.array_join(F.transform("rows", lambda x, i: F.concat(F.lit('"'), i.cast("string"), F.lit('": '), x["hits"].cast("string"))), ", ")
    jest = F.concat(F.lit('"/abs/'), "path", F.lit('": {"path": "'), "path", F.lit('", "statementMap": {'), statements, F.lit('}, "s": {'), counts, F.lit("}}"))
    xml = F.concat(F.lit('<class filename="'), "path", F.lit('"><methods/><lines>'), F.array_join(F.transform("rows", lambda x: F.concat(F.lit('<line number="'), x["line"].cast("string"), F.lit('" hits="'), x["hits"].cast("string"), F.lit('"/>'))), ""), F.lit("</lines></class>"))
    part = F.when(F.col("k") == 0, lcov).when(F.col("k") == 1, py).when(F.col("k") == 2, jest).otherwise(xml)
    whole = per.groupBy("feature", "k", "shard").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = lambda by: F.array_join("parts", by)
    value = F.when(F.col("k") == 0, joined("\n")).when(F.col("k") == 1, F.concat(F.lit('{"files": {'), joined(", "), F.lit("}}"))).when(F.col("k") == 2, F.concat(F.lit("{"), joined(", "), F.lit("}"))).otherwise(F.concat(F.lit("<coverage><packages><package><classes>"), joined(""), F.lit("</classes></package></packages></coverage>")))
    name = F.when(F.col("k") == 0, "coverage/lcov.info").when(F.col("k") == 1, "coverage.json").when(F.col("k") == 2, "coverage/coverage-final.json").otherwise("coverage.xml")
    real = whole.select(F.col("feature").alias("repo"), name.alias("name"), value.alias("value"))
    features = B.files(spark, d).select("feature", (F.substr("feature", F.lit(6)).cast("int") % 4).alias("k")).distinct()
    empty = features.where("k <> 1").select(F.col("feature").alias("repo"), F.lit("coverage.json").alias("name"), F.lit('{"files": {}}').alias("value"))
    late = features.where("k <> 0").select(F.col("feature").alias("repo"), F.lit("lcov.info").alias("name"), F.lit("SF:late.ts\nDA:1,1\nend_of_record").alias("value"))
    return real.unionByName(empty).unionByName(late)


@query("sc8_line_coverage", f"WITH {REPORTED} SELECT feature AS repo, path, line, hits FROM cr", "coverage_lines")
def sc8(spark, d):
    return K.detected(reports(spark, d)).select("repo", "path", "line", "hits")


@query("sc7_file_coverage", f"WITH {REPORTED} SELECT feature AS repo, path, round(100.0 * count(*) FILTER (hits > 0) / count(*), 1) AS pct FROM cr GROUP BY 1, 2", "coverage_lines")
def sc7(spark, d):
    return K.file_coverage(K.detected(reports(spark, d)), ["repo", "path"])


@query("sk1_feature_documents", f"WITH {METRICS}, p AS (SELECT feature, count(*) AS paths, min(path) AS first FROM feature_files GROUP BY 1) SELECT feature, total_commits, bug_fixes, round(health, 3) AS health, paths, first FROM metrics JOIN p USING (feature)", BASE)
def sk1(spark, d):
    """The map's documents written out as JSON and read back."""
    ff = B.feature_files(spark, d)
    docs = O.feature_document(feature_metrics(spark, d), ff)
    shape = "feature string, total_commits long, bug_fixes long, health double, paths array<string>"
    back = docs.select(F.from_json("body", shape).alias("d")).select("d.*")
    return back.select("feature", "total_commits", "bug_fixes", F.round("health", 3).alias("health"), F.size("paths").cast("long").alias("paths"), F.get("paths", F.lit(0)).alias("first"))


@query("sk2_report_rows", f"WITH {METRICS}, s AS (SELECT feature, count(*) AS files FROM feature_files GROUP BY 1) SELECT row_number() OVER (ORDER BY bug_fix_ratio DESC, m.feature) AS place, m.feature || ': ' || files || ' files, ' || total_commits || ' commits, ' || bug_fixes || ' fixes, health ' || CAST(round(health) AS BIGINT) || CASE WHEN health < 50 THEN ' (at risk)' WHEN health < 77 THEN ' (watch)' ELSE '' END AS line FROM metrics m JOIN s ON s.feature = m.feature", BASE)
def sk2(spark, d):
    sizes = B.feature_files(spark, d).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))
    return O.report_lines(feature_metrics(spark, d).join(sizes, "feature"))


@query("sk3_blame_upsert", "WITH n AS (SELECT path, line, sha + 1 AS sha FROM blame_lines JOIN files USING (path) WHERE part % 5 = 0 AND line % 2 = 0), t AS (SELECT DISTINCT path FROM n) SELECT path, line, sha FROM blame_lines WHERE path NOT IN (SELECT path FROM t) UNION ALL SELECT * FROM n", "blame_lines")
def sk3(spark, d):
    old = B.blame_lines(spark, d)
    new = old.join(B.files(spark, d).where("part % 5 = 0").select("path"), "path", "left_semi").where("line % 2 = 0").select("path", "line", (F.col("sha") + 1).alias("sha"))
    return O.upsert_blame(old, new)


@query("sk5_assignments", "WITH o AS (SELECT path, feature AS name, part % 3 AS seen FROM files WHERE part % 4 <> 0), n AS (SELECT path, feature || '-new' AS name, 1 AS seen FROM files WHERE part % 2 = 0), u AS (SELECT * FROM o UNION ALL SELECT * FROM n) SELECT path, min_by(name, (-seen, name)) AS name, max(seen) AS seen FROM u GROUP BY 1", "files")
def sk5(spark, d):
    f = B.files(spark, d)
    old = f.where("part % 4 <> 0").select("path", F.col("feature").alias("name"), (F.col("part") % 3).alias("seen"))
    return O.assignments(old, f.where("part % 2 = 0").select("path", F.concat("feature", F.lit("-new")).alias("name"), F.lit(1).cast("long").alias("seen")))


@query("sk6_locked_names", "SELECT feature, count(*) AS files FROM feature_files GROUP BY 1 HAVING count(*) >= 8", "feature_files")
def sk6(spark, d):
    return O.locked_names(B.feature_files(spark, d), 8)


LARGE = """st AS (SELECT 'app' AS feature, CASE part % 8 WHEN 0 THEN 'web/' || feature || '/tests/t' || part || '.py' WHEN 1 THEN 'web/Core/m' || part || '.py' ELSE 'web/' || feature || '/m' || part || '.py' END AS path FROM files UNION ALL SELECT 'flat', 'flat/' || CASE part % 9 WHEN 0 THEN 'single' || part WHEN 1 THEN 'urls' WHEN 2 THEN 'test_x' ELSE 'm' || part % 5 END || '.' || CASE part % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'ts' ELSE 'go' END || part // 20 FROM files UNION ALL SELECT 'tiny', 'tiny/' || part || '.go' FROM files WHERE part < 9),
nn AS (SELECT feature, count(*) AS n FROM st GROUP BY 1), ta AS (SELECT st.feature, path, n, CASE WHEN st.feature = 'app' AND lower(string_split(path, '/')[2]) NOT IN ('tests') THEN st.feature || '-' || lower(string_split(path, '/')[2]) ELSE st.feature END AS a, lower(regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1')) AS stem FROM st JOIN nn USING (feature) WHERE n > 40),
tb AS (SELECT *, CASE WHEN list_contains(['tests', 'test', '__tests__', 'migrations', 'templates', 'static', 'management', 'templatetags', 'locale'], lower(string_split(path, '/')[-2])) OR stem IN ('__init__', 'apps', 'urls', 'admin', 'conftest', 'setup', 'config') OR starts_with(stem, 'test_') OR starts_with(stem, 'tests_') THEN feature ELSE feature || '-' || stem END AS b0 FROM ta), tc AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY feature, b0) > 1 THEN b0 ELSE feature END AS b FROM tb),
fa AS (SELECT feature FROM (SELECT feature, n, a, count(*) AS k FROM tc GROUP BY 1, 2, 3) GROUP BY feature HAVING count(*) > 2 AND max(k) < 0.7 * max(n)), fb AS (SELECT feature FROM (SELECT feature, n, b, count(*) AS k FROM tc GROUP BY 1, 2, 3) GROUP BY feature HAVING count(*) + CASE WHEN bool_or(b = feature) THEN 0 ELSE 1 END > 3 AND max(k) < 0.7 * max(n))"""


@query("rp1_split_features", f"WITH {LARGE} SELECT feature, path, feature AS was FROM st JOIN nn USING (feature) WHERE n <= 40 UNION ALL SELECT CASE WHEN feature IN (SELECT feature FROM fa) THEN a WHEN feature IN (SELECT feature FROM fb) THEN b ELSE feature END, path, feature FROM tc", "files")
def rp1(spark, d):
    f, p = B.files(spark, d), F.col("part")
    s = p.cast("string")
    web = F.when(p % 8 == 0, F.concat(F.lit("web/"), "feature", F.lit("/tests/t"), s, F.lit(".py"))).when(p % 8 == 1, F.concat(F.lit("web/Core/m"), s, F.lit(".py"))).otherwise(F.concat(F.lit("web/"), "feature", F.lit("/m"), s, F.lit(".py")))
    stem = F.when(p % 9 == 0, F.concat(F.lit("single"), s)).when(p % 9 == 1, "urls").when(p % 9 == 2, "test_x").otherwise(F.concat(F.lit("m"), (p % 5).cast("string")))
    ext = F.concat(F.when(p % 3 == 0, "py").when(p % 3 == 1, "ts").otherwise("go"), F.expr("part div 20").cast("string"))
    every = f.select(F.lit("app").alias("feature"), web.alias("path")).unionByName(f.select(F.lit("flat").alias("feature"), F.concat(F.lit("flat/"), stem, F.lit("."), ext).alias("path"))).unionByName(f.where("part < 9").select(F.lit("tiny").alias("feature"), F.concat(F.lit("tiny/"), s, F.lit(".go")).alias("path")))
    return V.split_large(every)


RAW = """ra AS (SELECT CASE WHEN part % 13 = 0 THEN 'shared-infra' WHEN part % 17 = 0 THEN 'x/uncategorized' WHEN feature LIKE 'brand1%' THEN 'shop/' || feature WHEN part % 29 = 0 THEN feature || '/' || feature ELSE feature END AS feature, CASE WHEN feature = 'brand55' THEN 'vendor/' || path WHEN feature = 'brand44' AND part % 5 = 0 THEN 'lib/' || path ELSE substr(path, 5) END AS path FROM files)"""
MERGED = f"{RAW}, sg AS (SELECT split_part(feature, '/', 1) AS prefix, count(DISTINCT feature) AS fs, count(*) AS ps FROM ra WHERE contains(feature, '/') GROUP BY 1), sm AS (SELECT prefix FROM sg WHERE fs >= 3 AND ps < 500 AND prefix NOT IN (SELECT feature FROM ra)), me AS (SELECT DISTINCT CASE WHEN contains(feature, '/') AND split_part(feature, '/', 1) IN (SELECT prefix FROM sm) THEN split_part(feature, '/', 1) ELSE feature END AS feature, path FROM ra)"
NOISE = f"{MERGED}, nz AS (SELECT feature = 'shared-infra' OR feature = 'uncategorized' OR ends_with(feature, '/uncategorized') AS noise, feature, path, array_to_string(string_split(path, '/')[1:2], '/') AS pre FROM me), vo AS (SELECT pre, feature, count(*) AS n FROM nz WHERE NOT noise GROUP BY 1, 2), wi AS (SELECT pre, min_by(feature, (-n, feature)) AS feature, max(n) AS n FROM vo GROUP BY 1), re AS (SELECT feature, path FROM nz WHERE NOT noise UNION ALL SELECT wi.feature, path FROM nz JOIN wi USING (pre) WHERE noise AND n >= 3)"
FOREIGN = f"{NOISE}, rt AS (SELECT feature, path, split_part(path, '/', 1) AS dir FROM re), rn AS (SELECT dir, feature, count(*) AS n FROM rt GROUP BY 1, 2), ro AS (SELECT dir, sum(n) AS total, max_by(feature, (n, feature)) AS owner, max(n) AS most FROM rn GROUP BY 1), rs AS (SELECT feature, count(*) AS size FROM rt GROUP BY 1), rf AS (SELECT rt.feature, path FROM rt JOIN ro USING (dir) JOIN rn ON rn.dir = rt.dir AND rn.feature = rt.feature JOIN rs ON rs.feature = rt.feature WHERE NOT (most >= 0.6 * total AND rt.feature <> owner AND size >= 4 AND n < 0.1 * size))"
DROPPED = f"{FOREIGN}, va AS (SELECT feature, count(*) AS n, bool_and(starts_with(path, 'vendor/') OR contains(path, '/vendor/')) AS vendored FROM rf GROUP BY 1), dr AS (SELECT CASE WHEN contains(feature, '/') AND split_part(feature, '/', 1) = split_part(feature, '/', 2) THEN split_part(feature, '/', 1) ELSE feature END AS feature, path FROM rf JOIN va USING (feature) WHERE NOT vendored AND n > 2)"


def raw_features(spark, d):
    p, f = F.col("part"), F.col("feature")
    name = F.when(p % 13 == 0, "shared-infra").when(p % 17 == 0, "x/uncategorized").when(f.like("brand1%"), F.concat(F.lit("shop/"), f)).when(p % 29 == 0, F.concat_ws("/", f, f)).otherwise(f)
    path = F.when(f == "brand55", F.concat(F.lit("vendor/"), "path")).when((f == "brand44") & (p % 5 == 0), F.concat(F.lit("lib/"), "path")).otherwise(F.substr("path", F.lit(5)))
    return B.files(spark, d).select(name.alias("feature"), path.alias("path"))


@query("rp5_sub_features", f"WITH {MERGED} SELECT feature, count(*) AS files FROM me GROUP BY 1", "files")
def rp5_sub(spark, d):
    return R.merged_sub_features(raw_features(spark, d)).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))


@query("rp5_noise_files", f"WITH {NOISE} SELECT feature, path FROM re", "files")
def rp5_noise(spark, d):
    return R.reattributed_noise(R.merged_sub_features(raw_features(spark, d)))


@query("rp5_chain", f"WITH {DROPPED} SELECT feature, count(*) AS files, min(path) AS first FROM dr GROUP BY 1", "files")
def rp5_chain(spark, d):
    """Sub-features merged, noise given back, foreign files and noise, vendored and phantom features removed, doubled names made single."""
    none = spark.createDataFrame([], "feature string, total_commits long")
    return R.cleaned_map(raw_features(spark, d), none).groupBy("feature").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"))


@query("st6_scan_freshness", "WITH s AS (SELECT feature, max(sha) FILTER (sha % 3 = 0) AS scanned, max(sha) AS head FROM commit_files JOIN files USING (path) GROUP BY 1), t AS (SELECT DISTINCT sha, feature, path FROM commit_files JOIN files USING (path)) SELECT s.feature, scanned <> head AS stale, count(DISTINCT t.sha) AS behind, count(DISTINCT t.path) AS changed, max(CASE WHEN ff.path IS NULL AND t.path IS NOT NULL THEN 1 ELSE 0 END) > 0 AS has_new, greatest(0, date_sub('day', c.ts, any_value(as_of))) AS days FROM s JOIN commits c ON c.sha = scanned CROSS JOIN clock LEFT JOIN t ON t.feature = s.feature AND t.sha > scanned LEFT JOIN feature_files ff ON ff.path = t.path GROUP BY s.feature, scanned, head, c.ts", "feature_files commits commit_files clock")
def st6_scan(spark, d):
    """Each feature as a repository of its own, scanned at its last commit whose number divides by three; commits follow each other by number."""
    own = B.commit_files(spark, d).join(B.files(spark, d).select("path", "feature"), "path")
    scans = own.groupBy(F.col("feature").alias("repo")).agg(F.max(F.when(F.col("sha") % 3 == 0, F.col("sha"))).alias("scanned"), F.max("sha").alias("head"))
    c = B.commits(spark, d)
    return A.freshness(scans, own.select(F.col("feature").alias("repo"), "sha", "path"), c, B.feature_files(spark, d).select("path"), B.as_of(c)).withColumnRenamed("repo", "feature")


@query("rp22_injected_names", "WITH f AS (SELECT DISTINCT feature AS repo FROM files) SELECT repo, feature, given FROM f, (VALUES ('documents', 'document'), ('auth', 'auth'), ('pay', 'payments'), ('teams', 'team')) v(feature, given) WHERE NOT (repo LIKE '%1' AND feature = 'pay')", "files")
def rp22(spark, d):
    repos = B.files(spark, d).select(F.col("feature").alias("repo")).distinct()
    names = spark.createDataFrame(list(enumerate(["documents", "auth", "pay", "teams", "other"])), "ord int, feature string")
    given = spark.createDataFrame(list(enumerate(["team", "document", "auth", "payments"])), "ord int, name string")
    own = repos.join(F.broadcast(given), how="cross").where("not (repo like '%1' and name = 'payments')")  # four rows
    return V.injected(repos.join(F.broadcast(names), how="cross"), own)
