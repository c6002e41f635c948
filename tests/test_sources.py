"""Readers and extractors on small files with known contents."""

import json
import sqlite3

from pyspark.sql import functions as F

from loamline.operators import extract as X
from loamline.sources import coverage as K
from loamline.sources import history as H

FILES = {
    "src/app/users/[id]/route.ts": "import { db as d, type Row } from '../../../lib/db'\nimport auth from '@/auth'\nexport async function GET() {\n  return d\n}\nexport const POST = 1\n",
    "src/lib/db.ts": "export const db = {}\nexport interface Row { a: number }\n\nexport class Store {\n}\n",
    "src/auth/index.ts": "export default function auth() {}\nimport './side.js'\n",
    "src/auth/side.ts": "export enum Kind { A }\nrouter.get('/login/:name/', h)\n  list: publicProcedure.input(x).query(() => 1)\n",
    "src/ui/Page.tsx": "import * as all from '../lib/db.js'\nconst a = await fetch(`/users/${id}?x=1`, { method: 'POST' })\naxios.delete('/login/bob')\nconst b = trpc.auth.list.useQuery()\nconst c = require('./Other')\n",
    "py/api.py": "import os, sys as system\nfrom app.db import get as g, put\n\n@router.get(\"/items/{item}\")\ndef read(x):\n    pass\n\nclass Api:\n    def inner(self): pass\nLIMIT = 3\n",
    "go/main.go": 'import (\n\t"fmt"\n)\nfunc Run() {}\nfunc (s *S) Stop() {}\ntype Big struct {}\n',
    "rs/lib.rs": "use crate::a::b::Foo;\nuse crate::c::{X, Y};\npub fn go() {}\npub struct Z;\n",
    "src/lib/db.test.ts": "import { db } from './db'\n",
    "src/auth/side.test.ts": "nothing\n",
}


def sources(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string")


def test_symbols(spark):
    got = {(r.path, r.name, r.kind, r.start, r.stop) for r in X.symbol_table(sources(spark)).collect()}
    assert {("src/lib/db.ts", "db", "const", 1, 1), ("src/lib/db.ts", "Row", "type", 2, 3), ("src/lib/db.ts", "Store", "class", 4, 6), ("src/auth/side.ts", "Kind", "enum", 1, 4), ("py/api.py", "read", "function", 5, 7), ("py/api.py", "Api", "class", 8, 9), ("py/api.py", "LIMIT", "const", 10, 11), ("go/main.go", "Stop", "function", 5, 5), ("go/main.go", "Big", "type", 6, 7), ("rs/lib.rs", "go", "function", 3, 3), ("rs/lib.rs", "Z", "class", 4, 5)} <= got
    assert ("py/api.py", "inner") not in {(p, n) for p, n, *_ in got}


def test_imports_and_resolution(spark):
    found = X.imports(sources(spark))
    got = {tuple(r) for r in found.collect()}
    assert {("src/app/users/[id]/route.ts", "../../../lib/db", "db"), ("src/app/users/[id]/route.ts", "../../../lib/db", "Row"), ("src/app/users/[id]/route.ts", "@/auth", "default"), ("src/auth/index.ts", "./side.js", "@import"), ("src/ui/Page.tsx", "../lib/db.js", "*"), ("src/ui/Page.tsx", "./Other", "*"), ("py/api.py", "os", "*"), ("py/api.py", "sys", "*"), ("py/api.py", "app.db", "get"), ("py/api.py", "app.db", "put"), ("go/main.go", "fmt", "*"), ("rs/lib.rs", "crate::a::b", "Foo"), ("rs/lib.rs", "crate::c", "X"), ("rs/lib.rs", "crate::c", "Y")} <= got
    edges = {tuple(r) for r in X.resolved(found, sources(spark)).collect()}
    assert edges == {("src/app/users/[id]/route.ts", "src/lib/db.ts", "db"), ("src/app/users/[id]/route.ts", "src/lib/db.ts", "Row"), ("src/app/users/[id]/route.ts", "src/auth/index.ts", "default"), ("src/auth/index.ts", "src/auth/side.ts", "@import"), ("src/ui/Page.tsx", "src/lib/db.ts", "*"), ("src/lib/db.test.ts", "src/lib/db.ts", "db")}


def test_routes_calls_and_http_edges(spark):
    routes, calls = X.routes(sources(spark)), X.client_calls(sources(spark))
    assert {tuple(r)[1:] for r in routes.collect()} == {("GET", "/users/:*", "app-router"), ("POST", "/users/:*", "app-router"), ("GET", "/login/:*", "express"), ("*", "trpc:list", "trpc"), ("GET", "/items/:*", "fastapi")}
    assert {(r.line, r.method, r.pattern, r.kind) for r in calls.collect()} == {(2, "POST", "/users/:*", "fetch"), (3, "DELETE", "/login/bob", "axios"), (4, "*", "trpc:list", "trpc")}
    assert {(r.src, r.dst) for r in X.http_edges(calls, routes).collect()} == {("src/ui/Page.tsx", "src/app/users/[id]/route.ts"), ("src/ui/Page.tsx", "src/auth/side.ts")}


def test_tests_are_mapped(spark):
    edges = X.resolved(X.imports(sources(spark)), sources(spark))
    got = {tuple(r) for r in X.test_map(edges, sources(spark)).collect()}
    assert got == {("src/lib/db.test.ts", "src/lib/db.ts", "import"), ("src/auth/side.test.ts", "src/auth/side.ts", "name")}


def test_coverage_readers(spark, tmp_path):
    rows = lambda df: sorted((r.path, r.line, r.hits) for r in df.collect())
    (tmp_path / "lcov.info").write_text("TN:\nSF:src/a.ts\nDA:1,3\nDA:2,0\nDA:x,1\nend_of_record\nSF:src/b.ts\nDA:7,1\nDA:7,4\nend_of_record\n")
    assert rows(K.lcov(spark, str(tmp_path / "lcov.info"))) == [("src/a.ts", 1, 3), ("src/a.ts", 2, 0), ("src/b.ts", 7, 4)]
    (tmp_path / "c.json").write_text(json.dumps({"meta": {}, "files": {"a.py": {"executed_lines": [1, 3], "missing_lines": [2]}}}))
    assert rows(K.coverage_json(spark, str(tmp_path / "c.json"))) == [("a.py", 1, 1), ("a.py", 2, 0), ("a.py", 3, 1)]
    (tmp_path / "j.json").write_text(json.dumps({"/r/a.ts": {"path": "/r/a.ts", "statementMap": {"0": {"start": {"line": 4}}, "1": {"start": {"line": 4}}}, "s": {"0": 0, "1": 2}}}))
    assert rows(K.jest_final(spark, str(tmp_path / "j.json"))) == [("/r/a.ts", 4, 2)]
    (tmp_path / "c.xml").write_text('<coverage><packages><package><classes><class filename="m.py"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>')
    assert rows(K.cobertura(spark, str(tmp_path / "c.xml"))) == [("m.py", 1, 2), ("m.py", 2, 0)]
    with sqlite3.connect(tmp_path / ".coverage") as con:
        con.execute("CREATE TABLE file (id INTEGER, path TEXT)")
        con.execute("CREATE TABLE line_bits (file_id INTEGER, numbits BLOB)")
        con.execute("INSERT INTO file VALUES (1, 'z.py')")
        con.execute("INSERT INTO line_bits VALUES (1, ?)", (bytes([0b101, 0b10000000]),))
    con.close()
    assert rows(K.coverage_sqlite(spark, str(tmp_path / ".coverage"))) == [("z.py", 1, 1), ("z.py", 3, 1), ("z.py", 16, 1)]
    pct = K.file_coverage(K.coverage_json(spark, str(tmp_path / "c.json"))).collect()
    assert [(r.path, r.pct) for r in pct] == [("a.py", 66.7)]
    files = spark.createDataFrame([("pkg/a.py",), ("a/b.py",), ("b.py",)], "path string")
    given = spark.createDataFrame([("a.py", 1), ("/abs/a/b.py", 2), ("none.py", 3)], "path string, x int")
    assert {(r.path, r.x) for r in K.matched(given, files).collect()} == {("pkg/a.py", 1), ("b.py", 2)}


def test_history_text(spark):
    text = "\x1e" + "a" * 40 + "\x1fAnn\x1f2024-01-02T03:04:05+00:00\x1ffix: crash (#9)\n\nmore\n\x1f\n\nsrc/a.ts\nsrc/b.ts\n" + "\x1e" + "b" * 40 + "\x1fBob\x1f2024-01-01T00:00:00+00:00\x1fchore\n\x1f\n"
    got = H.parsed_log(spark.createDataFrame([(text,)], "value string")).orderBy(F.desc("ts")).collect()
    assert [(r.author, r.files, r.is_bug_fix, r.pr_number) for r in got] == [("Ann", ["src/a.ts", "src/b.ts"], True, 9), ("Bob", [], False, None)]
    blame = "\n".join([f"{'c' * 40} 1 1 2", "author x", "\tcode", f"{'c' * 40} 2 2", "\tmore", f"{'d' * 40} 9 3 1", "\tlast"])
    assert [(r.line, r.sha[0]) for r in H.parsed_blame(spark.createDataFrame([("p", blame)], "path string, value string")).orderBy("line").collect()] == [(1, "c"), (2, "c"), (3, "d")]
    status = spark.createDataFrame([(x,) for x in ("A\tn.ts", "M\tm.ts", "D\td.ts", "R100\told.ts\tnew.ts", "")], "value string")
    assert {tuple(r) for r in H.parsed_name_status(status).collect()} == {("n.ts", "added"), ("m.ts", "modified"), ("d.ts", "deleted"), ("old.ts", "deleted"), ("new.ts", "modified")}
    owners = spark.createDataFrame([(x,) for x in ("# c", "/a/ @x/core @y", "*.ts @y # z", "")], "value string")
    assert {r.team: r.patterns for r in H.code_owners(owners).collect()} == {"@x/core": ["/a/"], "@y": ["*.ts", "/a/"]}
    files = spark.createDataFrame([("packages/a/x.ts",), ("packages/a/sub/y.ts",), ("z.ts",)], "path string")
    packages = spark.createDataFrame([("a", "packages/a"), ("sub", "packages/a/sub")], "name string, root string")
    assert {r.path: r.package for r in H.packaged(files, packages).collect()} == {"packages/a/x.ts": "a", "packages/a/sub/y.ts": "sub", "z.ts": None}


def test_report_in_several_texts(spark):
    from loamline.sources import coverage as K

    rows = [("a", "lcov.info", "TN:\nSF:x.ts\nDA:1,0\nDA:2,3\nend_of_record\nSF: y.ts \r\nDA:4,1\r\nDA:bad\n"), ("a", "lcov.info", "DA:9,9\nSF:z.ts\nDA:1,1\nSF:x.ts\nDA:1,5"), ("a", "coverage.lcov", "SF:late.ts\nDA:1,1")]
    rows += [("b", "coverage.json", '{"files": {"p.py": {"executed_lines": [1], "missing_lines": [2]}}}'), ("b", "coverage.json", '{"files": {"q.py": {"executed_lines": [], "missing_lines": [7]}}}'), ("b", "lcov.info", "SF:no.ts\nDA:1,1")]
    got = K.detected(spark.createDataFrame(rows, "repo string, name string, value string"))
    want = [("a", "x.ts", 1, 5), ("a", "x.ts", 2, 3), ("a", "y.ts", 4, 1), ("a", "z.ts", 1, 1), ("b", "p.py", 1, 1), ("b", "p.py", 2, 0), ("b", "q.py", 7, 0)]
    assert sorted(tuple(r) for r in got.select("repo", "path", "line", "hits").collect()) == want
