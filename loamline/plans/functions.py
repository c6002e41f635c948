"""Every scalar function over texts, paths and names at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commits as C
from ..functions import names as N
from ..functions import paths as P
from ..functions import scores as S
from ..operators import attribution as A
from ..sources import bridge as B
from .registry import query


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


#: Variants of every file's path that reach all branches of the path rules.
_SHAPES = ("{p}", "docs/{p}", "node_modules/{p}", ".github/{p}", "app/x/{n}/page.tsx", "pages/api/{n}.ts", "internal/db/{n}.go", "src/store/{n}Store.ts", "components/{n}Dialog.tsx", "package.json", "src/(group)/Auth/{n}.test.tsx", "lib/api/{n}_pb2.py", "hooks/use{n}.ts")
SHAPED_SQL = "shaped AS (SELECT DISTINCT " + "CASE part % 13 " + " ".join(f"WHEN {i} THEN " + " || ".join(q(x) if x not in ("{p}", "{n}") else {"{p}": "path", "{n}": "CAST(part AS VARCHAR)"}[x] for x in __import__("re").split(r"(\{[pn]\})", s) if x) for i, s in enumerate(_SHAPES)) + " END AS path FROM files)"


def shaped(spark, d):
    path = F.lit(None).cast("string")
    for i, s in enumerate(_SHAPES):
        path = F.when(F.col("part") % 13 == i, F.format_string(s.replace("{p}", "%1$s").replace("{n}", "%2$s"), F.col("path"), F.col("part").cast("string"))).otherwise(path)
    return B.files(spark, d).select(path.alias("path")).distinct()


DIRS = "list_slice(string_split(lower(path), '/'), 1, -2)"
NAME = "lower(split_part(path, '/', -1))"
ENDS = lambda suffixes: "(" + " OR ".join(f"ends_with({NAME}, {q(s)})" for s in suffixes) + ")"
IS_TEST = f"(list_has_any({DIRS}, {listed(P.TEST_DIRS)}) OR {ENDS(P.TEST_SUFFIXES)})"
BUCKET = f"""CASE WHEN list_has_any({DIRS}, {listed(P.GENERATED_DIRS)}) OR {NAME} IN ({", ".join(map(q, P.GENERATED_FILES))}) OR {ENDS(P.GENERATED_SUFFIXES)} THEN 'generated' WHEN {IS_TEST} THEN 'tests' WHEN list_has_any({DIRS}, {listed(P.DOC_DIRS)}) THEN 'documentation'
WHEN list_has_any({DIRS}, {listed(P.INFRA_DIRS)}) OR (NOT contains(path, '/') AND {NAME} IN ({", ".join(map(q, P.ROOT_FILES))})) THEN 'infrastructure' ELSE 'source' END"""
LAYER = "CASE " + " ".join(f"WHEN regexp_matches(path, {q(p)}) THEN {q(n)}" for n, p in P.LAYERS) + " END"


@query("fn1_bug_fix", "SELECT left(message, 12) AS start, is_bug_fix, count(*) AS n FROM commits GROUP BY 1, 2", "commits")
def fn1(spark, d):
    return B.commits(spark, d).groupBy(F.left("message", F.lit(12)).alias("start"), "is_bug_fix").agg(F.count(F.lit(1)).alias("n"))


@query("fn2_digest_bug_fix", r"""SELECT CAST(ts AS DATE) AS day, count(*) AS commits, count(*) FILTER (regexp_matches(split_part(message, chr(10), 1), '(?i)\b(fix|bug|hotfix|patch|revert|regression|crash|error|broken|issue|defect)\b') AND NOT regexp_matches(split_part(message, chr(10), 1), '(?i)\bfix\s+(typo|lint|docs?)\b')) AS fixes FROM commits GROUP BY 1""", "commits")
def fn2(spark, d):
    return B.commits(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("commits"), F.count_if(C.is_digest_bug_fix(F.col("message"))).alias("fixes"))


@query("fn3_pr_numbers", "SELECT sha, pr_number FROM commits WHERE pr_number IS NOT NULL", "commits")
def fn3(spark, d):
    return B.commits(spark, d).where("pr_number is not null").select("sha", "pr_number")


@query("fn4_remote_url", r"SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'https://host.example/org/r' || s_suppkey WHEN 1 THEN 'https://host.example/org/r' || s_suppkey ELSE 'https://h/r' || s_suppkey END AS url FROM supplier")
def fn4(spark, d):
    k = F.col("s_suppkey").cast("string")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("git@host.example:org/r"), k, F.lit(".git"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("https://host.example/org/r"), k, F.lit(".git/"))).otherwise(F.concat(F.lit("https://h/r"), k))
    return B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), P.remote_url(raw).alias("url"))


SEGMENT = f"coalesce(list_filter({DIRS}, lambda s: NOT list_contains({listed(P.SKIPPED_SEGMENTS)}, s) AND NOT regexp_matches(s, '^\\(.*\\)$'))[1], 'root')"


@query("fn5_first_segment", f"WITH {SHAPED_SQL} SELECT {SEGMENT} AS segment, count(*) AS n FROM shaped GROUP BY 1", "files")
def fn5(spark, d):
    return shaped(spark, d).groupBy(P.first_segment(F.col("path")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("fn6_domain_key", f"WITH {SHAPED_SQL}, k AS (SELECT path, list_filter({DIRS}, lambda s: NOT list_contains({listed(P.SKIPPED_SEGMENTS)}, s)) AS own, {DIRS} AS dirs FROM shaped) SELECT path, CASE WHEN len(own) > 0 THEN array_to_string(list_slice(own, 1, 3), '/') ELSE coalesce(array_to_string(list_slice(dirs, -2, -1), '/'), '') END AS domain FROM k", "files")
def fn6(spark, d):
    return shaped(spark, d).select("path", P.domain_key(F.col("path")).alias("domain"))


@query("fn7_test_paths", f"WITH {SHAPED_SQL} SELECT path, regexp_matches('/' || path, {q(P.TEST_PATH)}) AS by_regex, {IS_TEST} AS by_segments FROM shaped", "files")
def fn7(spark, d):
    return shaped(spark, d).select("path", P.is_test_path_regex(F.col("path")).alias("by_regex"), P.is_test_path_segments(F.col("path")).alias("by_segments"))


@query("fn8_documentation_and_names", f"WITH {SHAPED_SQL} SELECT path, list_has_any({DIRS}, {listed(P.DOC_DIRS)}) AS is_doc, CASE WHEN lower(split_part(path, '/', 1)) IN ({', '.join(map(q, P.SHARED_NAMES))}) THEN 'shared-infra' ELSE split_part(path, '/', 1) END AS canonical FROM shaped", "files")
def fn8(spark, d):
    return shaped(spark, d).select("path", P.is_documentation(F.col("path")).alias("is_doc"), P.canonical_bucket(F.substring_index("path", "/", 1)).alias("canonical"))


@query("fn9_bucket_summary", f"WITH {SHAPED_SQL}, b AS (SELECT {BUCKET} AS bucket FROM shaped) SELECT k.bucket, count(b.bucket) AS n FROM (SELECT unnest(['source', 'documentation', 'tests', 'infrastructure', 'generated']) AS bucket) k LEFT JOIN b USING (bucket) GROUP BY 1", "files")
def fn9(spark, d):
    keys = spark.createDataFrame([(b,) for b in ("source", "documentation", "tests", "infrastructure", "generated")], "bucket string")
    n = shaped(spark, d).groupBy(P.bucket(F.col("path")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(n, "bucket", "left").na.fill(0, ["n"])


@query("fn10_layers", f"WITH {SHAPED_SQL} SELECT path, {LAYER} AS layer FROM shaped", "files")
def fn10(spark, d):
    return shaped(spark, d).select("path", P.layer(F.col("path")).alias("layer"))


@query("fn13_humanize", """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' & OAuth API' WHEN 1 THEN 'Json of ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] WHEN 2 THEN p_name ELSE 'The JWT' END AS label FROM (SELECT p_partkey, p_name FROM part)""".replace("'Json of '", "'JSON of '"))
def fn13(spark, d):
    a, b = F.split("p_name", " ")[0], F.element_at(F.split("p_name", " "), 2)
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(a, F.lit("-and-oauth_api"))).when(k == 1, F.concat(F.lit("x/json-of-"), b)).when(k == 2, F.col("p_name")).otherwise(F.lit("ee/the-jwt"))
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("k"), N.humanize(name).alias("label"))


@query("fn16_routes", r"""SELECT page_id, CASE WHEN r IN ('', '/') THEN '/' ELSE regexp_replace(r, '/+$', '') END AS path FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') AS r FROM pages)""")
def fn16(spark, d):
    return B.table(spark, d, "pages").select("page_id", P.url_path(F.col("url")).alias("path"))


@query("fn16_file_routes", rf"WITH {SHAPED_SQL}, a AS (SELECT path, regexp_replace(regexp_replace(path, '^(src/app/|src/pages/|app/|pages/|src/routes/)', ''), '(/page\.(tsx|ts|jsx|js)|/index\.(tsx|ts|jsx|js)|\.tsx|\.ts|\.jsx|\.js|\.svelte)$', '') AS r FROM shaped) SELECT path, CASE WHEN r LIKE '/%' THEN r ELSE '/' || r END AS route FROM a", "files")
def fn16_files(spark, d):
    return shaped(spark, d).select("path", P.file_route(F.col("path")).alias("route"))


@query("fn17_api_patterns", r"SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/users/:*/posts/:*' WHEN 1 THEN '/team/:*' ELSE '/a/:*' END AS pattern FROM pages")
def fn17(spark, d):
    k = F.col("page_id") % 3
    raw = F.when(k == 0, "Users/[id]/posts/{post_id}/").when(k == 1, " /team/:Name ").otherwise("/A/[...slug]")
    return B.table(spark, d, "pages").select("page_id", P.api_pattern(raw).alias("pattern"))


#: Names of flows and their domains.
DOMAIN_CASES = (
    ("Reset_Password/flow", "auth"), ("saml sso setup", "auth"), ("mfa/enrol", "auth"), ("register user", "auth"), ("magic link", "auth"), ("activate_account", "auth"), ("OIDC callback", "auth"),
    ("pay invoice", "billing"), ("Show Pricing page", "billing"), ("Downgrade Plan", "billing"), ("refund order", "billing"), ("stripe_setup", "billing"),
    ("send-push notification", "notifications"), ("edit alert_rule", "notifications"), ("send-email", ""), ("webhook alert", ""), ("browse catalog", ""), ("plan trip", ""),
)


@query("fn21_flow_domains", f"SELECT conv_id, turn, nullif({[x for _, x in DOMAIN_CASES]}[CAST(conv_id % {len(DOMAIN_CASES)} AS INTEGER) + 1], '') AS domain FROM conversations")
def fn21(spark, d):
    name = F.get(F.array(*[F.lit(x) for x, _ in DOMAIN_CASES]), (F.col("conv_id") % len(DOMAIN_CASES)).cast("int"))
    return B.table(spark, d, "conversations").select("conv_id", "turn", N.flow_domain(name).alias("domain"))


@query("fn24_same_names", "WITH n AS (SELECT n_nationkey AS a, lower(n_name) AS name FROM nation) SELECT x.a, y.a AS b FROM n x, n y WHERE x.a % 5 = y.a % 5")
def fn24(spark, d):
    """Names of one region in different spellings are the same name."""
    n = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.concat(F.lit("group-"), (F.col("n_nationkey") % 5).cast("string"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(" team")).otherwise(F.lit("/team"))).alias("name"))
    other = n.select(F.col("a").alias("b"), F.col("name").alias("other"))
    return n.join(F.broadcast(other), N.same_name(F.col("name"), F.col("other"))).select("a", "b")  # 25 nations


@query("fn25_ladders", """SELECT o_orderkey AS k, CASE WHEN v < 50 THEN 'at risk' WHEN v < 75 THEN 'watch' ELSE 'good' END AS health, CASE WHEN v < 40 THEN 'low' WHEN v < 70 THEN 'medium' ELSE 'high' END AS coverage, CASE WHEN v < 25 THEN 'critical' WHEN v < 45 THEN 'high' WHEN v < 65 THEN 'medium' WHEN v < 80 THEN 'low' ELSE 'healthy' END AS impact FROM (SELECT o_orderkey, o_orderkey % 101 AS v FROM orders)""")
def fn25(spark, d):
    v = F.col("o_orderkey") % 101
    return B.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), S.health_level(v).alias("health"), S.coverage_level(v).alias("coverage"), S.impact_level(v).alias("impact"))


@query("fn26_call_cost", """WITH r AS (SELECT * FROM (VALUES ('BUILDING', 3.0::DOUBLE, 15.0::DOUBLE), ('MACHINERY', 1.0, 5.0)) t(model, i, o)) SELECT c_custkey AS k, round((c_custkey * 1000 / 1e6 * coalesce(i, 3.0) + c_custkey * 500 / 1e6 * coalesce(o, 15.0)) * CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 1 END, 6) AS usd FROM customer LEFT JOIN r ON model = c_mktsegment""")
def fn26(spark, d):
    rates = spark.createDataFrame([("BUILDING", 3.0, 15.0), ("MACHINERY", 1.0, 5.0)], "model string, i double, o double")
    c = B.table(spark, d, "customer").join(F.broadcast(rates), F.col("c_mktsegment") == F.col("model"), "left")
    k = F.col("c_custkey")
    return c.select(k.alias("k"), F.round(S.call_cost(k * 1000, k * 500, F.col("i"), F.col("o"), k % 2 == 0), 6).alias("usd"))


@query("fn27_durations", """WITH s AS (SELECT c_custkey AS k, c_custkey * 20 * 0.008 + 5 AS s FROM customer) SELECT k, CASE WHEN s < 10 THEN '< 10 sec' WHEN s < 60 THEN '~ ' || CAST(floor(s) AS BIGINT) || ' sec' ELSE 'minutes' END AS estimate FROM s""")
def fn27(spark, d):
    text = S.duration_text(S.duration_seconds(F.col("c_custkey") * 20, model=True))
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(text.endswith("min"), "minutes").otherwise(text).alias("estimate"))


@query("fn28_tokens_saved", "SELECT s_suppkey AS k, greatest(0, 37500 - (500 + 2500 * (s_suppkey % 20)))::BIGINT AS saved FROM supplier")
def fn28(spark, d):
    return B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), S.tokens_saved(F.col("s_suppkey") % 20).cast("long").alias("saved"))


@query("fn29_deep_links", "SELECT 'https://h/r/blob/HEAD/' || path || '#L' || start || '-L' || stop AS link FROM ranges", "ranges")
def fn29(spark, d):
    from ..operators import lines as L

    return L.symbol_ranges(B.symbols(spark, d)).select(N.deep_link(F.lit("https://h/r"), F.col("path"), F.col("start"), F.col("stop")).alias("link"))


@query("fn30_hashes", "SELECT doc_id, sha256(text) AS content, sha256(array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10))) AS body FROM documents")
def fn30(spark, d):
    body = F.array_join(F.slice(F.split("text", "\n"), 2, 2), "\n")
    return B.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content"), F.sha2(body.cast("binary"), 256).alias("body"))


@query("fn31_caps", "SELECT s_suppkey AS k, greatest(3, least(15, s_suppkey // 8))::BIGINT AS packages, least(200, greatest(15, s_suppkey // 4))::BIGINT AS split FROM supplier")
def fn31(spark, d):
    k = F.col("s_suppkey")
    return B.table(spark, d, "supplier").select(k.alias("k"), F.greatest(F.lit(3), F.least(F.lit(15), F.expr("s_suppkey div 8"))).cast("long").alias("packages"), F.least(F.lit(200), F.greatest(F.lit(15), F.expr("s_suppkey div 4"))).cast("long").alias("split"))


SCOPE_CASES = (("security: close hole", ""), ("deps-dev: raise", ""), ("update: texts", ""), ("doc: words", ""), ("api: add route", "api"), ("web/cart: total", "web/cart"), ("minor: edit", ""), ("rename(core): x", "core"), ("changelog: 2.0", ""))


@query("tx11_commit_scopes", f"WITH m AS (SELECT CASE WHEN message LIKE 'feat%' THEN 'scope' || sha % 7 ELSE nullif({[x for _, x in SCOPE_CASES]}[CAST(sha % {len(SCOPE_CASES)} AS INTEGER) + 1], '') END AS scope FROM commits WHERE message LIKE 'feat%' OR message LIKE 'chore%') SELECT scope, count(*) AS n FROM m WHERE scope IS NOT NULL GROUP BY 1 HAVING count(*) >= 5", "commits")
def tx11(spark, d):
    """Chores stand for messages whose type words are no scopes, and some that are."""
    other = F.get(F.array(*[F.lit(x) for x, _ in SCOPE_CASES]), (F.col("sha") % len(SCOPE_CASES)).cast("int"))
    message = F.when(F.col("message").startswith("chore"), other).otherwise(F.col("message"))
    return B.commits(spark, d).groupBy(C.scope(message).alias("scope")).agg(F.count(F.lit(1)).alias("n")).where("scope is not null and n >= 5")


@query("tx12_commit_keywords", r"""WITH w AS (SELECT author, unnest(string_split_regex(lower(message), '[^a-z]+')) AS word FROM commits), c AS (SELECT author, word, count(*) AS n FROM w WHERE length(word) > 3 AND word NOT IN ('from', 'pull', 'request', 'merge') GROUP BY 1, 2) SELECT author, word, n, row_number() OVER (PARTITION BY author ORDER BY n DESC, word) AS place FROM c QUALIFY place <= 5""", "commits")
def tx12(spark, d):
    from pyspark.sql import Window as W

    w = B.commits(spark, d).select("author", F.explode(F.split(F.lower("message"), "[^a-z]+")).alias("word")).where("length(word) > 3 and word not in ('from', 'pull', 'request', 'merge')")
    place = F.row_number().over(W.partitionBy("author").orderBy(F.desc("n"), "word"))
    return w.groupBy("author", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place).where("place <= 5")


@query("sc1_commit_window", "WITH w AS (SELECT sha, ts, author, ts >= as_of - INTERVAL 365 DAY AS young, row_number() OVER (ORDER BY date_trunc('month', ts) DESC, sha DESC) AS ord FROM commits, clock) SELECT sha, ts, author FROM w WHERE ord < coalesce((SELECT min(ord) FROM w WHERE NOT young), 1 << 60) AND ord <= 5000", "commits clock")
def sc1(spark, d):
    """The walk goes from month to month, within a month by sha, and stops at the first commit that is too old, whatever comes behind it."""
    c = B.commits(spark, d)
    return A.walked(c, B.as_of(c), [F.date_trunc("month", "ts"), F.col("sha")], days=365, most=5000).select("sha", "ts", "author")


@query("sc4_file_blame", "SELECT path, array_to_string(list_sort(list(DISTINCT author)), '|') AS authors, max(ts) AS last_modified, count(*) AS hunks FROM blame_lines JOIN commits USING (sha) GROUP BY 1", "blame_lines commits")
def sc4(spark, d):
    b = B.blame_lines(spark, d).join(B.commits(spark, d).select("sha", "author", "ts"), "sha")
    return b.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("author")), "|").alias("authors"), F.max("ts").alias("last_modified"), F.count(F.lit(1)).alias("hunks"))


@query("sc19_daily_commits", "SELECT author, count(*) AS commits, count(*) FILTER (is_bug_fix) AS fixes FROM commits WHERE CAST(ts AS DATE) = DATE '1997-01-15' GROUP BY 1", "commits")
def sc19(spark, d):
    return B.commits(spark, d).where(F.to_date("ts") == F.lit("1997-01-15").cast("date")).groupBy("author").agg(F.count(F.lit(1)).alias("commits"), F.count_if("is_bug_fix").alias("fixes"))


@query("sc20_grep", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, n, line FROM l WHERE regexp_matches(line, '(?i)licensed? under') ORDER BY doc_id, n LIMIT 30")
def sc20(spark, d):
    lines = B.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike("(?i)licensed? under")).orderBy("doc_id", "n").limit(30).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "line")
