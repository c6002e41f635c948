"""Extraction over generated sources, claims, splits and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import attribution as A
from ..operators import extract as X
from ..operators import graph as G
from ..operators import incremental as N
from ..operators import lines as L
from ..operators import rules as R
from ..sources import bridge as B
from ..sources import coverage as K
from ..sources import history as H
from .functions import BUCKET, LAYER, SHAPED_SQL, shaped
from .registry import query
from .structure import FILE_PAIRS, file_pairs


@query("sc2_tracked_files", f"WITH {SHAPED_SQL} SELECT path FROM shaped WHERE {BUCKET} <> 'generated' AND regexp_matches(path, '\\.(ts|tsx|py|go)$')", "files")
def sc2(spark, d):
    return shaped(spark, d).where((P.bucket(F.col("path")) != "generated") & F.col("path").rlike(r"\.(?:ts|tsx|py|go)$"))


@query("sc6_name_status", "SELECT path, CASE WHEN part % 3 = 0 THEN 'added' ELSE 'modified' END AS status FROM files WHERE part % 3 < 2 UNION ALL SELECT 'old/' || path, 'deleted' FROM files WHERE part % 3 = 2 UNION ALL SELECT path, 'modified' FROM files WHERE part % 3 = 2", "files")
def sc6(spark, d):
    k = F.col("part") % 3
    text = F.when(k == 0, F.concat(F.lit("A\t"), "path")).when(k == 1, F.concat(F.lit("M\t"), "path")).otherwise(F.concat(F.lit("R090\told/"), "path", F.lit("\t"), "path"))
    return H.parsed_name_status(B.files(spark, d).select(text.alias("value")))


@query("sc12_packages", "SELECT path, CASE WHEN path LIKE 'src/brand1/promo/%' THEN 'promo' WHEN path LIKE 'src/brand1/%' THEN 'one' END AS package FROM files", "files")
def sc12(spark, d):
    packages = spark.createDataFrame([("one", "src/brand1"), ("promo", "src/brand1/promo")], "name string, root string")
    return H.packaged(B.files(spark, d), packages)


@query("tx1_declarations", "SELECT path, 'f' || part AS name, 'function' AS kind, 1::BIGINT AS start, 2::BIGINT AS stop FROM files WHERE path LIKE '%.ts' OR path LIKE '%.tsx' UNION ALL SELECT path, 'LIMIT', 'const', 3, 4 FROM files WHERE path LIKE '%.ts' OR path LIKE '%.tsx'", "files")
def tx1(spark, d):
    content = F.concat(F.lit("export async function f"), F.col("part").cast("string"), F.lit("() {}\n\nexport const LIMIT = 1\n"))
    got = X.symbol_table(B.files(spark, d).where(F.col("path").rlike(r"\.tsx?$")).select("path", content.alias("content")))
    return got.select("path", "name", "kind", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def import_sources(spark, d):
    line = F.concat(F.lit("import { x } from '@/"), F.substr("path", F.lit(5)), F.lit("'"))
    f = B.files(spark, d).select("part", "path").hint("merge")
    texts = B.edge_parts(spark, d).join(f.select(F.col("part").alias("to"), line.alias("line")), "to").groupBy(F.col("l_partkey").alias("part")).agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("content"))
    return texts.join(f, "part").select("path", "content")


@query("jn9_resolved_imports", "SELECT src, dst, 'x' AS symbol FROM edges WHERE src LIKE '%.ts' OR src LIKE '%.tsx'", "edges")
def jn9(spark, d):
    return X.resolved(X.imported(G.kept(import_sources(spark, d))), B.files(spark, d))  # one text for each language's reader


@query("jn7_coverage_paths", "SELECT path, part FROM files WHERE part % 3 <> 2", "files")
def jn7(spark, d):
    f = B.files(spark, d)
    given = F.when(F.col("part") % 3 == 0, F.concat(F.lit("/abs/"), "path")).when(F.col("part") % 3 == 1, F.col("path")).otherwise(F.concat(F.lit("none/"), F.col("part").cast("string")))
    return K.matched(f.select(given.alias("path"), "part"), f)


@query("jn15_consumers", "SELECT dst AS path, array_to_string(list_sort(list(DISTINCT feature)), '|') AS consumers FROM edges JOIN files ON path = src GROUP BY 1", "edges")
def jn15(spark, d):
    e = B.edges(spark, d).join(B.files(spark, d).select(F.col("path").alias("src"), "feature"), "src")
    return e.groupBy(F.col("dst").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("feature")), "|").alias("consumers"))


@query("ag29_test_map", "WITH t AS (SELECT path AS test FROM files WHERE path LIKE '%/tests/%'), m AS (SELECT DISTINCT test, dst AS target, 'import' AS how FROM t JOIN edges ON src = test WHERE dst NOT LIKE '%/tests/%') SELECT * FROM m UNION ALL SELECT test, NULL, 'unmapped' FROM t WHERE test NOT IN (SELECT test FROM m)", "edges")
def ag29(spark, d):
    return X.test_map(B.edges(spark, d), B.files(spark, d).select("path"))


@query("gr6_flow_layers", f"WITH s AS (SELECT flow, min(path) AS path FROM files GROUP BY 1), r(seed, node, depth) AS (SELECT flow, path, 0 FROM s UNION SELECT seed, dst, depth + 1 FROM r JOIN edges ON src = node WHERE depth < 3), m AS (SELECT seed, node AS path, min(depth) AS depth FROM r GROUP BY 1, 2) SELECT seed AS flow, coalesce({LAYER}, 'support') AS layer, count(*) AS files, max(depth)::INTEGER AS depth FROM m GROUP BY 1, 2", "edges", recursive=True)
def gr6(spark, d):
    seeds = B.files(spark, d).groupBy(F.col("flow").alias("seed")).agg(F.min("path").alias("node"))
    got = G.reach(B.edges(spark, d), seeds)
    return got.groupBy(F.col("seed").alias("flow"), F.coalesce(P.layer(F.col("node")), F.lit("support")).alias("layer")).agg(F.count(F.lit(1)).alias("files"), F.max("depth").alias("depth"))


@query("gr3_cluster_names", f"WITH {FILE_PAIRS}, e AS (SELECT f1 AS u, f2 AS v FROM pairs WHERE n >= 3 UNION SELECT f2, f1 FROM pairs WHERE n >= 3), r(node, root) AS (SELECT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1), s AS (SELECT root, split_part(node, '/', 2) AS segment, count(*) AS n FROM c GROUP BY 1, 2), m AS (SELECT root, min_by(segment, (-n, segment)) AS segment FROM s GROUP BY 1), i AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY root) AS i FROM m) SELECT root, segment || CASE WHEN i > 1 THEN '-' || i ELSE '' END AS name FROM i", "files commit_files", recursive=True)
def gr3(spark, d):
    c = G.components(file_pairs(spark, d).where("n >= 3"))
    return R.named_clusters(c.select("root", F.split("node", "/")[1].alias("segment")))


@query("gr10_redistribution", "WITH u AS (SELECT dst AS path, feature AS consumer, count(*) AS n FROM edges JOIN files ON path = src WHERE feature <> 'brand1' GROUP BY 1, 2), t AS (SELECT path, min_by(consumer, (-n, consumer)) AS target FROM u GROUP BY 1) SELECT CASE WHEN feature = 'brand1' THEN coalesce(target, feature) ELSE feature END AS feature, count(*) AS files FROM files LEFT JOIN t USING (path) GROUP BY 1", "edges")
def gr10(spark, d):
    return R.redistributed(B.files(spark, d).select("feature", "path"), B.edges(spark, d), ["brand1"]).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))


CLAIMS = "cl AS (SELECT flow, CAST(part % 3 AS INTEGER) AS place, path FROM files WHERE part % 4 <> 0 UNION ALL SELECT 'a-' || flow, CAST(part % 2 AS INTEGER), path FROM files WHERE part % 6 = 1), w AS (SELECT path, min_by(flow, (place, flow)) AS flow FROM cl GROUP BY 1), fd AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files), l AS (SELECT dir, min_by(flow, (-n, flow)) AS near FROM (SELECT dir, flow, count(*) AS n FROM w JOIN fd USING (path) GROUP BY 1, 2) GROUP BY 1)"


@query("rp13_flow_claims", f"WITH {CLAIMS} SELECT path, coalesce(flow, near) AS flow, CASE WHEN flow IS NOT NULL THEN 'claimed' WHEN near IS NOT NULL THEN 'directory' END AS how FROM fd LEFT JOIN w USING (path) LEFT JOIN l USING (dir)", "files")
def rp13(spark, d):
    f = B.files(spark, d)
    claims = f.where("part % 4 <> 0").select("flow", (F.col("part") % 3).cast("int").alias("place"), "path").unionByName(f.where("part % 6 = 1").select(F.concat(F.lit("a-"), "flow").alias("flow"), (F.col("part") % 2).cast("int").alias("place"), "path"))
    return R.first_claims(claims, f.select("path", P.parent(F.col("path")).alias("dir")))


@query("rp14_catch_all_split", "WITH k AS (SELECT feature, path, regexp_extract(path, '\\.([a-z]+)$', 1) AS kind FROM files), n AS (SELECT feature, kind FROM k WHERE feature IN ('brand1', 'brand2') GROUP BY 1, 2 HAVING count(*) >= 2) SELECT CASE WHEN n.kind IS NOT NULL THEN k.feature || '/' || k.kind ELSE k.feature END AS feature, count(*) AS files FROM k LEFT JOIN n ON n.feature = k.feature AND n.kind = k.kind GROUP BY 1", "files")
def rp14(spark, d):
    k = B.files(spark, d).select("feature", "path", F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind"))
    return R.split_by(k, ["brand1", "brand2"]).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))


@query("rp17_orphans", "WITH near AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, min(feature) AS near FROM feature_files GROUP BY 1), o AS (SELECT path FROM files WHERE path NOT IN (SELECT path FROM feature_files)), up AS (SELECT path, max_by(near, depth) AS feature FROM (SELECT path, depth, array_to_string(list_slice(string_split(path, '/'), 1, depth), '/') AS dir FROM o, unnest(range(1, len(string_split(path, '/')))) t(depth)) JOIN near USING (dir) GROUP BY 1) SELECT path, coalesce(feature, 'new') AS feature FROM o LEFT JOIN up USING (path)", "feature_files")
def rp17(spark, d):
    ff = B.feature_files(spark, d)
    orphans = B.files(spark, d).join(ff.select("path"), "path", "left_anti")
    return N.nearest_owner(orphans, ff).select("path", F.coalesce("feature", F.lit("new")).alias("feature"))


@query("rp19_symbol_claims", "WITH c AS (SELECT path, 'fn' || part % 7 AS name, feature FROM files), k AS (SELECT feature, path, start, stop FROM c JOIN ranges USING (path, name)) SELECT feature, count(*) AS symbols, sum(stop - start + 1)::BIGINT AS lines FROM k GROUP BY 1", "ranges")
def rp19(spark, d):
    """Claimed symbols that exist, with the lines that they take; each file has one claim, so no ranges overlap."""
    claims = B.files(spark, d).select("path", F.concat(F.lit("fn"), (F.col("part") % 7).cast("string")).alias("name"), "feature")
    known = claims.join(L.symbol_ranges(B.symbols(spark, d)), ["path", "name"])
    return L.merged_ranges(known.select("feature", "path", "start", "stop"), ["feature", "path"]).groupBy("feature").agg(F.count(F.lit(1)).alias("symbols"), F.sum(F.expr("stop - start + 1")).alias("lines"))


@query("so5_intersection", "SELECT path FROM files WHERE part % 4 = 0 INTERSECT SELECT path FROM feature_files", "feature_files")
def so5(spark, d):
    return B.files(spark, d).where("part % 4 = 0").select("path").intersect(B.feature_files(spark, d).select("path"))


FLOW = "t AS (SELECT DISTINCT sha, flow, feature FROM commit_files JOIN files USING (path)), n AS (SELECT feature, flow, count(DISTINCT sha) AS commits, count(DISTINCT sha) FILTER (is_bug_fix) AS bugs FROM t JOIN commits USING (sha) GROUP BY 1, 2)"


@query("ag5_flow_bundle", f"WITH {FLOW}, a AS (SELECT flow, count(*) FILTER (c >= greatest(1.0, 0.2 * total)) AS b FROM (SELECT flow, author, count(DISTINCT sha) AS c, sum(count(DISTINCT sha)) OVER (PARTITION BY flow) AS total FROM t JOIN commits USING (sha) GROUP BY 1, 2) GROUP BY 1), w AS (SELECT flow, count(DISTINCT isoyear(ts) * 100 + week(ts)) AS weeks FROM t JOIN commits USING (sha) GROUP BY 1), f AS (SELECT flow, count(*) AS files, count(*) FILTER (path LIKE '%/tests/%') AS tests FROM files GROUP BY 1) SELECT flow, files, tests, commits, bugs, greatest(1, b) AS bus_factor, weeks FROM f JOIN n USING (flow) JOIN a USING (flow) JOIN w USING (flow)", "files commit_files commits")
def ag5(spark, d):
    f, c = B.files(spark, d), B.commits(spark, d)
    t = B.commit_files(spark, d).join(f.select("path", "flow"), "path")
    n = t.select("sha", "flow").distinct().join(c, "sha").groupBy("flow").agg(F.count(F.lit(1)).alias("commits"), F.count_if("is_bug_fix").alias("bugs"), F.countDistinct(A.week_label(F.col("ts"))).alias("weeks"))
    size = f.groupBy("flow").agg(F.count(F.lit(1)).alias("files"), F.count_if(P.is_test_path_regex(F.col("path"))).alias("tests"))
    return size.join(n, "flow").join(A.bus_factor(t, c, "flow"), "flow").select("flow", "files", "tests", "commits", "bugs", "bus_factor", "weeks")


@query("ag13_flow_stats", f"WITH {FLOW}, f AS (SELECT feature, flow, count(*) FILTER (part % 9 = 0) AS files FROM files GROUP BY 1, 2), p AS (SELECT feature, count(DISTINCT sha) AS commits FROM t GROUP BY 1) SELECT feature AS parent, flow AS child, files, CASE WHEN files >= 2 THEN n.commits ELSE p.commits END AS commits FROM f JOIN n USING (feature, flow) JOIN p USING (feature)", "files commit_files commits")
def ag13(spark, d):
    f = B.files(spark, d)
    t = B.commit_files(spark, d).join(f.select("path", "flow", "feature"), "path")
    own = t.groupBy(F.col("feature").alias("parent"), F.col("flow").alias("child")).agg(F.countDistinct("sha").alias("commits"))
    size = f.groupBy(F.col("feature").alias("parent"), F.col("flow").alias("child")).agg(F.count_if(F.col("part") % 9 == 0).alias("files"))
    parents = t.groupBy(F.col("feature").alias("parent")).agg(F.countDistinct("sha").alias("commits"))
    return R.inherited(own.join(size, ["parent", "child"]), parents, ["commits"])


@query("ag5_flow_details", r"""WITH t AS (SELECT DISTINCT sha, path, flow FROM commit_files JOIN files USING (path)), once AS (SELECT DISTINCT sha, flow FROM t), weekly AS (SELECT flow, isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, count(*) AS total, count(*) FILTER (is_bug_fix) AS bug FROM once JOIN commits USING (sha) GROUP BY 1, 2), p AS (SELECT *, count(*) OVER (PARTITION BY flow) AS n, row_number() OVER (PARTITION BY flow ORDER BY week) AS i FROM weekly),
tr AS (SELECT flow, CASE WHEN max(n) >= 4 THEN round(coalesce(sum(bug) FILTER (i <= n // 2) / sum(total) FILTER (i <= n // 2), 0.0) - coalesce(sum(bug) FILTER (i > n // 2) / sum(total) FILTER (i > n // 2), 0.0), 3) END AS trend FROM p GROUP BY 1),
f AS (SELECT flow, path, count(DISTINCT sha) AS c, count(DISTINCT sha) FILTER (is_bug_fix) / count(DISTINCT sha) AS s FROM t JOIN commits USING (sha) WHERE NOT contains(path, '/tests/') GROUP BY 1, 2), h AS (SELECT flow, path, row_number() OVER (PARTITION BY flow ORDER BY s DESC, path) AS place FROM f WHERE c >= 3 AND s > 0.4 QUALIFY place <= 5), hs AS (SELECT flow, string_agg(path, '|' ORDER BY place) AS hotspots FROM h GROUP BY 1),
pr AS (SELECT flow, count(DISTINCT pr_number) AS prs FROM once JOIN commits USING (sha) WHERE is_bug_fix AND pr_number IS NOT NULL GROUP BY 1), r AS (SELECT r.path, name, round(100.0 * count(*) FILTER (hits > 0) / nullif(count(line), 0), 1) AS pct FROM ranges r LEFT JOIN coverage_lines c ON c.path = r.path AND line BETWEEN start AND stop WHERE r.path NOT LIKE '%/tests/%' GROUP BY 1, 2), cv AS (SELECT flow, round(avg(pct), 8) AS coverage FROM r JOIN files USING (path) GROUP BY 1)
SELECT flow, trend, coalesce(hotspots, '') AS hotspots, coalesce(prs, 0) AS prs, coverage FROM tr LEFT JOIN hs USING (flow) LEFT JOIN pr USING (flow) LEFT JOIN cv USING (flow)""", "commits commit_files ranges coverage_lines")
def ag5_details(spark, d):
    ranges = L.range_coverage(L.symbol_ranges(B.symbols(spark, d)), B.coverage_lines(spark, d))
    return A.flow_details(B.files(spark, d), B.commit_files(spark, d), B.commits(spark, d), ranges).withColumn("coverage", F.round("coverage", 8))
