"""Co-change, line scope, graphs, change impact, rules and refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scores as S
from ..operators import attribution as A
from ..operators import cochange as CC
from ..operators import graph as G
from ..operators import impact as I
from ..operators import incremental as N
from ..operators import lines as L
from ..operators import rules as R
from ..sources import bridge as B
from .features import BASE, METRICS, feature_metrics
from .registry import query

BRAND_PAIRS = """cf AS (SELECT DISTINCT sha, feature FROM commit_files JOIN files USING (path)), sz AS (SELECT sha FROM cf GROUP BY 1 HAVING count(*) <= 8), k AS (SELECT cf.* FROM cf JOIN sz USING (sha)), act AS (SELECT feature, count(*) AS c FROM k GROUP BY 1),
n AS (SELECT a.feature AS f1, b.feature AS f2, count(*) AS n FROM k a JOIN k b ON a.sha = b.sha AND a.feature < b.feature GROUP BY 1, 2), pairs AS (SELECT f1, f2, n, x.c AS c1, y.c AS c2, n / (x.c + y.c - n) AS score FROM n JOIN act x ON x.feature = f1 JOIN act y ON y.feature = f2)"""
FILE_PAIRS = BRAND_PAIRS.replace("SELECT DISTINCT sha, feature FROM commit_files JOIN files USING (path)", "SELECT DISTINCT sha, path AS feature FROM commit_files")


def brand_pairs(spark, d):
    own = B.commit_files(spark, d).join(B.files(spark, d).select("path", "feature"), "path")
    return CC.pairs(own, item="feature", bulk=8)


def file_pairs(spark, d):
    return CC.pairs(B.commit_files(spark, d), bulk=8)


@query("jn3_co_change_pairs", f"WITH {BRAND_PAIRS} SELECT f1, f2, n, c1, c2, round(score, 9) AS score FROM pairs", "files commit_files")
def jn3(spark, d):
    return brand_pairs(spark, d).withColumn("score", F.round("score", 9))


@query("ag14_top_co_changes", f"WITH {BRAND_PAIRS} SELECT f1, f2, n, c1, c2, round(score, 2) AS score FROM pairs WHERE n >= 2 AND score >= 0.05 ORDER BY round(score, 2) DESC, f1, f2 LIMIT 40", "files commit_files")
def ag14(spark, d):
    return CC.top_pairs(brand_pairs(spark, d), least_score=0.05)


MISSING = f"{FILE_PAIRS}, both_ways AS (SELECT f1, f2, score FROM pairs UNION ALL SELECT f2, f1, score FROM pairs), change AS (SELECT path FROM files WHERE part % 29 = 0), best AS (SELECT f2 AS path, max(score) AS score FROM both_ways WHERE score >= 0.02 AND f1 IN (SELECT path FROM change) AND f2 NOT IN (SELECT path FROM change) GROUP BY 1)"


@query("jn11_missing_partners", f"WITH {MISSING} SELECT path, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS confidence FROM best ORDER BY best.score DESC, path LIMIT 10", "files commit_files")
def jn11(spark, d):
    change = B.files(spark, d).where("part % 29 = 0")
    return CC.missing_partners(file_pairs(spark, d), change, least_score=0.02)


@query("gr1_co_change_components", f"""WITH RECURSIVE {FILE_PAIRS}, e AS (SELECT f1 AS u, f2 AS v FROM pairs WHERE n >= 3 UNION SELECT f2, f1 FROM pairs WHERE n >= 3), r(node, root) AS (SELECT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node) SELECT node, min(root) AS root FROM r GROUP BY 1""".replace("WITH RECURSIVE", "WITH"), "files commit_files", recursive=True)
def gr1(spark, d):
    return G.components(file_pairs(spark, d).where("n >= 3"))


RANGE_SHAS = "SELECT DISTINCT path, name, sha FROM ranges JOIN blame_lines USING (path) WHERE line BETWEEN start AND stop"


@query("tx3_symbol_ranges", "SELECT path, name, start, stop FROM ranges", "ranges")
def tx3(spark, d):
    return L.symbol_ranges(B.symbols(spark, d))


@query("jn4_range_commits", f"SELECT path, name, count(*) AS commits FROM ({RANGE_SHAS}) GROUP BY 1, 2", "ranges blame_lines")
def jn4(spark, d):
    return L.range_commits(L.symbol_ranges(B.symbols(spark, d)), B.blame_lines(spark, d), ["path", "name"]).groupBy("path", "name").agg(F.count(F.lit(1)).alias("commits"))


@query("jn5_range_coverage", "SELECT r.path, name, start, stop, round(100.0 * count(*) FILTER (hits > 0) / nullif(count(line), 0), 1) AS pct FROM ranges r LEFT JOIN coverage_lines c ON c.path = r.path AND line BETWEEN start AND stop GROUP BY 1, 2, 3, 4", "ranges coverage_lines")
def jn5(spark, d):
    return L.range_coverage(L.symbol_ranges(B.symbols(spark, d)), B.coverage_lines(spark, d))


@query("ag10_feature_coverage", "WITH r AS (SELECT r.path, name, round(100.0 * count(*) FILTER (hits > 0) / nullif(count(line), 0), 1) AS pct FROM ranges r LEFT JOIN coverage_lines c ON c.path = r.path AND line BETWEEN start AND stop WHERE r.path NOT LIKE '%/tests/%' GROUP BY 1, 2) SELECT feature, round(avg(pct), 4) AS coverage FROM r JOIN files USING (path) GROUP BY 1", "ranges coverage_lines")
def ag10(spark, d):
    own = jn5(spark, d).where(~P.is_test_path_regex(F.col("path"))).join(B.files(spark, d).select("path", "feature"), "path")
    return own.groupBy("feature").agg(F.round(F.avg("pct"), 4).alias("coverage"))


@query("jn6_enclosing_symbol", "SELECT path, line, min_by(name, (stop - start, start, name)) AS name FROM (SELECT DISTINCT path, line FROM blame_lines) JOIN ranges USING (path) WHERE line BETWEEN start AND stop GROUP BY 1, 2", "ranges blame_lines")
def jn6(spark, d):
    return L.innermost(B.blame_lines(spark, d), L.symbol_ranges(B.symbols(spark, d)))


@query("so7_merged_ranges", """WITH x AS (SELECT l_partkey AS part, CAST(l_quantity AS INTEGER) AS start, CAST(l_quantity AS INTEGER) + l_linenumber AS stop FROM lineitem), m AS (SELECT *, max(stop) OVER (PARTITION BY part ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR start > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM m), r AS (SELECT part, g, min(start) AS start, max(stop) AS stop FROM i GROUP BY 1, 2) SELECT part, count(*) AS ranges, sum(stop - start + 1)::BIGINT AS lines FROM r GROUP BY 1""")
def so7(spark, d):
    x = B.table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("stop"))
    return L.merged_ranges(x, ["part"]).groupBy("part").agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.expr("stop - start + 1")).alias("lines"))


@query("ag4_line_scoped_health", f"""WITH s AS (SELECT DISTINCT feature, sha FROM ({RANGE_SHAS}) JOIN files USING (path) WHERE name = 'fn1'), w AS (SELECT feature, is_bug_fix, CASE WHEN date_sub('day', ts, as_of) < 30 THEN 2.0 ELSE greatest(0.5, 1.0 - (date_sub('day', ts, as_of) - 30) / 365.0) END AS w FROM s JOIN commits USING (sha), clock),
a AS (SELECT feature, count(*) AS n, sum(CASE WHEN is_bug_fix THEN w ELSE 0.0 END) / sum(w) AS x FROM w GROUP BY 1), h AS (SELECT *, 100.0 / (1 + exp(8 * (x - 0.55))) AS b, least(1.0, n / 50.0) AS a FROM a) SELECT feature, n AS commits, round(b * a + b * (1 - a) * 0.8, 6) AS health FROM h""", "ranges blame_lines commits clock")
def ag4(spark, d):
    """Health of the commits that last touched lines of each file's second symbol."""
    ranges = L.symbol_ranges(B.symbols(spark, d)).where("name = 'fn1'").join(B.files(spark, d).select("path", "feature"), "path")
    history = B.commits(spark, d)
    own = L.range_commits(ranges, B.blame_lines(spark, d), ["feature"])
    return A.metrics(own, own, history, B.as_of(history)).select("feature", F.col("total_commits").alias("commits"), "health")


@query("gr5_flow_reach", "WITH r(seed, node, depth) AS (SELECT path, path, 0 FROM files WHERE part % 97 = 0 UNION SELECT seed, dst, depth + 1 FROM r JOIN edges ON src = node WHERE depth < 3) SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2", "edges", recursive=True)
def gr5(spark, d):
    """Reach from seeds: every 97th file stands for a flow's entry. Walked by part, as paths would be most of what is stored."""
    f = B.files(spark, d).select("part", "path")
    seeds = f.where("part % 97 = 0").select(F.col("part").alias("seed"), F.col("part").alias("node"))
    found = G.reach(B.edge_parts(spark, d).select(F.col("l_partkey").alias("src"), F.col("to").alias("dst")), seeds)
    path = lambda c: f.select(F.col("part").alias(c), F.col("path").alias(f"{c}_path"))
    met = found.join(path("node").hint("merge"), "node").join(G.sized(path("seed").where("seed % 97 = 0")), "seed")
    return met.select(F.col("seed_path").alias("seed"), F.col("node_path").alias("node"), "depth")


@query("gr7_feature_participants", f"WITH r(seed, node, depth) AS (SELECT feature, path, 0 FROM files UNION SELECT seed, dst, depth + 1 FROM r JOIN edges ON src = node WHERE depth < 2), m AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2) SELECT seed AS feature, depth, count(*) AS files FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS i FROM m) WHERE i <= 500 GROUP BY 1, 2", "edges", recursive=True)
def gr7(spark, d):
    seeds = B.files(spark, d).select(F.col("feature").alias("seed"), F.col("path").alias("node"))
    return G.reach(B.edges(spark, d), seeds, depth=2, most=500).groupBy(F.col("seed").alias("feature"), "depth").agg(F.count(F.lit(1)).alias("files"))


@query("gr8_shared_files", "SELECT dst AS path, count(DISTINCT f.feature) AS features FROM edges JOIN files f ON f.path = src GROUP BY 1 HAVING count(DISTINCT f.feature) >= 2", "edges")
def gr8(spark, d):
    e = B.edges(spark, d).join(B.files(spark, d).select(F.col("path").alias("src"), "feature"), "src")
    return e.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("feature").alias("features")).where("features >= 2")


@query("gr9_promoted_files", "WITH b AS (SELECT path, CASE WHEN part % 5 = 0 THEN 'documentation' ELSE 'source' END AS bucket FROM files) SELECT dst AS path, count(DISTINCT src) AS importers FROM edges JOIN b x ON x.path = src AND x.bucket = 'source' JOIN b y ON y.path = dst AND y.bucket = 'documentation' GROUP BY 1 HAVING count(DISTINCT src) >= 2", "edges")
def gr9(spark, d):
    b = B.files(spark, d).select("path", F.when(F.col("part") % 5 == 0, "documentation").otherwise("source").alias("bucket"))
    return G.promoted(B.edges(spark, d), b, least=2)


@query("gr2_import_clusters", "WITH fan AS (SELECT dst, count(*) AS f FROM edges GROUP BY 1), d AS (SELECT path, split_part(path, '/', 3) AS domain FROM files) SELECT src, dst FROM edges JOIN fan USING (dst) JOIN d a ON a.path = src JOIN d b ON b.path = dst WHERE a.domain = b.domain AND f <= (SELECT greatest(8, count(*) // 30) FROM files)", "edges")
def gr2(spark, d):
    own = B.files(spark, d).select("path", F.split("path", "/")[2].alias("domain"))
    return G.import_clusters(B.edges(spark, d), own)


@query("ag25_cohesion", "WITH e AS (SELECT a.flow AS a, b.flow AS b FROM edges JOIN files a ON a.path = src LEFT JOIN files b ON b.path = dst), n AS (SELECT flow AS cluster, count(*) AS files FROM files GROUP BY 1), c AS (SELECT a AS cluster, count(*) FILTER (a = b) AS internal, count(*) FILTER (a IS DISTINCT FROM b) AS external FROM e GROUP BY 1) SELECT cluster, files, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, CASE WHEN files < 2 THEN 1.0 ELSE round(coalesce(internal, 0) / (files * (files - 1)), 6) END AS cohesion FROM n LEFT JOIN c USING (cluster)", "edges")
def ag25(spark, d):
    return G.cohesion(B.edges(spark, d), B.files(spark, d).select(F.col("flow").alias("cluster"), "path"))


@query("jn10_affected_features", "SELECT feature, count(*) AS touched FROM files WHERE part % 29 = 0 GROUP BY 1", "files")
def jn10(spark, d):
    f = B.files(spark, d)
    return I.affected(f.select("feature", "path"), f.where("part % 29 = 0"))


HIT = f"{METRICS}, hit AS (SELECT m.*, touched, feature AS f FROM metrics m JOIN (SELECT feature, count(*) AS touched FROM feature_files WHERE part % 29 = 0 GROUP BY 1) USING (feature))"


@query("ag15_regression_probability", f"WITH {HIT} SELECT round(sum(bug_fix_ratio * touched) / sum(touched), 2) AS probability FROM hit", BASE)
def ag15(spark, d):
    ff = B.feature_files(spark, d)
    return I.regression_probability(I.affected(ff, ff.where("part % 29 = 0")).join(feature_metrics(spark, d), "feature"))


@query("rp18_change_risk", f"WITH {HIT}, {MISSING}, x AS (SELECT count(*) FILTER (health < 30) AS critical_health, count(*) FILTER (health >= 30 AND health < 77) AS at_risk, count(*) FILTER (length(feature) < 7) AS uncovered, count(*) FILTER (length(authors) < 12) AS single_owner FROM hit), y AS (SELECT *, CAST((SELECT count(*) FROM best WHERE score >= 0.05) > 0 AS BIGINT) AS missing FROM x), z AS (SELECT *, critical_health + single_owner + missing AS heavy FROM y) SELECT critical_health, at_risk, uncovered, single_owner, missing, CASE WHEN heavy >= 2 THEN 'critical' WHEN heavy = 1 OR heavy + at_risk + uncovered >= 3 THEN 'high' WHEN heavy + at_risk + uncovered > 0 THEN 'medium' ELSE 'low' END AS level FROM z", BASE)
def rp18(spark, d):
    """Signals of a change: sick, uncovered and single-handed features, and files that usually change with it but are missing."""
    ff = B.feature_files(spark, d)
    hit = I.affected(ff, ff.where("part % 29 = 0")).join(feature_metrics(spark, d), "feature")
    hit = hit.select("feature", "health", F.when(F.length("feature") < 7, 10).otherwise(80).alias("coverage"), F.when(F.length("authors") < 12, 1).otherwise(3).alias("bus_factor"))
    missing = CC.missing_partners(file_pairs(spark, d), B.files(spark, d).where("part % 29 = 0"), least_score=0.02)
    return I.risk_level(hit, missing.select((F.col("score") >= 0.05).alias("high")), at_risk_health=77)


SNAPS = "was AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), now AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 1), diff AS (SELECT coalesce(w.path, n.path) AS path, CASE WHEN w.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN w.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'modified' END AS status FROM was w FULL JOIN now n ON w.path = n.path)"


def snapshots(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    text = F.when(F.col("path") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.where("path % 10 <> 0").select("path", N.content_hash(F.col("text")).alias("hash")), docs.where("path % 10 <> 1").select("path", N.content_hash(text).alias("hash"))


@query("jn12_snapshot_diff", f"WITH {SNAPS} SELECT * FROM diff")
def jn12(spark, d):
    return N.snapshot_diff(*snapshots(spark, d), unchanged=True)


@query("st8_refresh_plan", f"WITH {SNAPS}, f AS (SELECT path % 40 AS feature, status FROM diff WHERE status <> 'added' AND path >= 0) SELECT CAST(feature AS VARCHAR) AS feature, count(*) AS files, count(*) FILTER (status = 'modified') AS changed, count(*) FILTER (status = 'removed') AS removed, CASE WHEN count(*) FILTER (status = 'removed') = count(*) THEN 'deleted' WHEN count(*) FILTER (status IN ('modified', 'removed')) > 0 THEN 'stale' ELSE 'clean' END AS plan FROM f GROUP BY 1")
def st8(spark, d):
    old, new = snapshots(spark, d)
    return N.feature_plan(old.select((F.col("path") % 40).cast("string").alias("feature"), "path"), N.snapshot_diff(old, new))


@query("so4_fresh_files", f"WITH {SNAPS} SELECT path FROM diff WHERE status = 'added'")
def so4(spark, d):
    old, new = snapshots(spark, d)
    return N.fresh_files(N.snapshot_diff(old, new), old)


@query("jn2_nearest_owner", "WITH ff AS (SELECT * FROM feature_files WHERE path NOT LIKE '%/tests/%'), own AS (SELECT path, max(feature) AS own FROM ff GROUP BY 1), near AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, min(feature) AS near FROM ff GROUP BY 1), up AS (SELECT path, max_by(near, depth) AS near FROM (SELECT path, depth, array_to_string(list_slice(string_split(path, '/'), 1, depth), '/') AS dir FROM files, unnest(range(1, len(string_split(path, '/')))) t(depth)) JOIN near USING (dir) GROUP BY 1) SELECT path, coalesce(own, near) AS feature, CASE WHEN own IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'ancestor' END AS how FROM files LEFT JOIN own USING (path) LEFT JOIN up USING (path)", "feature_files")
def jn2(spark, d):
    return N.nearest_owner(B.files(spark, d), B.feature_files(spark, d).where("path not like '%/tests/%'"))


BURST = "b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM b)"


@query("st1_debounce", f"WITH {BURST} SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM g GROUP BY user_id, burst")
def st1(spark, d):
    return N.sessions(B.table(spark, d, "events"), 3600, ["user_id"])


@query("st4_event_batches", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, event_id) - 1 AS i FROM events) SELECT date_trunc('minute', ts) AS minute, i // 200 AS batch, count(*) AS n FROM e GROUP BY 1, 2")
def st4(spark, d):
    from pyspark.sql import Window as W

    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    i = F.row_number().over(W.partitionBy(minute).orderBy("ts", "event_id")) - 1
    return B.table(spark, d, "events").select(minute.alias("minute"), F.floor(i / 200).alias("batch")).groupBy("minute", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("sc18_traffic", "SELECT '/u/' || user_id % 20 AS route, count(*) AS views, count(DISTINCT user_id) AS visitors, round(avg(value), 6) AS duration FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY views DESC, route LIMIT 500")
def sc18(spark, d):
    e = B.table(spark, d, "events").where("event_type = 'view'").select(F.concat(F.lit("/u/"), (F.col("user_id") % 20).cast("string")).alias("route"), "user_id", "value")
    return e.groupBy("route").agg(F.count(F.lit(1)).alias("views"), F.countDistinct("user_id").alias("visitors"), F.round(F.avg("value"), 6).alias("duration")).orderBy(F.desc("views"), "route").limit(500)


@query("ag18_errors_by_route", "WITH e AS (SELECT '/u/' || user_id % 20 AS route, event_id, value FROM events WHERE event_type = 'error') SELECT route, count(*) AS errors, round(sum(value), 4) AS total, array_to_string(list_slice(list(event_id ORDER BY value DESC, event_id), 1, 10), '|') AS top FROM e GROUP BY 1")
def ag18(spark, d):
    from pyspark.sql import Window as W

    e = B.table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("/u/"), (F.col("user_id") % 20).cast("string")).alias("route"), "event_id", "value")
    ranked = e.withColumn("i", F.row_number().over(W.partitionBy("route").orderBy(F.desc("value"), "event_id")))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= 10, F.struct("i", "event_id")))), lambda x: x["event_id"].cast("string")), "|")
    return ranked.groupBy("route").agg(F.count(F.lit(1)).alias("errors"), F.round(F.sum("value"), 4).alias("total"), top.alias("top"))


@query("ag19_impact_scores", f"WITH {METRICS}, t AS (SELECT user_id % 20 AS k, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1), s AS (SELECT feature, 0.40 * health + 0.35 * (100 - 100 * least(log10(greatest(coalesce(views, 0), 1)) / 5.0, 1)) + 0.25 * (100 - 100 * least(log10(greatest(coalesce(errors, 0), 1)) / 4.0, 1)) AS score FROM metrics LEFT JOIN t ON k = length(feature) + total_commits % 10) SELECT feature, round(score, 6) AS score, CASE WHEN score < 25 THEN 'critical' WHEN score < 45 THEN 'high' WHEN score < 65 THEN 'medium' WHEN score < 80 THEN 'low' ELSE 'healthy' END AS level FROM s", BASE)
def ag19(spark, d):
    t = B.table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("k")).agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "error").alias("errors"))
    m = feature_metrics(spark, d).join(t, F.col("k") == F.length("feature") + F.col("total_commits") % 10, "left")
    score = S.impact(F.col("health"), F.coalesce("views", F.lit(0)), F.coalesce("errors", F.lit(0)))
    return m.select("feature", F.round(score, 6).alias("score"), S.impact_level(score).alias("level"))


@query("ag20_digest", "SELECT author, year(ts) AS year, count(DISTINCT sha) AS commits, count(DISTINCT sha) FILTER (is_bug_fix) AS fixes, count(*) AS touches FROM commits JOIN commit_files USING (sha) GROUP BY 1, 2", "commits commit_files")
def ag20(spark, d):
    c = B.commits(spark, d).join(B.commit_files(spark, d), "sha")
    return c.groupBy("author", F.year("ts").cast("long").alias("year")).agg(F.countDistinct("sha").alias("commits"), F.countDistinct(F.when(F.col("is_bug_fix"), F.col("sha"))).alias("fixes"), F.count(F.lit(1)).alias("touches"))


@query("ag21_recent_activity", "WITH r AS (SELECT path FROM commit_files JOIN commits USING (sha), clock WHERE ts >= as_of - INTERVAL 180 DAY), u AS (SELECT 'file' AS kind, path AS name, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'dir', regexp_extract(path, '^(.*)/[^/]*$', 1), count(*) FROM r GROUP BY 2) SELECT * FROM u ORDER BY n DESC, kind, name LIMIT 30", "commits commit_files clock")
def ag21(spark, d):
    c = B.commits(spark, d)
    r = B.commit_files(spark, d).join(c.crossJoin(F.broadcast(B.as_of(c))).where(F.expr("ts >= as_of - interval 180 days")).select("sha"), "sha")
    files = r.groupBy(F.col("path").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("file"))
    dirs = r.groupBy(P.parent(F.col("path")).alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("dir"))
    return files.unionByName(dirs).orderBy(F.desc("n"), "kind", "name").limit(30)


@query("ag26_cost_totals", "SELECT c_mktsegment AS label, count(*) AS calls, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1 HAVING sum(c_acctbal) > 0")
def ag26(spark, d):
    return B.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("c_acctbal"), 2).alias("total")).where("total > 0")


@query("ag27_majority", "WITH n AS (SELECT flow, CASE WHEN part % 3 = 0 THEN feature ELSE 'other' END AS owner, count(*) AS votes FROM files GROUP BY 1, 2), r AS (SELECT *, sum(votes) OVER (PARTITION BY flow) AS total, row_number() OVER (PARTITION BY flow ORDER BY votes DESC, owner) AS i FROM n) SELECT flow, owner, votes, total::BIGINT AS total FROM r WHERE i = 1 AND votes >= 0.6 * total", "files")
def ag27(spark, d):
    votes = B.files(spark, d).select("flow", F.when(F.col("part") % 3 == 0, F.col("feature")).otherwise("other").alias("owner"))
    return R.majority(votes, "flow", "owner")


VERDICTS = "v AS (SELECT DISTINCT flow, feature AS current_owner, CASE WHEN length(flow) % 2 = 0 THEN 'move' ELSE 'keep' END AS decision, CASE WHEN length(flow) % 3 = 0 THEN 'nowhere' ELSE 'brand1' END AS destination, CAST(3 + length(flow) % 3 AS INTEGER) AS confidence FROM files)"


def verdicts(spark, d):
    n = F.length("flow")
    return B.files(spark, d).select("flow", F.col("feature").alias("current_owner")).distinct().select("flow", "current_owner", F.when(n % 2 == 0, "move").otherwise("keep").alias("decision"), F.when(n % 3 == 0, "nowhere").otherwise("brand1").alias("destination"), (F.lit(3) + n % 3).alias("confidence"), F.array(F.lit("brand2"), F.lit("ghost")).alias("also_belongs_to"))


@query("rp10_apply_verdicts", f"WITH {VERDICTS} SELECT flow, CASE WHEN decision = 'move' AND confidence >= 4 AND destination = 'brand1' THEN 'brand1' ELSE current_owner END AS owner, decision = 'move' AND confidence >= 4 AND destination = 'brand1' AS moved FROM v", "files")
def rp10(spark, d):
    f = B.files(spark, d)
    return R.verdicts_applied(f.select("flow", F.col("feature").alias("owner")).distinct(), verdicts(spark, d), f)


@query("rp10_secondaries", "SELECT DISTINCT flow, 'brand2' AS features FROM files", "files")
def rp10b(spark, d):
    return R.secondaries(verdicts(spark, d), B.files(spark, d))


@query("rp6_renames", "SELECT CASE WHEN feature IN ('brand3', 'brand4') THEN 'merged' ELSE feature END AS feature, count(*) AS files FROM files WHERE feature <> 'brand5' GROUP BY 1", "files")
def rp6(spark, d):
    names = spark.createDataFrame([("brand3", "merged"), ("brand4", "merged"), ("brand5", None)], "old string, new string")
    return R.renamed(B.files(spark, d).select("feature", "path"), names).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))


@query("rp9_domain_promotion", """WITH fo AS (SELECT part, flow, CASE WHEN part % 31 = 0 THEN 'documentation' WHEN part % 37 = 0 THEN 'Account Settings' WHEN part % 3 = 1 AND part % 7 = 0 THEN 'plans' ELSE feature END AS owner, CASE part % 5 WHEN 0 THEN 'sso/' WHEN 1 THEN 'stripe_' WHEN 2 THEN 'alert_rule/' ELSE 'x/' END || path AS path, CASE part % 5 WHEN 0 THEN 'auth' WHEN 1 THEN 'billing' WHEN 2 THEN 'notifications' END AS inside FROM files),
fl AS (SELECT DISTINCT owner, flow || ['-sso', '-Pricing', '_alert_rule', '-email', '-view', '/MFA'][CAST(part % 6 AS INTEGER) + 1] AS flow, ['auth', 'billing', 'notifications', '', '', 'auth'][CAST(part % 6 AS INTEGER) + 1] AS domain FROM fo),
ff AS (SELECT owner AS feature, path, inside FROM fo WHERE owner <> 'Account Settings' UNION SELECT 'Account Settings', 'settings/' || p_partkey, NULL FROM part WHERE p_partkey <= 6 UNION SELECT 'plans', 'plan/' || p_partkey, NULL FROM part WHERE p_partkey <= 40),
moves AS (SELECT DISTINCT domain, CASE domain WHEN 'auth' THEN 'Account Settings' ELSE domain END AS target, domain = 'auth' AS backfill, owner, flow FROM fl WHERE domain IN ('auth', 'notifications') AND NOT (domain = 'auth' AND owner = 'Account Settings'))
SELECT DISTINCT m.domain, target, backfill, 'path' AS kind, m.owner, path AS item FROM moves m JOIN ff ON ff.feature = m.owner AND inside = m.domain WHERE m.owner <> 'documentation' UNION ALL SELECT domain, target, backfill, 'flow', owner, flow FROM moves""", "files")
def rp9(spark, d):
    """A small feature that covers `auth` by its name is filled up, a large one keeps `billing` as it is, `notifications` gets a feature; documentation keeps its paths."""
    i = (F.col("part") % 6).cast("int")
    owner = F.when(F.col("part") % 31 == 0, "documentation").when(F.col("part") % 37 == 0, "Account Settings").when((F.col("part") % 3 == 1) & (F.col("part") % 7 == 0), "plans").otherwise(F.col("feature"))
    lead = F.get(F.array(*map(F.lit, ("sso/", "stripe_", "alert_rule/", "x/", "x/"))), (F.col("part") % 5).cast("int"))
    own = B.files(spark, d).withColumn("owner", owner).withColumn("path", F.concat(lead, "path"))
    flows = own.select("owner", F.concat("flow", F.get(F.array(*map(F.lit, ("-sso", "-Pricing", "_alert_rule", "-email", "-view", "/MFA"))), i)).alias("flow"))
    p = B.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_partkey")
    small = p.where("p_partkey <= 6").select(F.lit("Account Settings").alias("feature"), F.concat(F.lit("settings/"), "k").alias("path"))
    large = p.where("p_partkey <= 40").select(F.lit("plans").alias("feature"), F.concat(F.lit("plan/"), "k").alias("path"))
    features = own.where("owner <> 'Account Settings'").select(F.col("owner").alias("feature"), "path").unionByName(small).unionByName(large)
    return R.promoted_domains(flows, features)


@query("tk6_flow_cap", r"""WITH f AS (SELECT feature AS owner, split_part(flow, '-', 2) || part % 3 AS flow, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM (SELECT feature, flow, part, CASE WHEN part % 3 = 2 AND p_size % 2 = 0 THEN 'alone/' || part ELSE path END AS path FROM files JOIN part ON p_partkey = part)),
s AS (SELECT owner, flow, row_number() OVER (PARTITION BY owner ORDER BY count(*) DESC, flow) AS place FROM f GROUP BY 1, 2), pl AS (SELECT * FROM f JOIN s USING (owner, flow)), dirs AS (SELECT owner, dir, min(place) AS place FROM pl WHERE place <= 3 GROUP BY 1, 2),
sc AS (SELECT owner, flow, d.place, count(*) AS n FROM pl JOIN dirs d USING (owner, dir) WHERE pl.place > 3 GROUP BY 1, 2, 3), b AS (SELECT owner, flow, min_by(place, (-n, place)) AS place FROM sc GROUP BY 1, 2)
SELECT s.owner, s.flow, k.flow AS kept_as FROM s LEFT JOIN b USING (owner, flow) JOIN s k ON k.owner = s.owner AND k.place = CASE WHEN s.place <= 3 THEN s.place ELSE coalesce(b.place, 1) END""", "files")
def tk6(spark, d):
    size = B.table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_size")
    f = B.files(spark, d).join(size, "part")
    path = F.when((F.col("part") % 3 == 2) & (F.col("p_size") % 2 == 0), F.concat(F.lit("alone/"), F.col("part").cast("string"))).otherwise(F.col("path"))
    return R.capped_flows(f.select(F.col("feature").alias("owner"), F.concat(F.split("flow", "-")[1], (F.col("part") % 3).cast("string")).alias("flow"), path.alias("path")), most=3)


@query("so3_exact_cover", "WITH p AS (SELECT feature, flow, path FROM files WHERE NOT (feature = 'brand7' AND part % 5 = 0)) SELECT feature, count(DISTINCT flow) BETWEEN 2 AND 8 AND count(*) = (SELECT count(*) FROM files f WHERE f.feature = p.feature) AS valid FROM p GROUP BY 1", "files")
def so3(spark, d):
    f = B.files(spark, d)
    parts = f.where("not (feature = 'brand7' and part % 5 = 0)").select("feature", F.col("flow").alias("part"), "path")
    return R.exact_cover(parts, f)


@query("rp16_domain_clusters", "SELECT regexp_extract(path, '([a-z]+)_[^/]*$', 1) AS keyword, count(DISTINCT path) AS files, count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) AS dirs FROM files GROUP BY 1 HAVING count(DISTINCT path) >= 2 AND count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) >= 2", "files")
def rp16(spark, d):
    f = B.files(spark, d).select("path", P.parent(F.col("path")).alias("dir"), F.regexp_extract("path", "([a-z]+)_[^/]*$", 1).alias("word"))
    return R.domain_clusters(f)


@query("so1_merged_paths", "SELECT 'g' || substr(feature, 6, 1) AS feature, count(DISTINCT path) AS paths, count(DISTINCT flow) AS flows FROM files GROUP BY 1", "files")
def so1(spark, d):
    f = B.files(spark, d)
    return f.groupBy(F.concat(F.lit("g"), F.substring("feature", 6, 1)).alias("feature")).agg(F.countDistinct("path").alias("paths"), F.countDistinct("flow").alias("flows"))


@query("jn13_longest_prefix", "WITH p AS (SELECT DISTINCT 'src/' || feature AS prefix FROM files UNION SELECT DISTINCT 'src/' || feature || '/promo' FROM files WHERE feature LIKE '%1') SELECT path, max_by(prefix, length(prefix)) AS package FROM files JOIN p ON starts_with(path, prefix || '/') GROUP BY 1", "files")
def jn13(spark, d):
    f = B.files(spark, d)
    base = f.select(F.concat(F.lit("src/"), "feature").alias("prefix")).distinct()
    more = f.where("feature like '%1'").select(F.concat(F.lit("src/"), "feature", F.lit("/promo")).alias("prefix")).distinct()
    parts = F.split("path", "/")
    above = f.select("path", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n")).select("path", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("n")), "/").alias("prefix"))
    return above.join(base.unionByName(more), "prefix").groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("package"))


@query("jn8_calls_to_routes", "WITH r AS (SELECT 'f' || p_partkey AS dst, '/u/' || p_partkey % 40 || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '/:*' END AS pattern, CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE '*' END AS method FROM part), c AS (SELECT DISTINCT '/u/' || user_id % 60 || CASE WHEN user_id % 7 = 0 THEN '' ELSE '/' || event_type END AS pattern, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method FROM events) SELECT DISTINCT c.method || ' ' || c.pattern AS src, dst, '@http' AS symbol FROM c JOIN r ON (r.method = c.method OR r.method = '*') AND regexp_matches(c.pattern, '^' || replace(r.pattern, ':*', '[^/]+') || '$')")
def jn8(spark, d):
    from ..operators import extract as X

    p, u = F.col("p_partkey"), F.col("user_id")
    served = B.table(spark, d, "part").select(F.concat(F.lit("f"), p.cast("string")).alias("path"), F.when(p % 3 == 0, "GET").when(p % 3 == 1, "POST").otherwise("*").alias("method"), F.concat(F.lit("/u/"), (p % 40).cast("string"), F.when(p % 5 == 0, "").otherwise("/:*")).alias("pattern"))
    calls = B.table(spark, d, "events").select(F.when(u % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/u/"), (u % 60).cast("string"), F.when(u % 7 == 0, "").otherwise(F.concat(F.lit("/"), "event_type"))).alias("pattern")).distinct()
    return X.http_edges(calls.withColumn("path", F.concat_ws(" ", "method", "pattern")), served)


@query("st6_freshness", f"WITH {SNAPS}, f AS (SELECT path % 40 AS feature, count(*) FILTER (status <> 'unchanged') AS changed, count(*) AS files FROM diff GROUP BY 1) SELECT feature, changed, changed > 0 AS stale FROM f")
def st6(spark, d):
    diff = N.snapshot_diff(*snapshots(spark, d), unchanged=True)
    return diff.groupBy((F.col("path") % 40).alias("feature")).agg(F.count_if(F.col("status") != "unchanged").alias("changed")).withColumn("stale", F.col("changed") > 0)


@query("sk4_input_keys", "SELECT feature, sha256(array_to_string(list_sort(list(DISTINCT path)), ',')) AS key FROM files GROUP BY 1", "files")
def sk4(spark, d):
    return B.files(spark, d).groupBy("feature").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("path")), ",").cast("binary"), 256).alias("key"))


@query("tk8_directory_neighbours", "WITH d AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files), n AS (SELECT a.path, b.path AS neighbour, row_number() OVER (PARTITION BY a.path ORDER BY b.path) AS place FROM d a JOIN d b ON a.dir = b.dir AND a.path <> b.path) SELECT * FROM n WHERE place <= 8", "files")
def tk8(spark, d):
    """The first eight other files of each file's directory; a file meets the directory's first nine, not all."""
    from pyspark.sql import Window as W

    f = B.files(spark, d).select("path", P.parent(F.col("path")).alias("dir"))
    i = F.row_number().over(W.partitionBy("dir").orderBy("path"))
    numbered = f.withColumn("i", i)
    first = numbered.where("i <= 9").select("dir", F.col("path").alias("neighbour"), F.col("i").alias("j"))
    met = numbered.join(first, "dir").where("path <> neighbour")
    place = F.when(F.col("j") > F.col("i"), F.col("j") - 1).otherwise(F.col("j"))
    return met.select("path", "neighbour", place.alias("place")).where("place <= 8")


@query("sc9_covered_bits", "SELECT l_partkey AS part, bit_count(bit_or(CAST(1 AS BIGINT) << CAST(l_quantity AS INTEGER)))::BIGINT AS lines FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def sc9(spark, d):
    l = B.table(spark, d, "lineitem").where("l_discount > 0.05")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l_quantity").cast("int"))
    return l.groupBy(F.col("l_partkey").alias("part")).agg(F.bit_count(F.bit_or(bit)).cast("long").alias("lines"))
