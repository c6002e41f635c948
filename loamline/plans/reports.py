"""Reports over a map: summary, hotspots with files, owners at risk, centrality, tests near flows, rows of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import reports as R
from ..sources import bridge as B
from .features import BASE, METRICS, feature_metrics
from .registry import query
from .structure import jn5

COVERED = "cv AS (SELECT feature, avg(pct) AS pct FROM (SELECT r.path, name, round(100.0 * count(*) FILTER (hits > 0) / nullif(count(line), 0), 1) AS pct FROM ranges r LEFT JOIN coverage_lines c ON c.path = r.path AND line BETWEEN start AND stop GROUP BY 1, 2) JOIN files USING (path) WHERE part % 7 > 0 GROUP BY 1)"


@query("ag16_map_summary", f"WITH {METRICS}, {COVERED} SELECT count(*) AS features, (SELECT count(DISTINCT flow) FROM files) AS flows, sum(bug_fixes)::BIGINT AS bug_fixes, round(avg(health), 1) AS mean_health, (SELECT round(avg(pct), 1) FROM cv) AS mean_coverage, count(*) FILTER (health < 50) AS at_risk FROM metrics", f"{BASE} ranges coverage_lines")
def ag16_map(spark, d):
    cover = jn5(spark, d).join(B.files(spark, d).where("part % 7 > 0").select("path", "feature"), "path").groupBy("feature").agg(F.avg("pct").alias("pct"))
    return R.repo_summary(feature_metrics(spark, d), B.files(spark, d), cover)


FLOW_TOUCHES = "ft AS (SELECT DISTINCT sha, path, flow, feature FROM commit_files JOIN files USING (path))"
HOT = f"{FLOW_TOUCHES}, hf AS (SELECT feature, flow, path, count(DISTINCT sha) AS n, count(DISTINCT sha) FILTER (is_bug_fix) AS b FROM ft JOIN commits USING (sha) WHERE path NOT LIKE '%/tests/%' GROUP BY 1, 2, 3), hp AS (SELECT *, row_number() OVER (PARTITION BY feature, flow ORDER BY b / n DESC, path) AS place FROM hf WHERE n >= 3 AND b > 0.2 * n), hi AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY flow, place) AS i FROM hp WHERE place <= 5), h3 AS (SELECT feature, string_agg(path, '|' ORDER BY i) AS hotspot_files FROM hi WHERE i <= 3 GROUP BY 1)"


def flow_touches(spark, d):
    return B.commit_files(spark, d).join(B.files(spark, d).select("path", "flow", "feature"), "path")


@query("tk3_hotspot_files", f"WITH {METRICS}, {HOT} SELECT feature, health, bug_fixes, coalesce(hotspot_files, '') AS hotspot_files, array_to_string(list_slice(string_split(authors, '|'), 1, 3), '|') AS owners FROM (SELECT * FROM metrics ORDER BY health, feature LIMIT 10) LEFT JOIN h3 USING (feature)", BASE)
def tk3_files(spark, d):
    hot = A.hotspots(flow_touches(spark, d), B.commits(spark, d), "flow", share=0.2)
    return R.hotspot_features(feature_metrics(spark, d), hot.join(B.files(spark, d).select("flow", "feature").distinct(), "flow"))


@query("ag30_owner_risk", f"WITH {METRICS}, {FLOW_TOUCHES}, pa AS (SELECT feature, flow, author, count(DISTINCT sha) AS c FROM ft JOIN commits USING (sha) WHERE author <> 'BUILDING' AND feature NOT LIKE 'brand4%' GROUP BY 1, 2, 3), bf AS (SELECT feature, flow, greatest(1, count(*) FILTER (c >= greatest(1.0, 0.24 * total))) AS bus FROM (SELECT *, sum(c) OVER (PARTITION BY feature, flow) AS total FROM pa) GROUP BY 1, 2), le AS (SELECT feature, min(bus) AS least FROM bf GROUP BY 1) SELECT feature, len(list_filter(string_split(authors, '|'), lambda x: x <> ''))::BIGINT AS contributors, coalesce(least, greatest(1, len(list_filter(string_split(authors, '|'), lambda x: x <> ''))))::BIGINT AS bus_factor, coalesce(least, greatest(1, len(list_filter(string_split(authors, '|'), lambda x: x <> '')))) = 1 AS at_risk FROM metrics LEFT JOIN le USING (feature)", BASE)
def ag30_risk(spark, d):
    """The features of brand4x have no flows here, and one author is left out of the flows' count."""
    own = flow_touches(spark, d).where("feature not like 'brand4%'")
    bus = A.bus_factor(own, B.commits(spark, d).where("author <> 'BUILDING'"), "flow", share=0.24)
    return R.owners(feature_metrics(spark, d), bus.join(B.files(spark, d).select("flow", "feature").distinct(), "flow"))


@query("ag24_centrality", "WITH en AS (SELECT flow, min(path) AS path FROM files GROUP BY 1), z AS (SELECT feature, count(*) AS size FROM files GROUP BY 1) SELECT en.flow, f.feature, round(count(DISTINCT src) / any_value(size), 6) AS centrality FROM en JOIN edges ON dst = en.path JOIN files f ON f.path = src JOIN z ON z.feature = f.feature GROUP BY 1, 2", "edges")
def ag24_centrality(spark, d):
    f = B.files(spark, d)
    return R.centrality(f.groupBy("flow").agg(F.min("path").alias("path")), f.select("feature", "path"), B.edges(spark, d))


@query("ag12_adjacent_tests", r"""WITH own AS (SELECT flow, path FROM files WHERE path NOT LIKE '%/tests/%' OR part % 3 = 0), ds AS (SELECT DISTINCT flow, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM own), te AS (SELECT sha, path FROM commit_files WHERE path LIKE '%/tests/%'),
nr AS (SELECT DISTINCT flow, sha FROM te JOIN ds ON dir = regexp_extract(path, '^(.*)/[^/]*$', 1)), ad AS (SELECT flow, count(DISTINCT te.path) AS adjacent FROM nr JOIN te USING (sha) GROUP BY 1) SELECT flow, count(*) FILTER (path LIKE '%/tests/%') AS own, coalesce(any_value(adjacent), 0) AS adjacent FROM own LEFT JOIN ad USING (flow) GROUP BY 1""", "commit_files")
def ag12_adjacent(spark, d):
    """Two thirds of the tests are no flow's own."""
    own = B.files(spark, d).where("path not like '%/tests/%' or part % 3 = 0").select("flow", "path")
    return R.test_files(own, B.commit_files(spark, d))


FLOW_METRICS = f"{FLOW_TOUCHES}, fo AS (SELECT DISTINCT sha, flow, feature FROM ft), fw AS (SELECT feature, flow, is_bug_fix, CASE WHEN date_sub('day', ts, as_of) < 30 THEN 2.0 ELSE greatest(0.5, 1.0 - (date_sub('day', ts, as_of) - 30) / 365.0) END AS w FROM fo JOIN commits USING (sha), clock), fs AS (SELECT feature, flow, count(*) AS total_commits, count(*) FILTER (is_bug_fix) AS bug_fixes, sum(CASE WHEN is_bug_fix THEN w ELSE 0.0 END) / sum(w) AS x FROM fw GROUP BY 1, 2), fm AS (SELECT *, round(bug_fixes / total_commits, 3) AS bug_fix_ratio, 100.0 / (1 + exp(8 * (x - 0.55))) * (least(1.0, total_commits / 50.0) + (1 - least(1.0, total_commits / 50.0)) * 0.8) AS health FROM fs)"
COUNTS = "'health ' || CAST(round(health) AS BIGINT) || ', ' || total_commits || ' commits, ' || bug_fixes || ' fixes'"


@query("sk2_two_level_rows", f"WITH {METRICS}, {FLOW_METRICS} SELECT feature, 0 AS place, feature || ': ' || {COUNTS} AS row FROM metrics UNION ALL SELECT feature, row_number() OVER v, CASE WHEN lead(flow) OVER v IS NULL THEN '└─ ' ELSE '├─ ' END || flow || ': ' || {COUNTS} FROM fm WINDOW v AS (PARTITION BY feature ORDER BY bug_fix_ratio DESC, flow)", BASE)
def sk2_rows(spark, d):
    c, f = B.commits(spark, d), B.files(spark, d)
    flows = A.metrics(f, flow_touches(spark, d), c, B.as_of(c), "flow").where("total_commits > 0").join(f.select("flow", "feature").distinct(), "flow")
    return R.two_level_rows(feature_metrics(spark, d), flows)


@query("sk2_top_risks", f"WITH {METRICS} SELECT row_number() OVER (ORDER BY bug_fix_ratio DESC, feature) AS place, feature || ': ' || bug_fixes || ' bug fixes out of ' || total_commits || ' commits' AS row FROM metrics WHERE bug_fixes > 0 ORDER BY bug_fix_ratio DESC, feature LIMIT 3", BASE)
def sk2_risks(spark, d):
    return R.top_risks(feature_metrics(spark, d))


@query("ag20_by_directory", "WITH t AS (SELECT sha, CASE WHEN part % 9 = 0 THEN '.' WHEN part % 4 = 0 THEN 'lib' ELSE 'src' END AS dir FROM commit_files JOIN files USING (path)) SELECT dir, count(DISTINCT sha) AS commits, count(DISTINCT sha) FILTER (is_bug_fix) AS fixes, count(*) AS touches FROM t JOIN commits USING (sha) GROUP BY 1", "commits commit_files")
def ag20_dirs(spark, d):
    f = B.files(spark, d)
    path = F.when(F.col("part") % 9 == 0, F.concat(F.lit("f"), F.col("part").cast("string"))).when(F.col("part") % 4 == 0, F.concat(F.lit("lib/"), "path")).otherwise(F.col("path"))
    return R.digest_by_directory(B.commit_files(spark, d).join(f, "path").select("sha", path.alias("path")), B.commits(spark, d))


@query("jn10_affected_flows", "SELECT feature, flow, count(*) AS touched FROM files WHERE part % 29 = 0 GROUP BY 1, 2", "files")
def jn10_flows(spark, d):
    f = B.files(spark, d)
    return R.affected_flows(f, f.where("part % 29 = 0"))
