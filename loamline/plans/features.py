"""Feature and flow metrics over the whole history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import attribution as A
from ..sources import bridge as B
from .registry import query

ASSIGNED = """own AS (SELECT path, max(feature) AS own FROM feature_files GROUP BY 1),
near AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, min(feature) AS near FROM feature_files GROUP BY 1),
touched AS (SELECT DISTINCT sha, c.path, coalesce(own, near) AS feature FROM commit_files c LEFT JOIN own USING (path) LEFT JOIN near ON near.dir = regexp_extract(c.path, '^(.*)/[^/]*$', 1) WHERE coalesce(own, near) IS NOT NULL)"""
WEIGHTED = "once AS (SELECT t.feature, c.*, date_sub('day', ts, as_of) AS age FROM (SELECT DISTINCT sha, feature FROM touched) t JOIN commits c USING (sha), clock), weighted AS (SELECT *, CASE WHEN age < 30 THEN 2.0 ELSE greatest(0.5, 1.0 - (age - 30) / 365.0) END AS w FROM once)"
METRICS = f"""{ASSIGNED}, {WEIGHTED}, sums AS (SELECT feature, count(*) AS n, count(*) FILTER (is_bug_fix) AS bugs, array_to_string(list_sort(list(DISTINCT author)), '|') AS authors, max(ts) AS last_modified, sum(CASE WHEN is_bug_fix THEN w ELSE 0.0 END) / sum(w) AS x FROM weighted GROUP BY 1),
scored AS (SELECT *, 100.0 / (1 + exp(8 * (x - 0.55))) AS b, least(1.0, n / 50.0) AS a FROM sums),
metrics AS (SELECT f.feature, coalesce(n, 0) AS total_commits, coalesce(bugs, 0) AS bug_fixes, coalesce(round(bugs / n, 3), 0.0) AS bug_fix_ratio, coalesce(authors, '') AS authors, last_modified, coalesce(round(b * a + b * (1 - a) * 0.8, 6), 100.0) AS health FROM (SELECT DISTINCT feature FROM feature_files) f LEFT JOIN scored USING (feature))"""
BASE = "feature_files commits commit_files clock"


def touched(spark, d):
    return A.assigned(B.commit_files(spark, d), B.feature_files(spark, d))


def feature_metrics(spark, d):
    history = B.commits(spark, d)
    return A.metrics(B.feature_files(spark, d), touched(spark, d), history, B.as_of(history))


@query("jn1_commit_to_feature", f"WITH {ASSIGNED} SELECT feature, count(*) AS touches, count(DISTINCT sha) AS commits, count(DISTINCT path) AS paths FROM touched GROUP BY 1", "feature_files commit_files")
def jn1(spark, d):
    return touched(spark, d).groupBy("feature").agg(F.count(F.lit(1)).alias("touches"), F.countDistinct("sha").alias("commits"), F.countDistinct("path").alias("paths"))


@query("ag1_feature_metrics", f"WITH {METRICS} SELECT * FROM metrics", BASE)
def ag1(spark, d):
    return feature_metrics(spark, d)


@query("ag2_health_by_flow", f"""WITH t AS (SELECT DISTINCT sha, flow FROM commit_files JOIN files USING (path)), w AS (SELECT flow, is_bug_fix, CASE WHEN date_sub('day', ts, as_of) < 30 THEN 2.0 ELSE greatest(0.5, 1.0 - (date_sub('day', ts, as_of) - 30) / 365.0) END AS w FROM t JOIN commits USING (sha), clock),
s AS (SELECT flow, count(*) AS n, sum(CASE WHEN is_bug_fix THEN w ELSE 0.0 END) / sum(w) AS x FROM w GROUP BY 1), h AS (SELECT *, 100.0 / (1 + exp(8 * (x - 0.55))) AS b, least(1.0, n / 50.0) AS a FROM s)
SELECT flow, n AS total_commits, round(b * a + b * (1 - a) * 0.8, 6) AS health FROM h""", "files commits commit_files clock")
def ag2(spark, d):
    history, files = B.commits(spark, d), B.files(spark, d)
    own = B.commit_files(spark, d).join(files.select("path", "flow"), "path")
    return A.metrics(files, own, history, B.as_of(history), "flow").select("flow", "total_commits", "health").where("total_commits > 0")


@query("ag3_weighted_health", f"""WITH {ASSIGNED}, sw AS (SELECT sha, feature, max(CASE WHEN length(path) % 3 = 0 THEN 0.5 ELSE 1.0 END) AS sw FROM touched GROUP BY 1, 2),
w AS (SELECT feature, is_bug_fix, sw, sw * CASE WHEN date_sub('day', ts, as_of) < 30 THEN 2.0 ELSE greatest(0.5, 1.0 - (date_sub('day', ts, as_of) - 30) / 365.0) END AS w FROM sw JOIN commits USING (sha), clock),
s AS (SELECT feature, sum(CASE WHEN is_bug_fix THEN w ELSE 0.0 END) / sum(w) AS x, sum(sw) AS n FROM w GROUP BY 1), h AS (SELECT *, greatest(0.0, 100.0 - 200.0 * x) AS b, least(1.0, n / 50.0) AS a FROM s) SELECT feature, round(b * a + b * (1 - a) * 0.8, 6) AS health FROM h""", BASE)
def ag3(spark, d):
    """A file whose path length divides by three counts as half attributed."""
    history = B.commits(spark, d)
    share = F.when(F.length("path") % 3 == 0, 0.5).otherwise(1.0)
    sw = touched(spark, d).groupBy("sha", "feature").agg(F.max(share).alias("sw"))
    w = sw.join(history, "sha").crossJoin(F.broadcast(B.as_of(history))).withColumn("w", F.col("sw") * S.age_weight(S.age_days(F.col("ts"), F.col("as_of"))))
    s = w.groupBy("feature").agg(A.weighted_ratio(F.col("is_bug_fix"), F.col("w")).alias("x"), F.sum("sw").alias("n"))
    return s.select("feature", F.round(S.linear_health(F.col("x"), F.col("n")), 6).alias("health"))


@query("ag6_bus_factor", f"WITH {ASSIGNED}, p AS (SELECT feature, author, count(*) AS c FROM (SELECT DISTINCT sha, feature FROM touched) JOIN commits USING (sha) GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS total FROM p) SELECT feature, greatest(1, count(*) FILTER (c >= greatest(1.0, 0.2 * total))) AS bus_factor FROM t GROUP BY 1", BASE)
def ag6(spark, d):
    return A.bus_factor(touched(spark, d), B.commits(spark, d), "feature")


WEEKLY = "weekly AS (SELECT feature, isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, count(*) AS total, count(*) FILTER (is_bug_fix) AS bug FROM (SELECT DISTINCT sha, feature FROM touched) JOIN commits USING (sha) GROUP BY 1, 2)"


@query("ag7_weekly_timeline", f"WITH {ASSIGNED}, {WEEKLY} SELECT * FROM weekly", BASE)
def ag7(spark, d):
    return A.weekly(touched(spark, d), B.commits(spark, d), "feature")


@query("ag8_health_trend", f"""WITH {ASSIGNED}, {WEEKLY}, p AS (SELECT *, count(*) OVER (PARTITION BY feature) AS n, row_number() OVER (PARTITION BY feature ORDER BY week) AS i FROM weekly)
SELECT feature, CASE WHEN max(n) >= 4 THEN round(coalesce(sum(bug) FILTER (i <= n // 2) / sum(total) FILTER (i <= n // 2), 0.0) - coalesce(sum(bug) FILTER (i > n // 2) / sum(total) FILTER (i > n // 2), 0.0), 3) END AS trend FROM p GROUP BY 1""", BASE)
def ag8(spark, d):
    return A.health_trend(ag7(spark, d), "feature")


@query("ag9_hotspot_files", rf"""WITH {ASSIGNED}, f AS (SELECT feature, path, count(DISTINCT sha) AS commits, count(DISTINCT sha) FILTER (is_bug_fix) / count(DISTINCT sha) AS s FROM touched JOIN commits USING (sha) WHERE NOT regexp_matches('/' || path, '\.(test|spec)\.(ts|tsx|js|jsx|py)$|/__tests__/|/tests?/') GROUP BY 1, 2)
SELECT feature, path, commits, round(s, 6) AS bug_share, row_number() OVER (PARTITION BY feature ORDER BY s DESC, path) AS place FROM f WHERE commits >= 3 AND s > 0.4 QUALIFY place <= 5""", BASE)
def ag9(spark, d):
    return A.hotspots(touched(spark, d), B.commits(spark, d), "feature")


@query("ag11_bug_fix_prs", f"WITH {ASSIGNED}, p AS (SELECT feature, pr_number, sha, left(split_part(message, chr(10), 1), 120) AS title, row_number() OVER (PARTITION BY feature, pr_number ORDER BY ts DESC, sha DESC) AS i FROM (SELECT DISTINCT sha, feature FROM touched) JOIN commits USING (sha) WHERE is_bug_fix AND pr_number IS NOT NULL) SELECT feature, pr_number, sha, title FROM p WHERE i = 1", BASE)
def ag11(spark, d):
    return A.bug_fix_prs(touched(spark, d), B.commits(spark, d), "feature")


@query("ag12_test_files", "SELECT feature, count(DISTINCT path) AS test_files FROM files WHERE path LIKE '%/tests/%' GROUP BY 1", "files")
def ag12(spark, d):
    from ..functions.paths import is_test_path_regex

    return B.files(spark, d).where(is_test_path_regex(F.col("path"))).groupBy("feature").agg(F.countDistinct("path").alias("test_files"))


@query("tk1_features_by_risk", f"WITH {METRICS} SELECT feature, bug_fix_ratio, health, row_number() OVER (ORDER BY bug_fix_ratio DESC, feature) AS place FROM metrics", BASE)
def tk1(spark, d):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy(F.desc("bug_fix_ratio"), "feature"))  # one row for each feature, after all aggregation
    return feature_metrics(spark, d).select("feature", "bug_fix_ratio", "health", place.alias("place"))


@query("tk3_top_hotspots", f"WITH {METRICS} SELECT feature, health, bug_fixes, array_to_string(list_slice(string_split(authors, '|'), 1, 3), '|') AS owners FROM metrics ORDER BY health, feature LIMIT 10", BASE)
def tk3(spark, d):
    return feature_metrics(spark, d).orderBy("health", "feature").limit(10).select("feature", "health", "bug_fixes", F.array_join(F.slice(F.split("authors", r"\|"), 1, 3), "|").alias("owners"))


@query("tk4_risk_zones", f"WITH {METRICS} SELECT feature, bug_fixes, bug_fix_ratio FROM metrics WHERE bug_fixes > 0 ORDER BY bug_fix_ratio DESC, bug_fixes DESC, feature LIMIT 5", BASE)
def tk4(spark, d):
    return feature_metrics(spark, d).where("bug_fixes > 0").orderBy(F.desc("bug_fix_ratio"), F.desc("bug_fixes"), "feature").limit(5).select("feature", "bug_fixes", "bug_fix_ratio")


@query("ag16_repo_summary", f"WITH {METRICS} SELECT count(*) AS features, sum(total_commits)::BIGINT AS commits, round(avg(health), 4) AS mean_health, count(*) FILTER (health < 77) AS at_risk FROM metrics", BASE)
def ag16(spark, d):
    return feature_metrics(spark, d).agg(F.count(F.lit(1)).alias("features"), F.sum("total_commits").alias("commits"), F.round(F.avg("health"), 4).alias("mean_health"), F.count_if(F.col("health") < 77).alias("at_risk"))


@query("ag30_owners", f"WITH {ASSIGNED}, p AS (SELECT feature, author, count(*) AS c FROM (SELECT DISTINCT sha, feature FROM touched) JOIN commits USING (sha) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY c DESC, author) AS i, count(*) OVER (PARTITION BY feature) AS authors FROM p) SELECT feature, least(authors, 5) AS bus, author AS lead, c AS commits FROM r WHERE i = 1", BASE)
def ag30(spark, d):
    per = touched(spark, d).select("sha", "feature").distinct().join(B.commits(spark, d).select("sha", "author"), "sha").groupBy("feature", "author").count()
    return per.groupBy("feature").agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("bus"), F.min_by("author", F.struct(-F.col("count"), "author")).alias("lead"), F.max("count").alias("commits"))


@query("report_two_level", "SELECT feature, flow, count(DISTINCT sha) AS commits FROM commit_files JOIN files USING (path) GROUP BY GROUPING SETS ((feature), (feature, flow))", "files commit_files")
def two_level(spark, d):
    own = B.commit_files(spark, d).join(B.files(spark, d).select("path", "feature", "flow"), "path")
    return own.groupingSets([["feature"], ["feature", "flow"]], "feature", "flow").agg(F.countDistinct("sha").alias("commits"))


@query("rp3_merge_small", """WITH ff AS (SELECT CASE WHEN part % 50 = 1 THEN feature || '-x' || part ELSE feature END AS feature, path FROM files), s AS (SELECT feature, count(*) AS n FROM ff GROUP BY 1),
d AS (SELECT DISTINCT feature, depth, array_to_string(list_slice(string_split(path, '/'), 1, depth), '/') AS dir FROM ff, unnest(range(1, len(string_split(path, '/')))) t(depth))
SELECT a.feature, max_by(b.feature, (b.depth, z.n, -length(b.feature), b.feature)) AS target FROM d a JOIN s ON s.feature = a.feature AND s.n < 3 JOIN d b ON b.dir = a.dir JOIN s z ON z.feature = b.feature AND z.n >= 3 GROUP BY 1""", "files")
def rp3(spark, d):
    name = F.when(F.col("part") % 50 == 1, F.concat("feature", F.lit("-x"), F.col("part").cast("string"))).otherwise(F.col("feature"))
    return A.merge_small(B.files(spark, d).select(name.alias("feature"), "path"))


@query("rp4_noise_drop", f"""WITH {METRICS}, sizes AS (SELECT feature, count(*) AS files FROM feature_files GROUP BY 1) SELECT CASE WHEN files < 35 AND total_commits < 2400 THEN 'shared-infra' ELSE feature END AS feature, sum(files)::BIGINT AS files, count(*) AS folded FROM metrics JOIN sizes USING (feature) GROUP BY 1""", BASE)
def rp4(spark, d):
    """Small and cold features fold into shared-infra; limits that fit these tables."""
    sizes = B.feature_files(spark, d).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))
    name = F.when((F.col("files") < 35) & (F.col("total_commits") < 2400), "shared-infra").otherwise(F.col("feature"))
    return feature_metrics(spark, d).join(sizes, "feature").groupBy(name.alias("feature")).agg(F.sum("files").alias("files"), F.count(F.lit(1)).alias("folded"))
