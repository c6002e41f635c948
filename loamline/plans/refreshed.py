"""Maps brought up to date: new files, new commits, partial scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import refresh as R
from ..sources import bridge as B
from .registry import query


@query("jn2_new_files", "SELECT CASE part % 4 WHEN 0 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) || '/new' || part || '.ts' WHEN 1 THEN 'zz/' || feature || 'Page' || '.v' || part || '.ts' WHEN 2 THEN 'lib/' || feature || '_service/x' || part || '/y.ts' ELSE 'zz/unknown' || part || '.ts' END AS path, CASE WHEN part % 4 < 3 THEN feature END AS feature, CASE part % 4 WHEN 0 THEN 'ancestor' WHEN 1 THEN 'stem' WHEN 2 THEN 'directory' END AS how FROM files", "files")
def jn2_new(spark, d):
    """New files beside others, with a feature's name, in a directory of such a name, and of no feature."""
    k, part = F.col("part") % 4, F.col("part").cast("string")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    path = F.when(k == 0, F.concat(folder, F.lit("/new"), part, F.lit(".ts"))).when(k == 1, F.concat(F.lit("zz/"), "feature", F.lit("Page.v"), part, F.lit(".ts"))).when(k == 2, F.concat(F.lit("lib/"), "feature", F.lit("_service/x"), part, F.lit("/y.ts"))).otherwise(F.concat(F.lit("zz/unknown"), part, F.lit(".ts")))
    return R.new_owner(B.files(spark, d).select(path.alias("path")), B.files(spark, d).select("feature", "path"))


STATE = """mp AS (SELECT feature, count(*) AS total_commits, count(*) FILTER (part % 3 = 0) AS bug_fixes, TIMESTAMP '1996-01-01 00:00:00' AS last_modified FROM feature_files GROUP BY 1),
tn AS (SELECT DISTINCT sha, feature FROM commit_files JOIN files USING (path) WHERE sha % 3 = 0 AND feature NOT LIKE 'brand2%'),
cl AS (SELECT max(ts) AS as_of FROM commits),
nw AS (SELECT feature, count(*) AS n, count(*) FILTER (is_bug_fix) AS bugs, list(DISTINCT author) AS more, max(ts) AS newest, sum(CASE WHEN is_bug_fix THEN w ELSE 0.0 END) / sum(w) AS x FROM (SELECT *, CASE WHEN date_sub('day', ts, as_of) < 30 THEN 2.0 ELSE greatest(0.5, 1.0 - (date_sub('day', ts, as_of) - 30) / 365.0) END AS w FROM tn JOIN commits USING (sha), cl) GROUP BY 1),
up AS (SELECT feature, total_commits + coalesce(n, 0) AS total_commits, bug_fixes + coalesce(bugs, 0) AS bug_fixes, array_to_string(list_sort(list_distinct(list_concat(['OLD'], coalesce(more, [])))), '|') AS authors, greatest(last_modified, coalesce(newest, last_modified)) AS last_modified, x, n FROM mp LEFT JOIN nw USING (feature))"""


def state(spark, d):
    """A map made of the files, with counters from their numbers."""
    f = B.feature_files(spark, d)
    features = f.groupBy("feature").agg(F.count(F.lit(1)).alias("total_commits"), F.count_if(F.col("part") % 3 == 0).alias("bug_fixes")).withColumns({"authors": F.array(F.lit("OLD")), "last_modified": F.lit("1996-01-01").cast("timestamp_ntz"), "health": F.lit(50.0)})
    prs = f.where("part % 5 = 0").select("feature", (F.col("part") % 100).cast("int").alias("pr_number"), F.lit(-1).cast("long").alias("sha"), F.lit("1996-01-01").cast("timestamp_ntz").alias("ts")).distinct()
    return R.FeatureMap(features, f.select("feature", "path"), prs)


def refreshed(spark, d):
    """The map after the commits of every third order; nothing touches the features of brand2x."""
    own = B.commit_files(spark, d).join(B.files(spark, d).where("feature not like 'brand2%'").select("path"), "path").where("sha % 3 = 0")
    return R.updated(state(spark, d), own, B.commits(spark, d), B.as_of(B.commits(spark, d)))


@query("st5_updated_features", f"WITH {STATE} SELECT feature, total_commits, bug_fixes, authors, last_modified, CASE WHEN n IS NULL THEN 50.0 ELSE round(100.0 / (1 + exp(8 * (x - 0.55))) * (least(1.0, total_commits / 50.0) + (1 - least(1.0, total_commits / 50.0)) * 0.8), 6) END AS health FROM up", "feature_files commits commit_files")
def st5_features(spark, d):
    return refreshed(spark, d).features.withColumns({"authors": F.array_join("authors", "|"), "health": F.round("health", 6)})


@query("st5_updated_files", "SELECT feature, count(*) AS files FROM (SELECT feature, path FROM feature_files UNION SELECT feature, path FROM commit_files JOIN files USING (path) WHERE sha % 3 = 0 AND feature NOT LIKE 'brand2%') GROUP BY 1", "feature_files commit_files")
def st5_files(spark, d):
    """Files that commits bring along join the feature around them."""
    return refreshed(spark, d).files.groupBy("feature").agg(F.count(F.lit(1)).alias("files"))


@query("st5_updated_pull_requests", f"WITH {STATE}, pr AS (SELECT DISTINCT feature, CAST(part % 100 AS INTEGER) AS pr_number, CAST(-1 AS BIGINT) AS sha, TIMESTAMP '1996-01-01 00:00:00' AS ts FROM feature_files WHERE part % 5 = 0 UNION ALL SELECT feature, pr_number, sha, ts FROM tn JOIN commits USING (sha) WHERE is_bug_fix AND pr_number IS NOT NULL) SELECT feature, pr_number, max_by(sha, (ts, sha)) AS sha FROM pr GROUP BY 1, 2", "feature_files commits commit_files")
def st5_prs(spark, d):
    return refreshed(spark, d).pull_requests.select("feature", "pr_number", "sha")


DIFF = "df AS (SELECT path, 'modified' AS status FROM files WHERE part % 29 = 0 AND feature LIKE 'brand1%' UNION ALL SELECT path, 'removed' FROM files WHERE part % 31 = 1 UNION ALL SELECT 'new/' || path, 'added' FROM files WHERE part % 37 = 2), prior AS (SELECT flow AS feature, path FROM files), stale AS (SELECT DISTINCT feature FROM prior SEMI JOIN df USING (path))"


def diff(spark, d):
    f = B.files(spark, d)
    row = lambda rows, path, status: rows.select(path.alias("path"), F.lit(status).alias("status"))
    return row(f.where("part % 29 = 0 and feature like 'brand1%'"), F.col("path"), "modified").unionByName(row(f.where("part % 31 = 1"), F.col("path"), "removed")).unionByName(row(f.where("part % 37 = 2"), F.concat(F.lit("new/"), "path"), "added"))


def by_folder(todo):
    """A scan that names features by flow and marks them as scanned: files of tests form features of their own."""
    part = F.split("path", "/")
    at = F.when(F.col("path").startswith("new/"), 2).otherwise(1)
    name = F.concat(F.get(part, at), F.lit("-"), F.get(part, at + 1), F.when(F.col("path").contains("/tests/"), "-tests").otherwise(""))
    return todo.select(name.alias("feature"), "path")


@query("st8_executed", f"WITH {DIFF}, todo AS (SELECT path FROM prior SEMI JOIN stale USING (feature) WHERE path NOT IN (SELECT path FROM df WHERE status = 'removed') UNION SELECT path FROM df WHERE status = 'added'), fresh AS (SELECT CASE WHEN path LIKE 'new/%' THEN split_part(path, '/', 3) || '-' || split_part(path, '/', 4) ELSE split_part(path, '/', 2) || '-' || split_part(path, '/', 3) END || CASE WHEN path LIKE '%/tests/%' THEN '-tests' ELSE '' END AS feature, path FROM todo), kept AS (SELECT feature, path FROM prior ANTI JOIN stale USING (feature) WHERE feature NOT IN (SELECT feature FROM fresh) AND path NOT IN (SELECT path FROM fresh) AND path NOT IN (SELECT path FROM df WHERE status = 'removed')) SELECT feature, count(*) AS files, min(path) AS first FROM (SELECT * FROM fresh UNION ALL SELECT * FROM kept) GROUP BY 1", "files")
def st8_executed(spark, d):
    prior = B.files(spark, d).select(F.col("flow").alias("feature"), "path")
    return R.executed(prior, diff(spark, d), by_folder).groupBy("feature").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"))


@query("st8_executed_packages", "WITH prior AS (SELECT CASE WHEN part % 7 = 0 THEN 'mixed' || part % 3 ELSE flow END AS feature, path FROM files), df AS (SELECT path, 'modified' AS status FROM files WHERE feature IN ('brand12', 'brand34') UNION ALL SELECT path, 'removed' FROM files WHERE feature = 'brand12' AND part % 5 = 0), fresh AS (SELECT split_part(path, '/', 2) || '-' || split_part(path, '/', 3) || CASE WHEN path LIKE '%/tests/%' THEN '-tests' ELSE '' END AS feature, path FROM files WHERE feature IN ('brand12', 'brand34')), n AS (SELECT p.feature, f.feature AS package, count(*) AS n FROM prior p JOIN files f USING (path) WHERE f.feature NOT IN ('brand12', 'brand34') GROUP BY 1, 2), z AS (SELECT feature, count(*) AS size FROM prior GROUP BY 1), kept AS (SELECT * FROM prior WHERE feature IN (SELECT n.feature FROM n JOIN z ON z.feature = n.feature WHERE n.n >= size // 2 + 1) AND feature NOT IN (SELECT feature FROM fresh)) SELECT feature, count(*) AS files FROM (SELECT * FROM fresh UNION ALL SELECT * FROM kept) GROUP BY 1", "files")
def st8_packages(spark, d):
    """Two packages changed; features whose files are spread over packages are not carried."""
    f = B.files(spark, d)
    prior = f.select(F.when(F.col("part") % 7 == 0, F.concat(F.lit("mixed"), (F.col("part") % 3).cast("string"))).otherwise(F.col("flow")).alias("feature"), "path")
    changed = f.where("feature in ('brand12', 'brand34')").select("path", F.lit("modified").alias("status")).unionByName(f.where("feature = 'brand12' and part % 5 = 0").select("path", F.lit("removed").alias("status")))
    return R.executed_packages(prior, changed, f.select(F.col("feature").alias("package"), "path"), by_folder).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))
