"""Merges of clusters judged and undone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merges as M
from ..sources import bridge as B
from .registry import query

DIR = "regexp_extract({}, '^(.*)/[^/]*$', 1)"


def near(orphans: str, features: str) -> str:
    """Relation `to` (name, target) from two relations."""
    return f"""sd AS (SELECT name, feature, count(*) AS n FROM (SELECT DISTINCT name, {DIR.format('path')} AS dir FROM {orphans}) JOIN (SELECT DISTINCT feature, {DIR.format('path')} AS dir FROM {features}) USING (dir) GROUP BY 1, 2), nr AS (SELECT name, min_by(feature, (-n, feature)) AS target FROM sd GROUP BY 1),
zs AS (SELECT feature, count(*) AS n FROM {features} GROUP BY 1), rs AS (SELECT name, min_by(feature, (-n, feature)) AS target FROM (SELECT DISTINCT name, split_part(path, '/', 1) AS top FROM {orphans} WHERE name NOT IN (SELECT name FROM nr)) JOIN (SELECT DISTINCT feature, split_part(path, '/', 1) AS top FROM {features}) USING (top) JOIN zs USING (feature) GROUP BY 1), to_ AS (SELECT * FROM nr UNION ALL SELECT * FROM rs)"""


CLUSTERS = "cl AS (SELECT CASE WHEN part % 10 = 0 THEN 'tiny' || part % 400 ELSE flow END AS feature, CASE WHEN part % 30 = 0 THEN 'shop/a' || part || '.ts' WHEN part % 20 = 0 THEN 'utils/b' || part || '.ts' ELSE path END AS path FROM files)"


@query("rp15_pre_merged", f"WITH {CLUSTERS}, z AS (SELECT feature, count(*) AS n, count(DISTINCT split_part(path, '/', 1)) AS tops, min(split_part(path, '/', 1)) AS top FROM cl GROUP BY 1), tn AS (SELECT cl.feature AS name, path FROM cl JOIN z USING (feature) WHERE n <= 3 AND NOT (tops = 1 AND top NOT IN ('utils'))), lg AS (SELECT cl.* FROM cl JOIN z USING (feature) WHERE n > 3), {near('tn', 'lg')} SELECT coalesce(target, feature) AS feature, count(*) AS files FROM cl LEFT JOIN to_ ON name = feature WHERE (SELECT count(*) FROM z) > 20 GROUP BY 1 UNION ALL SELECT feature, count(*) FROM cl WHERE (SELECT count(*) FROM z) <= 20 GROUP BY 1", "files")
def pre_merged(spark, d):
    """Clusters of up to three files, some in a directory of their own, some in a technical one, some over several."""
    part = F.col("part")
    name = F.when(part % 10 == 0, F.concat(F.lit("tiny"), (part % 400).cast("string"))).otherwise(F.col("flow"))
    path = F.when(part % 30 == 0, F.concat(F.lit("shop/a"), part.cast("string"), F.lit(".ts"))).when(part % 20 == 0, F.concat(F.lit("utils/b"), part.cast("string"), F.lit(".ts"))).otherwise(F.col("path"))
    return M.pre_merged(B.files(spark, d).select(name.alias("feature"), path.alias("path")), gate=20).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))


NAMED = "tf AS (SELECT CASE part % 12 WHEN 0 THEN 'hooks-utils' WHEN 1 THEN 'shared_core' WHEN 2 THEN 'assets-logo' WHEN 3 THEN 'state-orders' WHEN 4 THEN 'ui' ELSE feature END AS feature, CASE part % 12 WHEN 1 THEN 'far/' || part || '.ts' WHEN 4 THEN CASE WHEN part % 24 = 4 THEN 'lone/' || part || '.ts' ELSE 'odd/' || part || '.ts' END WHEN 5 THEN CASE WHEN part % 5 = 0 THEN 'odd/' || part || '.ts' ELSE path END ELSE path END AS path FROM files), te AS (SELECT feature AS name, path FROM tf WHERE feature IN ('hooks-utils', 'shared_core', 'assets-logo', 'ui')), bu AS (SELECT * FROM tf WHERE feature NOT IN ('hooks-utils', 'shared_core', 'assets-logo', 'ui'))"


@query("rp15_without_technical", f"WITH {NAMED}, {near('te', 'bu')} SELECT coalesce(target, tf.feature) AS feature, count(*) AS files FROM tf LEFT JOIN to_ ON name = tf.feature GROUP BY 1", "files")
def without_technical(spark, d):
    """Technical features near to others by directory, by top directory, and to none."""
    part, k = F.col("part"), F.col("part") % 12
    name = F.when(k == 0, "hooks-utils").when(k == 1, "shared_core").when(k == 2, "assets-logo").when(k == 3, "state-orders").when(k == 4, "ui").otherwise(F.col("feature"))
    at = lambda folder: F.concat(F.lit(folder), part.cast("string"), F.lit(".ts"))
    path = F.when(k == 1, at("far/")).when((k == 4) & (part % 24 == 4), at("lone/")).when((k == 4) | (k == 5) & (part % 5 == 0), at("odd/")).otherwise(F.col("path"))
    return M.without_technical(B.files(spark, d).select(name.alias("feature"), path.alias("path"))).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))


@query("rp15_coherent_merges", "WITH me AS (SELECT CASE WHEN feature LIKE 'brand1%' THEN 'wide' WHEN feature LIKE 'brand2%' THEN 'narrow' ELSE feature END AS feature, feature AS cluster, CASE WHEN feature LIKE 'brand1%' THEN 'src/d' || part || '/x.ts' ELSE path END AS path FROM files) SELECT CASE WHEN feature = 'wide' AND (SELECT count(DISTINCT cluster) >= 3 AND count(*) > 15 FROM me WHERE feature = 'wide') THEN cluster ELSE feature END AS feature, count(*) AS files FROM me GROUP BY 1", "files")
def coherent(spark, d):
    """One merge over as many directories as files, one over few."""
    f = B.files(spark, d)
    wide = F.col("feature").startswith("brand1")
    name = F.when(wide, "wide").when(F.col("feature").startswith("brand2"), "narrow").otherwise(F.col("feature"))
    path = F.when(wide, F.concat(F.lit("src/d"), F.col("part").cast("string"), F.lit("/x.ts"))).otherwise(F.col("path"))
    return M.coherent(f.select(name.alias("feature"), F.col("feature").alias("cluster"), path.alias("path"))).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))


@query("rp15_to_split", f"WITH x AS (SELECT CASE WHEN part % 3 = 0 THEN feature ELSE flow END AS feature, CASE WHEN part % 3 = 1 THEN 'one/' || part || '.ts' ELSE path END AS path FROM files), n AS (SELECT feature, {DIR.format('path')} AS dir, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT feature, sum(n)::BIGINT AS files, max(n) AS m FROM n GROUP BY 1) SELECT feature, files, CASE WHEN files > 12 THEN 'size' ELSE 'concentration' END AS reason FROM s WHERE files > 12 OR files >= 5 AND m >= 0.7 * files", "files")
def to_split(spark, d):
    """Limits that fit these tables."""
    k = F.col("part") % 3
    f = B.files(spark, d).select(F.when(k == 0, F.col("feature")).otherwise(F.col("flow")).alias("feature"), F.when(k == 1, F.concat(F.lit("one/"), F.col("part").cast("string"), F.lit(".ts"))).otherwise(F.col("path")).alias("path"))
    return M.to_split(f, most=12, least=5)
