"""Clean-up of feature maps, second looks at owners, whole import and co-change clusters, and the bounded queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import cleanup as U
from ..operators import graph as G
from ..sources import bridge as B
from .registry import query
from .structure import FILE_PAIRS, file_pairs

KIND = "substr(flow, length(feature) + 2)"
LAST_DIR = f"CASE WHEN contains(path, '/tests/') THEN 'tests' ELSE {KIND} END"
COUNTED = "SELECT feature, count(*) AS files FROM o GROUP BY 1"
TINY = """z AS (SELECT feature, count(*) AS size FROM {m} GROUP BY 1), a AS (SELECT list_sort(list(size)) AS l FROM z WHERE feature <> 'shared-infra'), b AS (SELECT greatest(2, l[len(l) // 2 + 1] // 10) AS bound FROM a WHERE len(l) >= 5),
t AS (SELECT feature FROM z, b WHERE size <= bound AND feature <> 'shared-infra'), w AS (SELECT DISTINCT feature, unnest(string_split_regex(feature, '[-_]')) AS w FROM z), k AS (SELECT t.feature, y.feature AS known, count(*) * 10 + least(any_value(z.size), 50) AS score FROM t JOIN w x ON x.feature = t.feature JOIN w y ON y.w = x.w JOIN z ON z.feature = y.feature WHERE y.feature NOT IN (SELECT feature FROM t) AND y.feature <> 'shared-infra' GROUP BY 1, 2),
g AS (SELECT feature, min_by(known, (-score, known)) AS known FROM k GROUP BY 1), o AS (SELECT CASE WHEN m.feature NOT IN (SELECT feature FROM t) THEN m.feature ELSE coalesce(known, 'shared-infra') END AS feature, path FROM {m} m LEFT JOIN g USING (feature))"""


def mapped(spark, d, feature: str, path: str = "path"):
    """Files under features (and paths) that an expression gives them."""
    return B.files(spark, d).select(F.expr(feature).alias("feature"), F.expr(path).alias("path"))


def counted(files):
    return files.groupBy("feature").agg(F.count(F.lit(1)).alias("files"))


@query("rp15_layers", f"WITH o AS (SELECT CASE WHEN part % 7 < 3 THEN 'shared-infra' ELSE feature END AS feature FROM files) {COUNTED}", "files")
def rp15_layers(spark, d):
    return counted(U.folded_tooling(U.folded_layers(mapped(spark, d, "case part % 7 when 0 then 'Prisma' when 1 then '.husky' when 2 then 'packages/ESLint-config' else feature end"))))


@query("rp15_numbers", f"WITH x AS (SELECT DISTINCT feature FROM files WHERE part % 3 = 2), o AS (SELECT CASE WHEN part % 3 = 2 THEN 'x-tests-' || feature WHEN part % 3 = 1 THEN flow WHEN contains(path, '/tests/') THEN CASE WHEN feature IN (SELECT feature FROM x) THEN 'x-tests-' || feature ELSE feature || '-tests' END ELSE flow END AS feature FROM files) {COUNTED}", "files")
def rp15_numbers(spark, d):
    return counted(U.named_without_numbers(mapped(spark, d, "case part % 3 when 0 then concat(feature, '-', part % 5) when 1 then flow else concat('x-tests-', feature) end")))


@query("rp15_siblings", f"WITH m AS (SELECT CASE WHEN part % 2 = 0 THEN '' ELSE 'app-' END || feature AS p, CASE WHEN part % 2 = 0 THEN '' ELSE 'app-' END || flow AS name FROM files), n AS (SELECT p, count(DISTINCT name) AS n FROM m GROUP BY 1), o AS (SELECT CASE WHEN n > 1 THEN p ELSE name END AS feature FROM m JOIN n USING (p)) {COUNTED}", "files")
def rp15_siblings(spark, d):
    return counted(U.merged_siblings(mapped(spark, d, "concat(if(part % 2 = 0, '', 'app-'), flow)")))


@query("rp15_directories", f"WITH m AS (SELECT CASE part % 4 WHEN 0 THEN CASE WHEN length(feature) = 6 THEN 'q' ELSE '' END || feature WHEN 1 THEN 'team-' || feature WHEN 2 THEN 'mix' || part % 8 ELSE 'z' || feature END AS feature, feature AS dir FROM files), n AS (SELECT feature, dir, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS size, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, dir) AS i FROM m GROUP BY 1, 2), t AS (SELECT * FROM n WHERE i = 1 AND 2 * n >= size), b AS (SELECT dir, min_by(feature, (feature <> dir, -size, feature)) AS best FROM t GROUP BY 1 HAVING count(*) > 1), g AS (SELECT feature, best FROM t JOIN b USING (dir)), o AS (SELECT coalesce(best, feature) AS feature FROM m LEFT JOIN g USING (feature)) {COUNTED}", "files")
def rp15_directories(spark, d):
    return counted(U.merged_by_directory(mapped(spark, d, "case part % 4 when 0 then concat(if(length(feature) = 6, 'q', ''), feature) when 1 then concat('team-', feature) when 2 then concat('mix', part % 8) else concat('z', feature) end")))


@query("rp15_tiny", f"WITH m AS (SELECT CASE WHEN part % 10 = 0 THEN feature || '_bit' || part WHEN part % 11 = 0 THEN 'lone' || part ELSE feature END AS feature, path FROM files), {TINY.format(m='m')} {COUNTED}", "files")
def rp15_tiny(spark, d):
    return counted(U.absorbed_tiny(mapped(spark, d, "case when part % 10 = 0 then concat(feature, '_bit', part) when part % 11 = 0 then concat('lone', part) else feature end")))


@query("rp15_infra", f"WITH o AS (SELECT CASE WHEN feature = 'brand1' THEN 'shared-infra' ELSE feature END AS feature FROM files) {COUNTED}", "files")
def rp15_infra(spark, d):
    return counted(U.folded_infra(mapped(spark, d, "feature", "case when feature = 'brand1' or feature = 'brand2' and part % 2 = 0 then concat('src/hooks/Lib/', part, '.ts') else path end")))


@query("rp15_plugins", f"WITH o AS (SELECT CASE part % 5 WHEN 0 THEN 'integrations' WHEN 1 THEN 'billing' ELSE feature END AS feature FROM files) {COUNTED}", "files")
def rp15_plugins(spark, d):
    return counted(U.collapsed_plugins(mapped(spark, d, "case part % 5 when 0 then concat('plug', part) when 1 then concat('view', part) else feature end", "case part % 5 when 0 then concat('packages/app-store/p', part, '/index.ts') when 1 then concat('src/billing/v', part, '/index.ts') else path end")))


@query("rp15_shared_ui", f"WITH o AS (SELECT CASE WHEN part % 6 IN (0, 2) THEN 'shared-ui' ELSE feature END AS feature FROM files) {COUNTED}", "files")
def rp15_ui(spark, d):
    return counted(U.extracted_ui(mapped(spark, d, "feature", "case part % 6 when 0 then concat('src/components/ui/', part) when 1 then concat('src/views/NDR/components/ui/', part) when 2 then concat('lib/ui/hooks/', part) else path end")))


@query("rp15_final", f"WITH s AS (SELECT CASE WHEN part % 9 = 0 THEN 'shared-infra' WHEN part % 9 = 1 THEN feature || '-' || {LAST_DIR} ELSE flow END AS name, feature AS p, path FROM files), n AS (SELECT p, count(DISTINCT name) AS n FROM s WHERE name <> 'shared-infra' GROUP BY 1), m AS (SELECT CASE WHEN name <> 'shared-infra' AND n > 1 THEN p ELSE name END AS feature, path FROM s LEFT JOIN n USING (p)), {TINY.format(m='m')} {COUNTED}", "files")
def rp15_final(spark, d):
    return counted(U.final_clean_up(mapped(spark, d, "case when part % 9 = 0 then 'prisma' when part % 9 = 1 then concat(feature, '-2') else flow end")))


VARIANT = "CASE part % 3 WHEN 0 THEN 'web/' || feature WHEN 1 THEN feature ELSE 'Api/' || upper(feature) END"
PLACE = "CASE part % 3 WHEN 0 THEN 'web/' WHEN 1 THEN '' ELSE 'api/' END || path"


@query("rp8_same_names", f"WITH m AS (SELECT {VARIANT} AS feature, feature AS name, {PLACE} AS path FROM files UNION ALL SELECT feature, feature, 'web/' || path FROM files WHERE part % 3 = 0 AND feature LIKE 'brand1%'), z AS (SELECT name, feature, count(*) AS size FROM m GROUP BY 1, 2), c AS (SELECT name, count(*) AS n, min_by(feature, (-size, feature)) AS best FROM z GROUP BY 1), x AS (SELECT DISTINCT name FROM (SELECT name, path FROM m GROUP BY 1, 2 HAVING count(DISTINCT feature) > 1)), o AS (SELECT DISTINCT CASE WHEN n = 1 THEN feature WHEN name IN (SELECT name FROM x) THEN best ELSE name || '-' || split_part(path, '/', 1) END AS feature, path FROM m JOIN c USING (name)) {COUNTED}", "files")
def rp8_same(spark, d):
    own = B.files(spark, d)
    m = own.select(F.expr("case part % 3 when 0 then concat('web/', feature) when 1 then feature else concat('Api/', upper(feature)) end").alias("feature"), F.expr("concat(case part % 3 when 0 then 'web/' when 1 then '' else 'api/' end, path)").alias("path"))
    twice = own.where("part % 3 = 0 and feature like 'brand1%'").select("feature", F.concat(F.lit("web/"), "path").alias("path"))
    return counted(U.same_names(m.unionByName(twice)))


@query("rp10_second_look", "WITH w AS (SELECT flow, CASE WHEN ends_with(flow, 'promo') THEN 'ui' WHEN ends_with(flow, 'small') THEN 'brand1' ELSE feature END AS owner, path, CASE WHEN part % 5 = 0 THEN 'auth' WHEN part % 7 = 0 THEN 'ui' WHEN part % 3 = 0 THEN 'brand1' ELSE feature END AS f FROM files), s AS (SELECT flow, owner, count(*) AS paths FROM w GROUP BY 1, 2 HAVING count(*) > 1), n AS (SELECT flow, owner, f, count(*) AS n FROM w GROUP BY 1, 2, 3), b AS (SELECT flow, owner, coalesce(max(n) FILTER (f = owner), 0) AS mine, max(n) FILTER (f <> owner) AS most, min_by(f, (-n, f)) FILTER (f <> owner) AS other FROM n GROUP BY 1, 2), r AS (SELECT flow, owner, other, mine / paths AS own_share, most / paths AS other_share FROM s JOIN b USING (flow, owner) WHERE other IS NOT NULL) SELECT flow, owner, other, round(own_share, 6) AS own_share, round(other_share, 6) AS other_share FROM r WHERE other_share - own_share >= CASE WHEN owner = 'ui' AND other = 'auth' AND other_share >= 0.05 THEN 0.15 ELSE 0.30 END", "files")
def rp10_second(spark, d):
    own = B.files(spark, d)
    flows = own.select("flow", F.expr("case when flow like '%promo' then 'ui' when flow like '%small' then 'brand1' else feature end").alias("owner"), "path")
    features = mapped(spark, d, "case when part % 5 = 0 then 'auth' when part % 7 = 0 then 'ui' when part % 3 = 0 then 'brand1' else feature end")
    return U.second_look(flows, features).withColumn("own_share", F.round("own_share", 6)).withColumn("other_share", F.round("other_share", 6))


CLOSED = "r(node, root) AS (SELECT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)"


@query("gr2_import_groups", f"WITH fan AS (SELECT dst, count(*) AS f FROM edges GROUP BY 1), d AS (SELECT path, split_part(path, '/', 3) AS domain FROM files), kept AS (SELECT src, dst FROM edges JOIN fan USING (dst) JOIN d a ON a.path = src JOIN d b ON b.path = dst WHERE a.domain = b.domain AND f <= (SELECT greatest(8, count(*) // 30) FROM files)), e AS (SELECT src AS u, dst AS v FROM kept UNION SELECT dst, src FROM kept), {CLOSED}, g AS (SELECT path, coalesce(root, path) AS root FROM files LEFT JOIN c ON node = path), z AS (SELECT root, count(*) AS n FROM g GROUP BY 1) SELECT path, CASE WHEN n > (SELECT least(300, greatest(20, count(*) // 4)) FROM files) THEN regexp_extract(path, '^src/(.*)/[^/]*$', 1) ELSE root END AS root FROM g JOIN z USING (root)", "edges", recursive=True)
def gr2_groups(spark, d):
    own = B.files(spark, d).select("path", F.split("path", "/")[2].alias("domain"))
    return U.import_groups(G.import_clusters(B.edges(spark, d), own), own)


@query("gr3_finalised", f"WITH {FILE_PAIRS}, e AS (SELECT f1 AS u, f2 AS v FROM pairs WHERE n >= 3 UNION SELECT f2, f1 FROM pairs WHERE n >= 3), {CLOSED}, g AS (SELECT path, coalesce(root, path) AS root, split_part(path, '/', 2) AS segment, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files LEFT JOIN c ON node = path), s AS (SELECT root, segment, count(*) AS m, sum(count(*)) OVER (PARTITION BY root) AS size FROM g GROUP BY 1, 2), q AS (SELECT root, min_by(segment, (-m, segment)) AS modal FROM s WHERE size > 1 GROUP BY 1), i AS (SELECT root, modal, row_number() OVER (PARTITION BY modal ORDER BY root) AS i FROM q), nm AS (SELECT root, modal || CASE WHEN i > 1 THEN '-' || i ELSE '' END AS name FROM i), many AS (SELECT name, path, dir FROM g JOIN nm USING (root)), near AS (SELECT dir, max(name) AS near FROM many GROUP BY 1), used AS (SELECT modal AS segment, count(*) AS used FROM i GROUP BY 1) SELECT name, path FROM many UNION ALL SELECT coalesce(near, segment || CASE WHEN used IS NULL THEN '' ELSE '-' || (used + 1) END), path FROM g LEFT JOIN near USING (dir) LEFT JOIN used USING (segment) WHERE root NOT IN (SELECT root FROM nm)", "files commit_files", recursive=True)
def gr3_finalised(spark, d):
    c = G.components(file_pairs(spark, d).where("n >= 3"))
    groups = B.files(spark, d).select("path").join(c.select(F.col("node").alias("path"), "root"), "path", "left").select("path", F.coalesce("root", "path").alias("root"))
    return U.finalised(groups, P.first_segment(F.col("path")))


@query("st4_bounded_queue", "WITH e AS (SELECT date_trunc('day', ts) AS flush, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) - 1 AS i FROM events) SELECT flush, i // 20 AS batch, count(*) AS n FROM e WHERE i < 250 GROUP BY 1, 2")
def st4_queue(spark, d):
    e = B.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return U.queued(e, every="1 day", most=250, batch=20).groupBy("flush", "batch").agg(F.count(F.lit(1)).alias("n"))


RULES = {
    "force_merges": [{"into": "brand1", "from": ["brand2", "brand3"]}],
    "features": {"brand4": {"variants": ["brand5"]}, "accounts-brand6": {}, "brand7/promo-codes": {}, "top": {}},
    "auto_aliases": {"brand8": {"variants": ["brand9"]}},
    "skip_features": ["brand10"],
}


@query("rp6_configured", f"WITH o AS (SELECT CASE WHEN feature IN ('brand2', 'brand3') THEN 'brand1' WHEN feature = 'brand5' THEN 'brand4' WHEN feature = 'brand6' THEN 'accounts-brand6' WHEN feature = 'brand7' AND {KIND} = 'promo' THEN 'brand7/promo-codes' WHEN feature = 'brand7' THEN 'brand7/' || {KIND} WHEN feature = 'brand9' THEN 'brand8' WHEN feature = 'brand11' THEN 'top' ELSE feature END AS feature FROM files WHERE feature <> 'brand10') {COUNTED}", "files")
def rp6_configured(spark, d):
    from ..sources import config as C

    rules = C.rules(spark, RULES)
    m = mapped(spark, d, "case feature when 'brand7' then concat('brand7/', substr(flow, 8)) when 'brand11' then concat('top/', substr(flow, 9)) else feature end")
    return counted(U.configured(m, rules["renames"], rules["features"]))


@query("rp11_clean_flows", f"WITH g AS (SELECT feature, CASE WHEN part % 4 = 0 THEN 'delete-all' ELSE {KIND} END || '-flow' AS flow, path, {LAST_DIR} AS domain FROM files WHERE part % 4 <> 1), x AS (SELECT feature, flow FROM g WHERE flow LIKE 'delete-%' GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT domain) > 2), l AS (SELECT * FROM g ANTI JOIN x USING (feature, flow)), s AS (SELECT feature, count(*) AS size FROM files GROUP BY 1), n AS (SELECT flow, feature, count(*) AS overlap FROM l GROUP BY 1, 2), w AS (SELECT flow, min_by(feature, (-overlap, size, feature)) AS feature FROM n JOIN s USING (feature) GROUP BY 1) SELECT feature, flow, count(*) AS files FROM l JOIN w USING (feature, flow) GROUP BY 1, 2", "files")
def rp11_clean(spark, d):
    kind = "substr(flow, length(feature) + 2)"
    name = f"case when part % 4 = 0 then 'delete-all-flow' when part % 4 = 1 and part % 3 = 0 then 'index.ts-flow' when part % 4 = 1 then 'state-management-flow' else concat({kind}, '-flow') end"
    own = B.files(spark, d)
    return U.clean_flows(own.select("feature", F.expr(name).alias("flow"), "path"), own.select("feature", "path")).groupBy("feature", "flow").agg(F.count(F.lit(1)).alias("files"))


@query("rp11_singletons", f"WITH m AS (SELECT CASE WHEN part % 20 = 0 THEN 'one' || part WHEN part % 9 = 0 THEN 'shared-infra' ELSE feature END AS feature, part FROM files), o AS (SELECT CASE WHEN part % 20 = 0 AND part % 40 <> 0 THEN 'shared-infra' ELSE feature END AS feature FROM m) {COUNTED}", "files")
def rp11_singletons(spark, d):
    m = mapped(spark, d, "case when part % 20 = 0 then concat('one', part) when part % 9 = 0 then '/Utils/' else feature end")
    return counted(U.without_singletons(m, B.files(spark, d).select(F.expr("if(part % 20 = 0, concat('one', part), feature)").alias("feature"), "part").where("part % 40 = 0 or part % 20 <> 0")))


@query("rp16_applied_delta", f"WITH o AS (SELECT feature FROM files WHERE part % 6 <> 0 UNION ALL SELECT feature FROM files WHERE part % 6 = 1) {COUNTED}", "files")
def rp16_delta(spark, d):
    own = B.files(spark, d)
    new = own.where("part % 6 = 1").select("feature", F.concat(F.lit("new/"), "path").alias("path"))
    return counted(U.applied_delta(own, new.unionByName(new.select(F.concat(F.lit("no-"), "feature").alias("feature"), "path")), own.where("part % 6 = 0")))


@query("jn15_named_consumers", f"WITH m AS (SELECT part, CASE WHEN feature = 'brand1' THEN feature ELSE feature || '-' || {KIND} END AS feature, path FROM files), told AS (SELECT DISTINCT b.path, a.feature AS consumer FROM edges JOIN m a ON a.path = src JOIN m b ON b.path = dst WHERE b.feature = 'brand1' AND a.feature <> 'brand1' AND b.part % 9 <> 0), n AS (SELECT DISTINCT feature, replace(feature, '-', '') AS name FROM m WHERE feature <> 'brand1'), w AS (SELECT path, unnest([split_part(split_part(path, '/', -1), '_', 1), split_part(path, '/', -2)]) AS w FROM m WHERE feature = 'brand1' AND path NOT IN (SELECT path FROM told)) SELECT path, consumer, 'import' AS how FROM told UNION ALL SELECT DISTINCT path, feature, 'name' FROM w JOIN n ON contains(name, w) OR contains(w, name) WHERE length(w) >= 4", "edges")
def jn15_named(spark, d):
    """Nothing imports files of every ninth part here, so that some are left to their names."""
    m = B.files(spark, d).withColumn("feature", F.expr("if(feature = 'brand1', feature, flow)"))
    told = B.edges(spark, d).join(m.where("part % 9 <> 0").select(F.col("path").alias("dst")), "dst")
    return U.consumers(m.select("feature", "path"), told, "brand1")


JUDGED = [("brand1", "shared-aggregator", 5, None), ("brand2", "developer-internal", 5, "dev-kit"), ("brand3", "developer-internal", 5, "brand4"), ("brand5", "developer-internal", 2, "x"), ("brand6", "tooling-infra", 4, None), ("brand7", "tooling-infra", 3, None), ("brand8", "product-feature", 4, "shop"), ("brand9", "product-feature", 5, "brand10"), ("brand11", "shared-aggregator", 3, None), ("brand12", "product-feature", 4, "shop")]
JUDGED_SQL = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in JUDGED)


@query("gr10_classified", f"WITH v AS (SELECT * FROM (VALUES {JUDGED_SQL}) t(feature, kind, confidence, proposed)), z AS (SELECT feature, count(*) AS size FROM files GROUP BY 1), l AS (SELECT feature FROM (SELECT * FROM z ORDER BY size DESC, feature LIMIT 1) WHERE size >= 30), s AS (SELECT v.*, v.feature NOT IN (SELECT feature FROM l) AS free, size <= 50 AND size * 3 <= 200 AS small FROM v JOIN z USING (feature)), j AS (SELECT feature, CASE WHEN kind = 'shared-aggregator' AND confidence >= 4 AND free THEN 'spread' WHEN kind = 'developer-internal' AND free AND small THEN CASE WHEN proposed = 'dev-kit' THEN 'dev-kit' ELSE 'developer-infrastructure' END WHEN kind = 'tooling-infra' AND confidence >= 4 AND free AND small THEN 'shared-infra' WHEN feature = (SELECT min(feature) FROM s WHERE proposed = 'shop') THEN 'shop' ELSE feature END AS target FROM s), u AS (SELECT DISTINCT dst AS path, files.feature AS consumer FROM edges JOIN files ON path = src JOIN files t ON t.path = dst WHERE files.feature <> 'brand1' AND t.part % 9 <> 0), r AS (SELECT coalesce(target, feature) AS feature, path, CAST(NULL AS VARCHAR) AS origin FROM files LEFT JOIN j USING (feature) WHERE target IS DISTINCT FROM 'spread' UNION ALL SELECT coalesce(consumer, 'shared-infra'), path, CASE WHEN consumer IS NOT NULL THEN feature END FROM files JOIN j USING (feature) LEFT JOIN u USING (path) WHERE target = 'spread') SELECT feature, origin, count(*) AS files FROM r GROUP BY 1, 2", "edges")
def gr10_classified(spark, d):
    own = B.files(spark, d)
    known = own.where("part % 9 <> 0").select(F.col("path").alias("dst"))  # nothing imports the others here
    use = B.edges(spark, d).join(own.where("feature <> 'brand1'").select(F.col("path").alias("src"), F.col("feature").alias("consumer")), "src").join(known, "dst").select(F.col("dst").alias("path"), "consumer")
    verdicts = spark.createDataFrame(JUDGED, "feature string, kind string, confidence int, proposed string")
    commits = own.groupBy("feature").agg((F.count(F.lit(1)) * 3).alias("commits"))
    return U.classified(own, verdicts, use, commits).groupBy("feature", "origin").agg(F.count(F.lit(1)).alias("files"))


@query("jn11_orphans", f"WITH o AS (SELECT CASE WHEN part % 17 = 0 THEN 'shared-infra' ELSE feature END AS feature FROM files) {COUNTED}", "files")
def jn11_orphans(spark, d):
    return counted(U.with_orphans(B.feature_files(spark, d), B.files(spark, d)))


@query("jn11_unattached", "SELECT path AS file, name AS symbol FROM symbols WHERE NOT (name IN ('fn0', 'fn1') AND path LIKE '%/promo/%')", "symbols")
def jn11_unattached(spark, d):
    s = B.symbols(spark, d).select(F.col("path").alias("file"), F.col("name").alias("symbol"))
    return U.unattached(s, s.where("symbol in ('fn0', 'fn1') and file like '%/promo/%'"))


@query("jn11_live_flows", "SELECT DISTINCT flow FROM files JOIN commit_files USING (path) JOIN commits USING (sha), clock WHERE ts >= as_of - INTERVAL 30 DAY", "commits commit_files clock")
def jn11_live(spark, d):
    own, c = B.files(spark, d), B.commits(spark, d)
    late = c.crossJoin(F.broadcast(B.as_of(c))).where(F.expr("ts >= as_of - interval 30 days")).select("sha")
    touched = B.commit_files(spark, d).join(late, "sha").join(own.select("path", "flow"), "path")
    return U.without_ghosts(own.select("flow").distinct(), touched)


@query("rp14_clean_inputs", f"WITH o AS (SELECT CASE WHEN part % 6 = 0 THEN 'documentation' ELSE feature END AS feature FROM files WHERE part % 6 = 0 OR (part % 5 <> 0 AND part % 6 > 2 AND NOT contains(path, '/tests/'))) {COUNTED}", "files")
def rp14_inputs(spark, d):
    return counted(U.clean_inputs(mapped(spark, d, "if(part % 5 = 0, ' Tests ', feature)", "case part % 6 when 0 then concat('docs/', part, '.md') when 1 then concat('src/__tests__/', part, '.ts') when 2 then concat('src/x/', part, '.test.ts') else path end")))


@query("rp14_library_roots", f"WITH o AS (SELECT CASE WHEN part % 3 = 2 THEN feature WHEN part % 4 = 3 THEN 'auth' ELSE 'context' END AS feature FROM files) {COUNTED}", "files")
def rp14_roots(spark, d):
    return counted(U.promoted_roots(mapped(spark, d, "case part % 3 when 0 then 'root' when 1 then 'init' else feature end", "concat('p', part, '/', case part % 4 when 0 then 'context.go' when 1 then 'context_test.go' when 2 then 'context_appengine.go' else 'Auth.go' end)")))


@query("rp12_crud_gaps", "WITH m AS (SELECT feature || 's' AS feature, part, CASE part % 6 WHEN 0 THEN 'delete' WHEN 1 THEN 'create' WHEN 2 THEN 'update' WHEN 3 THEN 'delete' END AS verb FROM files WHERE part % 7 <> 0) SELECT feature, verb || '-' || left(feature, -1) || '-flow' AS flow, count(*) AS files FROM m WHERE verb IS NOT NULL AND NOT (verb = 'create' AND feature = 'brand2s') GROUP BY 1, 2", "files")
def rp12_gaps(spark, d):
    k = "concat('src/x/', case part % 6 when 0 then 'DeleteTagButton' when 1 then 'api' when 2 then 'hooks' when 3 then 'add.remove_item' else 'renew' end, '.', part, '.ts')"
    own = B.files(spark, d).select(F.concat("feature", F.lit("s")).alias("feature"), "part", F.expr(k).alias("path"))
    routes = F.expr("case when part % 6 = 1 then array('GET /a', 'post /b') else array('GET /posts') end")
    exports = F.expr("case when part % 6 = 2 then array('x', 'usePatchItem') else array('deleted', 'renew') end")
    flows = own.where("part % 7 = 0").select("feature", F.lit("main-flow").alias("flow"), "path").unionByName(own.where("feature = 'brand2s'").select("feature", F.lit("Renew-plan-flow").alias("flow"), F.lit("none").alias("path")).distinct())
    return U.crud_gaps(own.select("feature", "path"), flows, own.select("path", routes.alias("routes"), exports.alias("exports"))).groupBy("feature", "flow").agg(F.count(F.lit(1)).alias("files"))
