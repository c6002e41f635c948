"""Names, roles, evaluation, and the remaining rewrites."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..operators import evaluation as E
from ..operators import lines as L
from ..operators import rules as R
from ..sources import bridge as B
from .functions import SHAPED_SQL, listed, shaped
from .registry import query

CONTENTS = "CASE part % 6 WHEN 0 THEN 'model Post {' WHEN 1 THEN 'app.get(''/x'', f)' WHEN 2 THEN 'const s = createSlice(x)' WHEN 3 THEN 'useQuery(k)' WHEN 4 THEN 'import R from ''react''; <Panel a=1>' ELSE 'plain' END"


@query("fn11_content_layers", f"SELECT path, CASE part % 6 WHEN 0 THEN 'schema' WHEN 1 THEN 'api-server' WHEN 2 THEN 'state' WHEN 3 THEN 'api-client' WHEN 4 THEN 'ui' ELSE 'support' END AS layer FROM files", "files")
def fn11(spark, d):
    k = F.col("part") % 6
    text = F.when(k == 0, "model Post {").when(k == 1, "app.get('/x', f)").when(k == 2, "const s = createSlice(x)").when(k == 3, "useQuery(k)").when(k == 4, "import R from 'react'; <Panel a=1>").otherwise("plain")
    return B.files(spark, d).select("path", P.file_layer(F.col("path"), text).alias("layer"))


#: Names, kinds and what the rules say of them, in files a/b.tsx with routes.
ROLE_CASES = (
    ("isLoading", "const", "loading-state"), ("hasPending", "const", "loading-state"), ("cartSubmitting", "const", "loading-state"), ("Refetching_all", "const", "loading-state"), ("isLoadingError", "const", "loading-state"), ("loading", "function", "helper"),
    ("formErrors", "const", "error-state"), ("ErrorMessage", "function", "error-state"), ("hasFailed", "const", "error-state"), ("terror", "function", "helper"), ("LoadFailure", "class", "error-state"), ("onError", "function", "error-state"),
    ("validateEmail", "function", "validator"), ("isValidCard", "function", "validator"), ("checkAccess", "function", "validator"), ("UserSchema", "const", "validator"), ("orderSchema", "const", "validator"), ("EmailValidator", "class", "validator"), ("ensure_open", "function", "validator"), ("checkout", "function", "helper"),
    ("useUserQuery", "function", "data-fetch"), ("fetchOrders", "function", "data-fetch"), ("deleteItemAsync", "function", "data-fetch"), ("getName", "function", "data-fetch"),
    ("useScrollEffect", "function", "side-effect"), ("onClose", "function", "side-effect"), ("beforeSaveHook", "function", "side-effect"),
    ("cartAtom", "const", "state"), ("useCart", "function", "state"), ("setOpen", "function", "state"), ("AuthContext", "const", "state"),
    ("handleSubmit", "function", "handler"), ("UserController", "class", "handler"), ("loginAction", "function", "handler"),
    ("POST", "function", "entry"), ("UserCard", "function", "ui-component"), ("MAX", "const", "helper"), ("Row", "type", "type"), ("isLoadingType", "type", "type"), ("misc", "function", "helper"), ("", "function", "helper"),
)


@query("fn12_symbol_roles", f"SELECT part AS k, {listed([r for _, _, r in ROLE_CASES])}[CAST(part % {len(ROLE_CASES)} AS INTEGER) + 1] AS role FROM files", "files")
def fn12(spark, d):
    i = (F.col("part") % len(ROLE_CASES)).cast("int")
    name, kind = (F.get(F.array(*[F.lit(c[j]) for c in ROLE_CASES]), i) for j in (0, 1))
    return B.files(spark, d).select(F.col("part").alias("k"), N.symbol_role(name, kind, F.lit("a/b.tsx"), F.lit(True)).alias("role"))


@query("fn14_stems", "SELECT part AS k, ['chat', 'messages', 'user', 'page'][CAST(part % 4 AS INTEGER) + 1] AS stem FROM files", "files")
def fn14(spark, d):
    names = F.array(*map(F.lit, ("ChatPage", "v1_messages", "user_service", "page")))
    return B.files(spark, d).select(F.col("part").alias("k"), P.normal_stem(F.get(names, (F.col("part") % 4).cast("int"))).alias("stem"))


@query("fn18_app_routes", r"SELECT path, '/' || regexp_replace(regexp_replace(regexp_replace(path, '^((src|app)/)+', ''), '/?route\.[a-z]+$', ''), '\.[a-z]+$', '') AS route FROM files", "files")
def fn18(spark, d):
    return B.files(spark, d).select("path", P.app_route(F.col("path")).alias("route"))


@query("fn19_domain_words", f"WITH {SHAPED_SQL}, p AS (SELECT path, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(split_part(path, '/', -1), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')), '[_.-]'), lambda x: x <> '') AS ws FROM shaped), r AS (SELECT DISTINCT path, array_to_string(list_slice(ws, i, i + k - 1), '_') AS run FROM p, unnest(range(1, len(ws) + 1)) a(i), unnest(range(1, 4)) b(k) WHERE i + k - 1 <= len(ws)) SELECT run, count(*) AS files FROM r GROUP BY 1 HAVING count(*) >= 5", "files")
def fn19(spark, d):
    return shaped(spark, d).select("path", F.explode(P.word_runs(P.file_name(F.col("path")))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("files")).where("files >= 5")


@query("fn20_flow_filters", "SELECT part AS k, part % 7 = 0 AS by_file, part % 7 = 1 AS technical, part % 7 IN (4, 5, 6) AS marketing FROM files", "files")
def fn20(spark, d):
    names = F.array(*map(F.lit, ("default-config.ts-flow", "data-loading-flow", "login-flow", "password-reset-flow", "View-Pricing-flow", "apply-to-job-flow", "review-pricing-flow")))
    name = F.get(names, (F.col("part") % 7).cast("int"))
    return B.files(spark, d).select(F.col("part").alias("k"), N.is_filename_flow(name).alias("by_file"), N.is_technical_flow(name).alias("technical"), N.is_marketing_flow(name).alias("marketing"))


@query("fn22_e2e_anchors", "WITH e AS (SELECT part, CASE WHEN part % 2 = 0 THEN 'e2e/' || feature || '_Login.spec.ts' ELSE 'src/' || feature || '.cy.ts' END AS path, CASE WHEN part % 2 = 0 THEN feature || '-login-flow' ELSE feature || '-flow' END AS flow FROM files) SELECT flow, count(DISTINCT path) AS files FROM e GROUP BY 1", "files")
def fn22(spark, d):
    path = F.when(F.col("part") % 2 == 0, F.concat(F.lit("e2e/"), "feature", F.lit("_Login.spec.ts"))).otherwise(F.concat(F.lit("src/"), "feature", F.lit(".cy.ts")))
    return B.files(spark, d).select(path.alias("path")).select("path", P.e2e_flow(F.col("path")).alias("flow")).groupBy("flow").agg(F.countDistinct("path").alias("files"))


@query("fn23_entry_trails", "SELECT part AS k, 'Logs in' AS description, CASE WHEN part % 2 = 0 THEN path END AS entry_file, CASE WHEN part % 2 = 0 THEN CAST(part % 90 AS INTEGER) END AS entry_line FROM files", "files")
def fn23(spark, d):
    text = F.when(F.col("part") % 2 == 0, F.format_string("Logs in (entry: %s:%d)", F.col("path"), F.col("part") % 90)).otherwise("Logs in")
    return B.files(spark, d).select(F.col("part").alias("k"), *[c.alias(n) for n, c in N.entry_trail(text).items()])


EXPECTED = "e AS (SELECT DISTINCT feature AS name, [feature || '-area'] AS aliases FROM files), d AS (SELECT DISTINCT feature AS name FROM files WHERE feature <> 'brand3' UNION SELECT 'documentation' UNION SELECT 'other thing')"


def truth(spark, d):
    f = B.files(spark, d)
    expected = f.select(F.col("feature").alias("name"), F.array(F.concat("feature", F.lit("-area"))).alias("aliases")).distinct()
    detected = f.where("feature <> 'brand3'").select(F.col("feature").alias("name")).distinct().unionByName(spark.createDataFrame([("documentation",), ("other thing",)], "name string"))
    return expected, detected


@query("ag22_recall", f"WITH {EXPECTED} SELECT round(count(*) FILTER (name IN (SELECT name FROM d)) / count(*), 6) AS recall FROM e", "files")
def ag22_recall(spark, d):
    return E.recall(*truth(spark, d))


@query("ag22_precision", f"WITH {EXPECTED} SELECT round(count(*) FILTER (name IN (SELECT name FROM e)) / count(*), 6) AS precision FROM d WHERE name <> 'documentation'", "files")
def ag22_precision(spark, d):
    return E.precision(*truth(spark, d))


@query("ag22_attribution", "WITH s AS (SELECT path, CASE WHEN part % 7 = 0 THEN 'wrong' ELSE feature END AS expected FROM files) SELECT count(*) AS samples, count(*) FILTER (f.feature = expected) AS correct, round(count(*) FILTER (f.feature = expected) / count(*), 6) AS accuracy FROM s LEFT JOIN feature_files f USING (path)", "feature_files")
def ag22_attribution(spark, d):
    s = B.files(spark, d).select("path", F.when(F.col("part") % 7 == 0, "wrong").otherwise(F.col("feature")).alias("expected"))
    return E.attribution_accuracy(s, B.feature_files(spark, d))


@query("ag22_generic_rate", "SELECT round(count(*) FILTER (p_type IN ('SMALL', 'LARGE')) / count(*), 6) AS generic_rate FROM part")
def ag22_generic(spark, d):
    return E.generic_rate(B.table(spark, d, "part").select(F.concat(F.lit("x/"), F.lower("p_type"), F.lit("s")).alias("name")), ("small", "large"))


@query("ag23_flow_accuracy", "WITH t AS (SELECT flow, feature, length(flow) % 3 AS k FROM (SELECT DISTINCT flow, feature FROM files)) SELECT count(*) AS flows, count(*) FILTER (k = 1) AS correct, round(count(*) FILTER (k = 1) / count(*), 6) AS accuracy FROM t", "files")
def ag23(spark, d):
    f = B.files(spark, d).select(F.col("flow").alias("name"), F.col("feature").alias("owner")).distinct()
    k = F.length("name") % 3
    t = f.select("name", F.when(k == 0, "<DROP>").when(k == 1, F.concat(F.lit("<NEW>:"), "owner")).otherwise("elsewhere").alias("expected_feature"))
    return E.flow_accuracy(f, t)


@query("ag24_ownership", "WITH n AS (SELECT flow, CASE WHEN part % 4 = 0 THEN 'core' ELSE feature END AS feature, count(*) AS files FROM files GROUP BY 1, 2) SELECT flow, feature, files, round(files / sum(files) OVER (PARTITION BY flow), 6) AS share FROM n", "files")
def ag24(spark, d):
    f = B.files(spark, d)
    return E.ownership(f, f.select("path", F.when(F.col("part") % 4 == 0, "core").otherwise(F.col("feature")).alias("feature")))


@query("rp8_name_reattribution", "SELECT DISTINCT feature || '-' || CASE WHEN part % 2 = 0 THEN 'checkout-flow' ELSE 'browse-flow' END AS flow, CASE WHEN part % 2 = 0 THEN 'checkout' ELSE feature END AS owner, part % 2 = 0 AS moved FROM files", "files")
def rp8(spark, d):
    f = B.files(spark, d)
    flows = f.select(F.concat("feature", F.lit("-"), F.when(F.col("part") % 2 == 0, "checkout-flow").otherwise("browse-flow")).alias("flow"), F.when(F.col("part") % 2 == 0, F.lit("area")).otherwise(F.col("feature")).alias("owner")).distinct()
    features = f.select("feature").distinct().where("feature like 'none%'").unionByName(spark.createDataFrame([("checkout",), ("area",), ("shared-infra",)], "feature string"))
    return R.name_reattribution(flows, features)


@query("rp11_flow_dedup", "WITH n AS (SELECT split_part(flow, '-', 2) AS flow, feature AS owner, count(*) AS own_files FROM files GROUP BY 1, 2), a AS (SELECT feature AS owner, count(*) AS all_files FROM files GROUP BY 1) SELECT flow, owner FROM n JOIN a USING (owner) QUALIFY row_number() OVER (PARTITION BY flow ORDER BY own_files DESC, all_files DESC, owner) = 1", "files")
def rp11(spark, d):
    f = B.files(spark, d)
    n = f.groupBy(F.split("flow", "-")[1].alias("flow"), F.col("feature").alias("owner")).agg(F.count(F.lit(1)).alias("own_files"))
    return R.deduplicated_flows(n.join(f.groupBy(F.col("feature").alias("owner")).agg(F.count(F.lit(1)).alias("all_files")), "owner"))


@query("rp5_top_dirs", "WITH g AS (SELECT feature, split_part(path, '/', 3) AS dir, count(*) AS files FROM files GROUP BY 1, 2), s AS (SELECT *, sum(files) OVER (PARTITION BY feature) AS n, count(*) OVER (PARTITION BY feature) AS dirs FROM g) SELECT feature, dir, files FROM s WHERE n >= 10 AND dirs >= 2 AND files >= 3", "files")
def rp5_dirs(spark, d):
    return R.top_dir_extraction(B.files(spark, d).select("feature", "path"))


@query("rp5_foreign_files", "WITH f AS (SELECT CASE WHEN part % 40 = 0 THEN 'brand1' ELSE feature END AS feature, path, split_part(path, '/', 2) AS dir FROM files), n AS (SELECT dir, feature, count(*) AS n FROM f GROUP BY 1, 2), t AS (SELECT dir, sum(n) AS total, max_by(feature, (n, feature)) AS owner, max(n) AS most FROM n GROUP BY 1), s AS (SELECT feature, count(*) AS size FROM f GROUP BY 1) SELECT f.feature, path, owner FROM f JOIN t USING (dir) JOIN n ON n.dir = f.dir AND n.feature = f.feature JOIN s ON s.feature = f.feature WHERE most >= 0.6 * total AND f.feature <> owner AND size >= 4 AND n < 0.1 * size", "files")
def rp5_foreign(spark, d):
    return R.foreign_files(B.files(spark, d).select(F.when(F.col("part") % 40 == 0, "brand1").otherwise(F.col("feature")).alias("feature"), "path", F.split("path", "/")[1].alias("dir")))


@query("rp12_crud_flows", "SELECT feature, ['delete', 'create', 'update'][CAST(part % 3 AS INTEGER) + 1] || '-' || feature || '-flow' AS flow, path FROM files WHERE part % 5 <> 0", "files")
def rp12(spark, d):
    names = F.array(*map(F.lit, ("user_delete", "create-user", "edit_user")))
    f = B.files(spark, d).withColumn("name", F.get(names, (F.col("part") % 3).cast("int")))
    return R.crud_flows(f.select("feature", "path", "name"), f.where("part % 5 = 0"))


@query("rp21_better_names", "SELECT part AS k, part % 3 = 1 AS better FROM files", "files")
def rp21(spark, d):
    names = F.array(*map(F.lit, ("core", "invoice export", "BILLING")))
    return B.files(spark, d).select(F.col("part").alias("k"), N.is_better_name(F.lit("billing"), F.get(names, (F.col("part") % 3).cast("int")), ["core", "app", "main"]).alias("better"))


@query("ag17_route_merge", "WITH e AS (SELECT '/u/' || user_id % 20 AS route, user_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS i, value FROM events WHERE event_type = 'view'), s AS (SELECT route, count(*) AS n, CAST(sum(user_id % 5) AS BIGINT) AS visitors, list(value ORDER BY i) AS vs FROM e GROUP BY 1) SELECT route, n AS views, visitors, round(list_reduce(vs, lambda a, b: (a + b) / 2), 6) AS duration FROM s")
def ag17(spark, d):
    """Views and visitors (here user_id % 5 for each row) are summed. The running mean of each new value with what came before depends on the order, which is that of event_id. Written out it halves a value's weight with each later one, so it is a sum and no list is gathered."""
    e = B.table(spark, d, "events").where("event_type = 'view'").select(F.concat(F.lit("/u/"), (F.col("user_id") % 20).cast("string")).alias("route"), "event_id", "value", (F.col("user_id") % 5).alias("visitors"))
    later = F.row_number().over(W.partitionBy("route").orderBy(F.desc("event_id")))
    n = F.count(F.lit(1)).over(W.partitionBy("route"))
    weighted = e.withColumn("later", later).withColumn("n", n).withColumn("w", F.pow(F.lit(0.5), F.when(F.col("later") == F.col("n"), F.col("n") - 1).otherwise(F.col("later"))))
    return weighted.groupBy("route").agg(F.count(F.lit(1)).alias("views"), F.sum("visitors").alias("visitors"), F.round(F.sum(F.col("value") * F.col("w")), 6).alias("duration"))


@query("so2_disjoint_pairs", "WITH p AS (SELECT DISTINCT feature, flow, regexp_extract(path, '([a-z]+)_[^/]*$', 1) || part % 32 AS word FROM files), f AS (SELECT DISTINCT feature, flow FROM p) SELECT a.feature, a.flow AS f1, b.flow AS f2 FROM f a JOIN f b ON a.feature = b.feature AND a.flow < b.flow WHERE NOT EXISTS (SELECT 1 FROM p x JOIN p y ON x.word = y.word WHERE x.feature = a.feature AND x.flow = a.flow AND y.feature = b.feature AND y.flow = b.flow)", "files")
def so2(spark, d):
    """Pairs of a feature's flows whose files share no item: the word of the name with part % 32."""
    p = B.files(spark, d).select("feature", "flow", F.concat(F.regexp_extract("path", "([a-z]+)_[^/]*$", 1), (F.col("part") % 32).cast("string")).alias("word")).distinct()
    return R.disjoint_pairs(p.select(F.col("feature").alias("group"), F.col("flow").alias("name"), F.col("word").alias("item"))).select(F.col("group").alias("feature"), "f1", "f2")


@query("so2_disjoint_names", "WITH s AS (SELECT flow, 'same' AS name, path FROM files), r AS (SELECT flow, name, min(path) AS lo, max(path) AS hi FROM s GROUP BY 1, 2) SELECT flow AS part, name || '-' || string_split(lo, '/')[2] AS renamed FROM r", "files")
def so2_names(spark, d):
    """Sets of one name without common files are told apart by the first directory in which their paths differ: here that of the brand."""
    return R.disjoint_names(B.files(spark, d).select(F.lit("same").alias("name"), F.col("flow").alias("part"), "path"))


@query("tx10_symbol_split", "WITH k AS (SELECT path, name, start, stop, CASE WHEN (part + CAST(substr(name, 3) AS INTEGER)) % 5 < 2 THEN 'type' ELSE 'function' END AS kind FROM ranges JOIN files USING (path)) SELECT path, coalesce(string_agg(name, '|' ORDER BY start) FILTER (kind <> 'type'), '') AS flow_symbols, coalesce(string_agg(name, '|' ORDER BY start) FILTER (kind = 'type'), '') AS feature_symbols, string_agg(name || '=' || start || '-' || stop, '|' ORDER BY start) AS lines FROM k GROUP BY 1", "ranges")
def tx10(spark, d):
    """Symbols that may be part of a flow and those that only a feature has, with their lines."""
    s = L.symbol_ranges(B.symbols(spark, d)).join(B.files(spark, d).select("path", "part"), "path")
    kind = F.when((F.col("part") + F.substr("name", F.lit(3)).cast("int")) % 5 < 2, "type").otherwise("function")
    return R.split_symbols(s.withColumn("kind", kind).withColumn("has_routes", F.lit(False))).select("path", "flow_symbols", "feature_symbols", "lines")


@query("st2_throttle", "WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts FROM events), r(user_id, ts) AS (SELECT user_id, min(ts) FROM e GROUP BY 1 UNION ALL SELECT r.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 3600 SECOND) FROM r WHERE r.ts IS NOT NULL) SELECT user_id, ts FROM r WHERE ts IS NOT NULL")
def st2(spark, d):
    """Requests of each user accepted at least an hour after the last accepted one."""
    from ..streaming.watch import throttle_batch

    return throttle_batch(B.table(spark, d, "events").select("user_id", "ts"), seconds=3600, key="user_id")


@query("st5_updated_counters", "SELECT feature, count(*) AS total_commits, count(*) FILTER (is_bug_fix) AS bug_fixes, round(count(*) FILTER (is_bug_fix) / count(*), 3) AS bug_fix_ratio FROM (SELECT DISTINCT sha, feature FROM commit_files JOIN files USING (path)) JOIN commits USING (sha) GROUP BY 1", "files commit_files commits")
def st5(spark, d):
    """Counters of the older half of the history, brought up to date with the newer."""
    from ..streaming.watch import updated_counters

    own = B.commit_files(spark, d).join(B.files(spark, d).select("path", "feature"), "path")
    c = B.commits(spark, d)
    none = spark.createDataFrame([], "feature string, total_commits long, bug_fixes long")
    old = updated_counters(none, own, c.where("sha % 2 = 0")).drop("bug_fix_ratio")
    return updated_counters(old, own, c.where("sha % 2 = 1"))


@query("windows_by_hour", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows_by_hour(spark, d):
    e = B.table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
