"""Look-ups, candidates for symbols, stems and domains, entry points, symbol refresh, and votes on what a repository is."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import domains as D
from ..operators import discovery as V
from ..operators import incremental as N
from ..operators import lines as L
from ..operators import lookups as K
from ..sources import bridge as B
from .features import BASE, METRICS, feature_metrics
from .functions import listed, q
from .registry import query

PROBES = ["brand11", "AREA 12", " b13 ", "tier7", "nothing", "Brand2-Area", "files of brand4", "area"]
PROBE_ROWS = f"probes AS (SELECT unnest({listed(PROBES)}) AS probe)"


def feature_map(spark, d):
    """(ord, feature, display, aliases, labels, description), one row for each feature."""
    names = B.files(spark, d).select("feature").distinct()
    n = F.substr("feature", F.lit(6))
    own = names.withColumn("ord", F.row_number().over(W.orderBy("feature")))  # one row for each feature
    return own.select("ord", "feature", F.concat(F.lit("Area "), n).alias("display"), F.array(F.concat("feature", F.lit("-area")), F.concat(F.lit("b"), n)).alias("aliases"), F.array(F.concat(F.lit("tier"), F.length("feature").cast("string"))).alias("labels"), F.concat(F.lit("Files of "), "feature").alias("description"))


MAP = "m AS (SELECT row_number() OVER (ORDER BY feature) AS ord, feature, 'Area ' || substr(feature, 6) AS display, [feature || '-area', 'b' || substr(feature, 6)] AS aliases, ['tier' || length(feature)] AS labels, 'Files of ' || feature AS description FROM (SELECT DISTINCT feature FROM files))"
EXACT = f"{PROBE_ROWS}, {MAP}, x AS (SELECT probe, min_by(feature, ord) AS feature FROM probes JOIN m ON list_contains(list_transform(list_concat([display, feature], list_concat(aliases, labels)), lambda v: lower(v)), lower(trim(probe))) GROUP BY 1)"


def probes(spark):
    return spark.createDataFrame([(p,) for p in PROBES], "probe string")


@query("so6_exact_feature", f"WITH {EXACT} SELECT * FROM x", "files")
def so6_exact(spark, d):
    return K.resolved(feature_map(spark, d), probes(spark))


@query("so6_find_feature", f"WITH {PROBE_ROWS}, {MAP} SELECT probe, min_by(feature, ord) AS feature FROM probes JOIN m ON len(list_filter(list_concat([display, feature, description], list_concat(aliases, labels)), lambda v: contains(lower(v), lower(probe)))) > 0 GROUP BY 1", "files")
def so6_find(spark, d):
    return K.found(feature_map(spark, d), PROBES)


@query("so6_feature_files", f"WITH {EXACT} SELECT probe, feature, path FROM x JOIN files USING (feature)", "files")
def so6_files(spark, d):
    return K.resolved(feature_map(spark, d), probes(spark)).join(B.files(spark, d).select("feature", "path"), "feature").select("probe", "feature", "path")


@query("so6_flow_files", f"WITH {EXACT} SELECT probe, flow, count(*) AS files, min(path) AS first FROM x JOIN files USING (feature) WHERE ends_with(flow, '-promo') OR ends_with(flow, '-small') GROUP BY 1, 2", "files")
def so6_flow_files(spark, d):
    own = K.resolved(feature_map(spark, d), probes(spark)).join(B.files(spark, d), "feature").where(F.col("flow").endswith("-promo") | F.col("flow").endswith("-small"))
    return own.groupBy("probe", "flow").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"))


ATTRIBUTED = "att AS (SELECT flow, f.path, name, start, stop FROM ranges JOIN files f USING (path) WHERE part % 4 = 0 AND name <> 'fn1' AND NOT ends_with(flow, '-small')), p AS (SELECT DISTINCT flow FROM files WHERE feature IN ('brand11', 'brand24', 'brand33'))"


def attributed(spark, d):
    f = B.files(spark, d).where(~F.col("flow").endswith("-small") & (F.col("part") % 4 == 0)).select("flow", "path")
    return f.join(L.symbol_ranges(B.symbols(spark, d)).where("name <> 'fn1'"), "path").select("flow", "path", "name", "start", "stop")


@query("so6_symbols_in_flow", f"WITH {ATTRIBUTED}, own AS (SELECT * FROM att WHERE flow IN (SELECT flow FROM p)) SELECT flow, path, string_agg(name, '|' ORDER BY start, name) AS symbols, sum(stop - start + 1)::BIGINT AS lines, 'symbol' AS precision FROM own GROUP BY 1, 2 UNION ALL SELECT flow, path, NULL, NULL, 'file' FROM files WHERE flow IN (SELECT flow FROM p) AND flow NOT IN (SELECT flow FROM own)", "ranges")
def so6_symbols(spark, d):
    f = B.files(spark, d)
    return K.symbols_in_flow(f.select("flow", "path"), attributed(spark, d), f.where(F.col("feature").isin("brand11", "brand24", "brand33")).select("flow").distinct())


@query("so6_shared_symbols", "WITH t AS (SELECT feature, path, name, start, stop FROM ranges JOIN files USING (path) WHERE name IN ('fn3', 'fn4') AND feature = 'brand24') SELECT feature, path, string_agg(name || ':' || start || ':' || stop, '|' ORDER BY start, name) AS symbols FROM t GROUP BY 1, 2", "ranges")
def so6_shared(spark, d):
    """Symbols that a feature's flows share: here its files' last two."""
    own = B.files(spark, d).where("feature = 'brand24'").select("feature", "path")
    return K.listing(L.symbol_ranges(B.symbols(spark, d)).where("name in ('fn3', 'fn4')").join(own, "path", "left_semi")).join(own, "path").select("feature", "path", "symbols")


@query("so6_imports_of", "SELECT src AS path, dst AS other, feature FROM edges LEFT JOIN files ON path = dst WHERE src IN (SELECT path FROM files WHERE feature = 'brand11')", "edges")
def so6_imports(spark, d):
    f = B.files(spark, d)
    return K.neighbours(B.edges(spark, d), f, f.where("feature = 'brand11'"))


@query("so6_consumers_of", "SELECT dst AS path, src AS other, feature FROM edges LEFT JOIN files ON path = src WHERE dst IN (SELECT path FROM files WHERE feature = 'brand11')", "edges")
def so6_consumers(spark, d):
    f = B.files(spark, d)
    return K.neighbours(B.edges(spark, d), f, f.where("feature = 'brand11'"), consumers=True)


@query("so6_feature_summary", f"WITH {EXACT} SELECT probe, feature, count(*) AS files, count(DISTINCT flow) AS flows, array_to_string(list_slice(list(path ORDER BY path), 1, 8), '|') AS sample, array_to_string(list_slice(list(DISTINCT flow ORDER BY flow), 1, 8), '|') AS flow_names FROM x JOIN files USING (feature) GROUP BY 1, 2", "files")
def so6_summary(spark, d):
    """Counts, the first eight paths and the first eight flows of each probed feature."""
    own = K.resolved(feature_map(spark, d), probes(spark)).join(B.files(spark, d).select("feature", "path", "flow"), "feature")
    place = F.row_number().over(W.partitionBy("probe").orderBy("path"))
    first = lambda c: F.array_join(F.slice(F.array_sort(c), 1, 8), "|")
    ranked = own.withColumn("i", place)
    return ranked.groupBy("probe", "feature").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("flow").alias("flows"), first(F.collect_list(F.when(F.col("i") <= 8, F.col("path")))).alias("sample"), first(F.collect_set("flow")).alias("flow_names"))


@query("tk2_features_by_health", f"WITH {METRICS}, s AS (SELECT feature, count(*) AS files, count(DISTINCT flow) AS flows FROM feature_files JOIN files USING (path, feature) GROUP BY 1) SELECT m.feature, round(health)::BIGINT AS health, round(bug_fix_ratio * 100, 1) AS bug_fix_percent, total_commits AS commits, files, flows, row_number() OVER (ORDER BY health, m.feature) AS place FROM metrics m JOIN s ON s.feature = m.feature", BASE)
def tk2(spark, d):
    """All features, the least healthy first, with their counts."""
    s = B.feature_files(spark, d).join(B.files(spark, d).select("path", "flow"), "path").groupBy("feature").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("flow").alias("flows"))
    place = F.row_number().over(W.orderBy("health", "feature"))  # one row for each feature, after all aggregation
    return feature_metrics(spark, d).join(s, "feature").select("feature", F.round("health").cast("long").alias("health"), F.round(F.col("bug_fix_ratio") * 100, 1).alias("bug_fix_percent"), F.col("total_commits").alias("commits"), "files", "flows", place.alias("place"))


@query("tk5_features_by_size", "SELECT feature, count(*) AS files, row_number() OVER (ORDER BY count(*) DESC, feature) AS place FROM files GROUP BY 1", "files")
def tk5(spark, d):
    n = B.files(spark, d).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("files"), "feature")))  # one row for each feature


STEM_SQL = r"lower(regexp_replace(split_part(path, '/', -1), '(.)\.[^.]*$', '\1'))"
DIR_SQL = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
WORDED = "fl AS (SELECT DISTINCT feature AS owner, flow || '-' || w || '-flow' AS flow FROM files, (SELECT unnest(['tests', 'promo', 'metallic']) AS w))"
TOKENS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda v: v <> '')"


def worded(spark, d):
    each = B.files(spark, d).select("feature", "flow").distinct().withColumn("w", F.explode(F.array(F.lit("tests"), F.lit("promo"), F.lit("metallic"))))
    return each.select(F.col("feature").alias("owner"), F.concat("flow", F.lit("-"), "w", F.lit("-flow")).alias("flow"))


@query("tk7_name_matches", f"WITH {WORDED}, w AS (SELECT flow, owner, list_filter(list_distinct({TOKENS.format('flow')}), lambda v: v <> 'flow') AS ws FROM fl), t AS (SELECT feature AS owner, path, list_distinct({TOKENS.format(STEM_SQL)}) AS st, list_distinct({TOKENS.format(DIR_SQL)}) AS dr FROM files), s AS (SELECT flow, w.owner, path, (2 * len(list_intersect(ws, st)) + len(list_intersect(ws, dr)))::BIGINT AS score FROM w JOIN t ON t.owner = w.owner) SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY flow, owner ORDER BY score DESC, path) <= 8", "files")
def tk7(spark, d):
    return K.name_matches(worded(spark, d), B.files(spark, d).select(F.col("feature").alias("owner"), "path"))


HANDLED = "ft AS (SELECT feature AS owner, CASE part % 5 WHEN 0 THEN replace(path, 'src/', 'src/api/') WHEN 1 THEN replace(path, 'src/', 'server/routes/') WHEN 2 THEN replace(path, 'src/', 'src/i18n/') ELSE path END AS path FROM files)"
HITS = lambda hints: " + ".join(f"CAST(contains(lower(path), {q(h)}) AS INTEGER)" for h in hints)


@query("tk9_flow_candidates", f"WITH {WORDED}, {HANDLED}, own AS (SELECT *, {HITS(K.HANDLER_HINTS)} AS hints, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM ft WHERE {HITS(K.NOISE_HINTS)} = 0), s AS (SELECT flow, fl.owner, path, dir, hints, len(list_filter(list_filter(string_split_regex(lower(flow), '[\\s\\-_/]+'), lambda v: v <> '' AND v <> 'flow'), lambda v: contains(lower(path), v))) AS token FROM fl JOIN own ON own.owner = fl.owner), z AS (SELECT *, 3 * token + hints AS score FROM s), b AS (SELECT flow, owner, max(score) AS top, min_by(dir, (-score, -token, path)) AS near FROM z GROUP BY 1, 2) SELECT z.flow, z.owner, path, row_number() OVER (PARTITION BY z.flow, z.owner ORDER BY score DESC, token DESC, path) AS place FROM z JOIN b ON b.flow = z.flow AND b.owner = z.owner WHERE score > 0 OR top = 0 OR (near <> '' AND starts_with(path, near || '/')) QUALIFY place <= 15", "files")
def tk9(spark, d):
    k = F.col("part") % 5
    path = F.when(k == 0, F.replace("path", F.lit("src/"), F.lit("src/api/"))).when(k == 1, F.replace("path", F.lit("src/"), F.lit("server/routes/"))).when(k == 2, F.replace("path", F.lit("src/"), F.lit("src/i18n/"))).otherwise(F.col("path"))
    return K.flow_candidates(worded(spark, d), B.files(spark, d).select(F.col("feature").alias("owner"), path.alias("path")))


@query("tx4_symbol_lookup", "SELECT path, name, start, stop FROM ranges JOIN files USING (path) WHERE name = 'fn' || part % 7", "ranges")
def tx4(spark, d):
    return K.symbol(L.symbol_ranges(B.symbols(spark, d)), B.files(spark, d).select("path", F.concat(F.lit("fn"), (F.col("part") % 7).cast("string")).alias("name")))


@query("tx4_symbol_listing", "SELECT path, string_agg(name || ':' || start || ':' || stop, '|' ORDER BY start, name) AS symbols FROM ranges GROUP BY 1", "ranges")
def tx4_list(spark, d):
    return K.listing(L.symbol_ranges(B.symbols(spark, d)))


STEMS = "st AS (SELECT DISTINCT regexp_extract(path, '([a-z]+)_[^/]*$', 1) || ['', '_list', '-detail', 's'][CAST(part % 4 AS INTEGER) + 1] AS stem FROM files), an AS (SELECT row_number() OVER (ORDER BY stem) AS ord, stem, 'c-' || stem AS candidate FROM (SELECT DISTINCT CASE WHEN length(w) % 2 = 0 THEN left(w, 4) ELSE w || '_li' END AS stem FROM (SELECT regexp_extract(path, '([a-z]+)_[^/]*$', 1) AS w FROM files) UNION SELECT 'detail' UNION SELECT 'li'))"


@query("jn14_stem_candidates", f"WITH {STEMS}, x AS (SELECT st.stem, candidate, ord, an.stem AS anchor, st.stem = an.stem AS exact FROM st JOIN an ON st.stem = an.stem OR (length(an.stem) >= 3 AND (starts_with(st.stem, an.stem) OR starts_with(an.stem, st.stem) OR list_contains(string_split_regex(st.stem, '[_-]'), an.stem)))) SELECT stem, min_by(candidate, (NOT exact, -length(anchor), ord)) AS candidate FROM x GROUP BY 1", "files")
def jn14(spark, d):
    f = B.files(spark, d)
    w = F.regexp_extract("path", "([a-z]+)_[^/]*$", 1)
    stems = f.select(F.concat(w, F.get(F.array(F.lit(""), F.lit("_list"), F.lit("-detail"), F.lit("s")), (F.col("part") % 4).cast("int"))).alias("stem")).distinct()
    anchors = f.select(F.when(F.length(w) % 2 == 0, F.left(w, F.lit(4))).otherwise(F.concat(w, F.lit("_li"))).alias("stem")).distinct().unionByName(spark.createDataFrame([("detail",), ("li",)], "stem string")).distinct()
    anchors = anchors.withColumn("ord", F.row_number().over(W.orderBy("stem"))).withColumn("candidate", F.concat(F.lit("c-"), "stem"))  # one row for each candidate
    return K.stem_matches(stems, anchors)


PATH_SHAPES = ("backend/routers/investigations.py", "backend/services/investigation_executor.py", "app/src/InvestigationPage.tsx", "pages/api/bookings/[id]/_delete.ts", "src/context_appengine_test.go", "api/v1/pages/users/index.ts", ".github/x.yml", "deploy/run.sh", ".cache/a/b.ts", "lib/multi_legacy_file.rs", "src/deep/views/statuses.py", "config.toml", "a/b/config.toml", "(group)/handlers/glass.go", "models/bus.py", "one/package.json")
SHAPED = f"sp AS (SELECT part, CASE WHEN part % 17 = 0 THEN path ELSE {listed(PATH_SHAPES)}[CAST(part % 17 AS INTEGER)] END AS path, CASE WHEN part % 2 = 0 THEN 'deep' ELSE 'Backend' END AS owner FROM files)"


def path_shapes(spark, d):
    k = (F.col("part") % 17).cast("int")
    return B.files(spark, d).select("part", F.when(k == 0, F.col("path")).otherwise(F.get(F.array(*map(F.lit, PATH_SHAPES)), k - 1)).alias("path"), F.when(F.col("part") % 2 == 0, "deep").otherwise("Backend").alias("owner"))


BARE_SQL = r"regexp_replace({}, '^[_.\-]+|[_.\-]+$', '', 'g')"


def domain_stem_sql(x: str) -> str:
    a = rf"regexp_replace({x}, '^(.{{4,}})({'|'.join(D.ROLE_ENDS)})$', '\1')"
    b = rf"regexp_replace({a}, '^(.{{4,}})({'|'.join(D.VIEW_ENDS)})$', '\1')"
    return BARE_SQL.format(rf"regexp_replace({b}, '^(.{{3,}}[^su])s$', '\1')")


@query("fn15_library_stems", f"WITH {SHAPED} SELECT part AS k, {BARE_SQL.format(f'regexp_replace({STEM_SQL}, {q(f'({chr(124).join(D.VARIANT_ENDS)})+$')}, {q('')})')} AS stem FROM sp", "files")
def fn15_library(spark, d):
    return path_shapes(spark, d).select(F.col("part").alias("k"), D.library_stem(F.col("path")).alias("stem"))


@query("fn15_domain_stems", f"WITH {SHAPED} SELECT part AS k, {domain_stem_sql(STEM_SQL)} AS stem FROM sp", "files")
def fn15_domain(spark, d):
    return path_shapes(spark, d).select(F.col("part").alias("k"), D.domain_stem(D.stem(F.col("path"))).alias("stem"))


LAYERED = f"ly AS (SELECT part, owner, path, string_split(path, '/') AS ps FROM sp), li AS (SELECT *, list_min(list_filter(range(1, len(ps) + 1), lambda i: list_contains({listed(D.APP_LAYERS)}, lower(ps[i])) AND (i <= 2 OR lower(ps[i - 1]) = lower(owner)))) AS pos FROM ly), lx AS (SELECT part, CASE WHEN pos + 1 < len(ps) THEN lower(ps[pos + 1]) ELSE lower(regexp_replace(ps[pos + 1], '(.)\\.[^.]*$', '\\1')) END AS nx FROM li)"


@query("fn15_layered_domains", f"WITH {SHAPED}, {LAYERED} SELECT part AS k, nullif({domain_stem_sql('nx')}, '') AS domain FROM lx", "files")
def fn15_layered(spark, d):
    return path_shapes(spark, d).select(F.col("part").alias("k"), D.layered_domain(F.col("path"), F.col("owner")).alias("domain"))


@query("fn15_path_domains", f"WITH {SHAPED} SELECT part AS k, coalesce(list_filter(list_transform(string_split(path, '/')[1:-2], lambda v: lower(v)), lambda v: v <> '' AND NOT starts_with(v, '[') AND NOT starts_with(v, '(') AND NOT list_contains({listed(D.NO_DOMAIN)}, v))[-1], '') AS domain FROM sp", "files")
def fn15_path(spark, d):
    return path_shapes(spark, d).select(F.col("part").alias("k"), D.path_domain(F.col("path")).alias("domain"))


@query("fn32_infra_files", f"WITH {SHAPED}, x AS (SELECT part, list_transform(string_split(path, '/'), lambda v: lower(v)) AS ps FROM sp) SELECT part AS k, len(list_filter(ps[1:-2], lambda v: list_contains({listed([*D.AUXILIARY_DIRS, *D.TOOL_DIRS])}, v) OR (starts_with(v, '.') AND v <> '.github'))) > 0 OR list_contains({listed(D.CONFIG_FILES)}, ps[-1]) OR (len(ps) <= 2 AND list_contains({listed(D.CONFIG_EXTENSIONS)}, regexp_extract(ps[-1], '^.+([.][^.]+)$', 1))) AS infra FROM x", "files")
def fn32(spark, d):
    return path_shapes(spark, d).select(F.col("part").alias("k"), D.is_infra(F.col("path")).alias("infra"))


OWNERS = ("Web", "ui", "apps/studio", "Studio Dashboard", "my shell", "billing", "team/Authentication", "web/payments", "i18n ", "notifications ui")


@query("fn32_owner_kinds", f"WITH o AS (SELECT part, {listed(OWNERS)}[CAST(part % 10 AS INTEGER) + 1] AS o FROM files), l AS (SELECT part, trim(lower(o)) AS o FROM o) SELECT part AS k, list_contains({listed(D.CATCH_ALL)}, o) OR list_contains({listed(D.CATCH_ALL)}, string_split(string_split(o, '/')[-1], ' ')[-1]) AS catch_all, contains(o, 'auth') OR contains(o, 'billing') OR contains(o, 'notification') AS domain FROM l", "files")
def fn32_owners(spark, d):
    o = F.get(F.array(*map(F.lit, OWNERS)), (F.col("part") % 10).cast("int"))
    return B.files(spark, d).select(F.col("part").alias("k"), D.is_catch_all(o).alias("catch_all"), D.is_domain_target(o).alias("domain"))


OLD_NEW = "hs AS (SELECT path, part, name, CAST(substr(name, 3) AS INTEGER) AS i FROM symbols JOIN files USING (path)), os AS (SELECT path, name, 'h' || i AS hash FROM hs WHERE (part + i) % 7 <> 0), ns AS (SELECT path, name, CASE WHEN (part + i) % 5 = 0 THEN 'x' ELSE 'h' END || i AS hash FROM hs WHERE (part + i) % 11 <> 0), dl AS (SELECT coalesce(os.path, ns.path) AS path, coalesce(os.name, ns.name) AS name, CASE WHEN os.name IS NULL THEN 'added' WHEN ns.name IS NULL THEN 'removed' ELSE 'modified' END AS status FROM os FULL JOIN ns ON os.path = ns.path AND os.name = ns.name WHERE os.hash IS DISTINCT FROM ns.hash)"


def symbol_snapshots(spark, d):
    i = F.substr("name", F.lit(3)).cast("int")
    s = B.symbols(spark, d).join(B.files(spark, d).select("path", "part"), "path").withColumn("i", i).withColumn("k", F.col("part") + F.col("i"))
    now = F.concat(F.when(F.col("k") % 5 == 0, "x").otherwise("h"), F.col("i").cast("string"))
    return s.where("k % 7 <> 0").select("path", "name", F.concat(F.lit("h"), F.col("i").cast("string")).alias("hash")), s.where("k % 11 <> 0").select("path", "name", now.alias("hash"))


@query("st7_symbol_delta", f"WITH {OLD_NEW} SELECT path, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status <> 'modified') > 0 AS structural FROM dl GROUP BY 1", "symbols")
def st7(spark, d):
    return N.symbol_delta(N.symbol_changes(*symbol_snapshots(spark, d)))


@query("st7_kept_attributions", f"WITH {OLD_NEW}, a AS (SELECT flow, path, name FROM os JOIN files USING (path)) SELECT flow, count(*) FILTER (r.name IS NULL) AS kept, count(r.name) AS removed FROM a LEFT JOIN (SELECT path, name FROM dl WHERE status = 'removed') r USING (path, name) GROUP BY 1", "symbols")
def st7_kept(spark, d):
    old, new = symbol_snapshots(spark, d)
    a = old.join(B.files(spark, d).select("path", "flow"), "path")
    kept = N.kept_attributions(a, N.symbol_changes(old, new))
    n = a.groupBy("flow").agg(F.count(F.lit(1)).alias("all"))
    return n.join(kept.groupBy("flow").agg(F.count(F.lit(1)).alias("kept")), "flow", "left").select("flow", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("all") - F.coalesce("kept", F.lit(0))).alias("removed"))


NAMED = ("GET", "handleSubmit", "signupHandler", "AuthController", "createOrder", "Helper", "settings", "listUsers", "EmailSubscriber", "gettext", "POST")
ENTRIES = f"en AS (SELECT path AS file, {listed(NAMED)}[CAST((part + i) % 11 AS INTEGER) + 1] AS symbol, 1 + 5 * i AS start, 5 + 5 * i AS stop, part % 3 AS r FROM files, (SELECT unnest([0, 1, 2]) AS i)), rt AS (SELECT file, min_by(symbol, start) AS first FROM en WHERE r = 0 GROUP BY 1), an AS (SELECT rt.file, coalesce(g.symbol, first) AS symbol FROM rt LEFT JOIN (SELECT DISTINCT file, symbol FROM en WHERE symbol = 'GET') g ON g.file = rt.file), hv AS (SELECT an.file, an.symbol, 'route' AS kind, min(start) AS start FROM an JOIN en ON en.file = an.file AND en.symbol = an.symbol GROUP BY 1, 2 UNION ALL SELECT file, symbol, 'function', min(start) FROM en WHERE regexp_matches(symbol, '^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$|^handle[A-Z]|Handler$|Controller$|Subscriber$|^(create|update|delete|fetch|list|get|set|sync)[A-Z]') AND (file, symbol) NOT IN (SELECT (file, symbol) FROM an) GROUP BY 1, 2)"


def declared(spark, d):
    k = (F.col("part") + F.col("i")) % 11
    e = B.files(spark, d).select("path", "part", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return e.select(F.col("path").alias("file"), F.get(F.array(*map(F.lit, NAMED)), k.cast("int")).alias("symbol"), F.lit("function").alias("kind"), (F.col("i") * 5 + 1).alias("start"), (F.col("i") * 5 + 5).alias("stop"), F.col("part"))


@query("tx9_entry_points", f"WITH {ENTRIES} SELECT * FROM hv", "files")
def tx9(spark, d):
    s = declared(spark, d)
    routes = s.where("part % 3 = 0").select("file", F.lit("GET").alias("method"), F.lit("/x").alias("pattern")).distinct()
    return V.entry_points(s, routes).select("file", "symbol", "kind", "start")


@query("rp20_promoted_flows", f"WITH {ENTRIES}, pr AS (SELECT 'flow-' || (part % 40) AS flow, CASE WHEN part % 4 = 0 THEN 'ghost' ELSE feature END AS owner, part % 6 AS confidence, path AS file, {listed(NAMED)}[CAST((part + 1) % 11 AS INTEGER) + 1] AS symbol, part AS ord FROM files), ok AS (SELECT flow, owner, ord, file, symbol FROM pr JOIN hv USING (file, symbol) WHERE confidence >= 3 AND owner <> 'ghost' AND flow <> 'flow-7') SELECT flow, owner, file, symbol FROM ok QUALIFY ord = min(ord) OVER (PARTITION BY flow)", "files")
def rp20(spark, d):
    s = declared(spark, d)
    entries = V.entry_points(s, s.where("part % 3 = 0").select("file", F.lit("GET").alias("method"), F.lit("/x").alias("pattern")).distinct())
    f = B.files(spark, d)
    promos = f.select(F.concat(F.lit("flow-"), (F.col("part") % 40).cast("string")).alias("flow"), F.when(F.col("part") % 4 == 0, "ghost").otherwise(F.col("feature")).alias("owner"), (F.col("part") % 6).alias("confidence"), F.col("path").alias("file"), F.get(F.array(*map(F.lit, NAMED)), ((F.col("part") + 1) % 11).cast("int")).alias("symbol"), F.col("part").alias("ord"))
    return V.promoted_flows(promos, entries, f.select("feature").distinct(), spark.createDataFrame([("flow-7",)], "flow string"))


MANIFESTS = """mf AS (SELECT feature AS repo, CAST(substr(feature, 6) AS INTEGER) AS n FROM (SELECT DISTINCT feature FROM files)),
pj AS (SELECT repo, n, CASE n % 4 WHEN 0 THEN '{"main": "x.js", "private": false}' WHEN 1 THEN '{"scripts": {"dev": "next dev"}, "private": true}' WHEN 2 THEN '{"exports": {".": "./a.js"}, "scripts": {"start": "node x"}}' ELSE '' END AS c FROM mf),
pv AS (SELECT repo, 2 * CAST(n % 3 = 0 AS INTEGER) AS app, CAST(n % 3 = 1 AS INTEGER) AS lib FROM mf),
jv AS (SELECT repo, CAST(contains(c, 'next dev') AS INTEGER) AS app, CAST(contains(c, '"main"') OR contains(c, '"exports"') AS INTEGER) + CAST(contains(c, '"private": false') AS INTEGER) AS lib FROM pj),
yv AS (SELECT repo, CAST(n % 5 = 1 AS INTEGER) AS app, 2 * CAST(n % 5 = 0 AS INTEGER) AS lib FROM mf), gv AS (SELECT repo, CAST(n % 7 = 1 AS INTEGER) AS app, 2 * CAST(n % 7 = 0 AS INTEGER) AS lib FROM mf),
cv AS (SELECT repo, CAST(n % 6 = 1 AS INTEGER) AS app, 2 * CAST(n % 6 = 0 AS INTEGER) AS lib FROM mf), vt AS (SELECT * FROM pv UNION ALL SELECT * FROM jv UNION ALL SELECT * FROM yv UNION ALL SELECT * FROM gv UNION ALL SELECT * FROM cv)"""


def manifests(spark, d):
    """(repo, path, content): files that tell a library from an application, made up by the number of the feature."""
    m = B.files(spark, d).select(F.col("feature").alias("repo")).distinct().withColumn("n", F.substr("repo", F.lit(6)).cast("int"))
    n = F.col("n")

    def file(when, path, content=""):
        return F.when(when, F.struct(F.lit(path).alias("path"), F.lit(content).alias("content")))

    own = F.array_compact(F.array(
        file(n % 3 == 0, "web/next.config.js"), file(n % 3 == 1, "examples/vite.config.ts"),
        file(n % 4 == 0, "package.json", '{"main": "x.js", "private": false}'), file(n % 4 == 1, "package.json", '{"scripts": {"dev": "next dev"}, "private": true}'), file(n % 4 == 2, "package.json", '{"exports": {".": "./a.js"}, "scripts": {"start": "node x"}}'), file(n % 4 == 3, "package.json", ""),
        file(n % 5 == 0, "pyproject.toml", "[project]\nname = 'x'"), file(n % 5 == 1, "pyproject.toml", "[project.scripts]\nx = 'x:main'"),
        file(n % 7 == 0, "go.mod"), file(n % 7 == 1, "go.mod"), file(n % 7 == 1, "apps/x/main.go"),
        file(n % 6 == 0, "Cargo.toml", "[lib]\n"), file(n % 6 == 1, "Cargo.toml", "[lib]\n[[bin]]\n"),
    ))
    return m.select("repo", F.inline(own))


@query("ag28_library_votes", f"WITH {MANIFESTS} SELECT repo, sum(app)::BIGINT AS app_votes, sum(lib)::BIGINT AS lib_votes, sum(lib) > sum(app) AS is_library FROM vt GROUP BY 1", "files")
def ag28(spark, d):
    return V.library_votes(manifests(spark, d))


@query("ag28_layout", "WITH t AS (SELECT DISTINCT feature AS repo, CASE part % 4 WHEN 0 THEN ['server', 'fixtures', 'docs', '__mocks__', 'assets', 'samples'][CAST(part % 6 AS INTEGER) + 1] WHEN 1 THEN 'libs' WHEN 2 THEN split_part(path, '/', 3) ELSE 'x' || part % 8 END AS dir, feature FROM files WHERE length(feature) = 7 OR part % 4 <> 2) SELECT repo, count(*) AS dirs, round(count(*) FILTER (dir IN ('server', 'libs', 'fixtures', 'docs', '__mocks__', 'assets', 'samples')) / count(*), 6) AS ratio, CASE WHEN count(*) FILTER (dir IN ('server', 'libs', 'fixtures', 'docs', '__mocks__', 'assets', 'samples')) > 0.5 * count(*) THEN 'layer' ELSE 'feature' END AS layout FROM t GROUP BY 1", "files")
def ag28_layout(spark, d):
    k = F.col("part") % 4
    layers = F.array(*map(F.lit, ("server", "fixtures", "docs", "__mocks__", "assets", "samples")))
    top = F.when(k == 0, F.get(layers, (F.col("part") % 6).cast("int"))).when(k == 1, "libs").when(k == 2, F.split("path", "/")[2]).otherwise(F.concat(F.lit("x"), (F.col("part") % 8).cast("string")))
    f = B.files(spark, d).where("length(feature) = 7 or part % 4 <> 2")
    return V.layout(f.select(F.col("feature").alias("repo"), F.concat(top, F.lit("/"), "path").alias("path")))


@query("rp7_alias_rules", "WITH f AS (SELECT DISTINCT feature FROM files), o AS (SELECT CASE WHEN feature LIKE '%1' THEN 'core' ELSE feature END AS canonical, 'src/' || feature || '/' AS v FROM f WHERE feature <> 'brand55'), w AS (SELECT feature AS canonical FROM f WHERE feature LIKE '%2' OR feature LIKE '%1'), n AS (SELECT canonical FROM o UNION SELECT canonical FROM w) SELECT n.canonical, CASE WHEN w.canonical IS NOT NULL THEN 'workspace' ELSE 'owners' END AS source, coalesce(string_agg(v, '|' ORDER BY v), '') AS variants FROM n LEFT JOIN o USING (canonical) LEFT JOIN w ON w.canonical = n.canonical GROUP BY 1, 2", "files")
def rp7(spark, d):
    f = B.files(spark, d).select("feature").distinct()
    team = F.concat(F.lit("@org/"), F.when(F.col("feature").endswith("1"), "core").when(F.col("feature") == "brand55", "shared-infra").otherwise(F.col("feature")), F.when(F.col("feature").endswith("3"), "-team").otherwise("-squad"))
    text = f.select(F.concat(F.lit("src/"), "feature", F.lit("/   "), team, F.lit(" @other")).alias("value")).unionByName(spark.createDataFrame([("# comment",), ("",)], "value string"))
    packages = f.where("feature like '%2' or feature like '%1'").select(F.col("feature").alias("name"), F.concat(F.lit("src/"), "feature").alias("root"))
    return V.alias_rules(packages, text)
