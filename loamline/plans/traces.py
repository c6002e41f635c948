"""Traces of flows with symbols, tests of symbols, shared files by symbol."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import lines as L
from ..operators import trace as T
from ..sources import bridge as B
from .more import LAYER
from .registry import query

NAMES = "array_to_string(list_transform(list_sort(list(DISTINCT {'s': start, 'n': name, 'e': stop})), lambda x: x.n), '|')"


def walked(seeds: str, depth: int, most: int) -> str:
    """Relations w (seed, path, depth), the first `most` files of each seed, and g (seed, path), those that are followed."""
    return f"""r(seed, path, depth) AS (SELECT seed, path, 0 FROM {seeds} UNION SELECT seed, dst, depth + 1 FROM r JOIN symbol_edges ON src = path WHERE depth < {depth}),
m AS (SELECT seed, path, min(depth) AS depth FROM r GROUP BY 1, 2), w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, path) <= {most}),
z AS (SELECT seed, depth, sum(count(*)) OVER (PARTITION BY seed ORDER BY depth) AS n FROM m GROUP BY 1, 2), g AS (SELECT seed, path FROM w JOIN z USING (seed, depth) WHERE depth < {depth} AND n < {most})"""


def touches(entries: str) -> str:
    """Relation t (seed, path, depth, symbols, side_effect) from w and g."""
    return f"""u AS (SELECT DISTINCT g.seed, dst AS path, symbol FROM g JOIN symbol_edges ON src = g.path AND dst <> src SEMI JOIN w ON w.seed = g.seed AND w.path = dst),
att AS (SELECT seed, e.path, min_by({{'s': start, 'n': name, 'e': stop}}, (stop - start, start, name)) AS x FROM {entries} e JOIN ranges USING (path) WHERE line BETWEEN start AND stop GROUP BY 1, 2),
s AS (SELECT seed, path, name, start, stop FROM u JOIN ranges USING (path) WHERE symbol IN ('*', name) UNION SELECT seed, path, x.n, x.s, x.e FROM att),
ns AS (SELECT seed, path, {NAMES} AS symbols FROM s GROUP BY 1, 2), se AS (SELECT seed, path, bool_and(symbol = '@import') AS side FROM u GROUP BY 1, 2),
t AS (SELECT seed, path, depth, coalesce(symbols, '') AS symbols, depth > 0 AND coalesce(side, false) AS side_effect FROM w LEFT JOIN ns USING (seed, path) LEFT JOIN se USING (seed, path))"""


@query("gr5_flow_traces", f"WITH en AS (SELECT path AS seed, path, CAST(part % 40 AS INTEGER) AS line FROM files WHERE part % 97 = 0), {walked('en', 3, 60)}, {touches('en')} SELECT seed, path, depth, symbols, side_effect FROM t", "ranges symbol_edges", recursive=True)
def gr5_traces(spark, d):
    """Traces with symbols from every 97th file, an input that stands for flows' entries; at most 60 files each."""
    entries = B.files(spark, d).where("part % 97 = 0").select(F.col("path").alias("seed"), "path", (F.col("part") % 40).cast("int").alias("line"))
    ranges = L.symbol_ranges(B.symbols(spark, d))
    return T.traced(B.symbol_edges(spark, d), ranges, ranges, entries, most=60)


FLOWS = """f0 AS (SELECT flow, feature AS owner, min(path) AS path, min(part) AS k FROM files GROUP BY 1, 2),
fl AS (SELECT replace(flow, '-', '-for-') AS flow, owner, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) || '/main.rs' ELSE path END AS entry_file, CAST(CASE WHEN k % 5 > 0 THEN k % 30 END AS INTEGER) AS entry_line FROM f0)"""
TOKENS = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda v: v <> ''))"


@query("gr6_flow_traces", f"""WITH {FLOWS}, en AS (SELECT {{'owner': owner, 'flow': flow}} AS seed, entry_file AS path, coalesce(entry_line, 0) AS line FROM fl WHERE entry_file IS NOT NULL), {walked('en', 3, 200)}, {touches('(SELECT * FROM en WHERE line > 0)')},
alone AS (SELECT seed, min(path) AS entry FROM t GROUP BY 1 HAVING count(*) = 1), d AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
near AS (SELECT seed, d.path FROM alone JOIN d ON d.dir = regexp_extract(entry, '^(.*)/[^/]*$', 1) AND d.path <> entry QUALIFY row_number() OVER (PARTITION BY seed ORDER BY d.path) <= 8),
wf AS (SELECT flow, owner, list_filter({TOKENS.format('flow')}, lambda v: v NOT IN ('flow', 'for')) AS ws FROM fl WHERE entry_file IS NULL), wp AS (SELECT feature AS owner, path, {TOKENS.format("regexp_replace(split_part(path, '/', -1), '(.)[.][^.]*$', '\\1')")} AS st, {TOKENS.format("regexp_extract(path, '^(.*)/[^/]*$', 1)")} AS dr FROM files),
sc AS (SELECT flow, owner, path, row_number() OVER (PARTITION BY flow, owner ORDER BY 2 * len(list_intersect(ws, st)) + len(list_intersect(ws, dr)) DESC, path) AS i FROM wf JOIN wp USING (owner) WHERE 2 * len(list_intersect(ws, st)) + len(list_intersect(ws, dr)) > 0 QUALIFY i <= 8),
every AS (SELECT seed.owner AS owner, seed.flow AS flow, path, depth, symbols, side_effect FROM t UNION ALL SELECT seed.owner, seed.flow, path, 1, '', true FROM near UNION ALL SELECT owner, flow, path, CASE WHEN i = 1 THEN 0 ELSE 1 END, '', false FROM sc)
SELECT owner, flow, path, depth, symbols, side_effect, coalesce({LAYER}, 'support') AS layer FROM every""", "ranges symbol_edges", recursive=True)
def gr6_traces(spark, d):
    """All flows: traced from an entry, with neighbours of an entry that imports nothing (a quarter), or by words of their names without one (a quarter)."""
    f = B.files(spark, d).groupBy("flow", F.col("feature").alias("owner")).agg(F.min("path").alias("path"), F.min("part").alias("k"))
    alone = F.concat(P.parent(F.col("path")), F.lit("/main.rs"))
    entry = F.when(F.col("k") % 4 == 1, alone).when(F.col("k") % 4 > 1, F.col("path"))
    flows = f.select(F.replace("flow", F.lit("-"), F.lit("-for-")).alias("flow"), "owner", entry.alias("entry_file"), F.when(F.col("k") % 5 > 0, F.col("k") % 30).cast("int").alias("entry_line"))
    ranges = L.symbol_ranges(B.symbols(spark, d))
    return T.traced_flows(flows, B.files(spark, d).select(F.col("feature").alias("owner"), "path"), B.symbol_edges(spark, d), ranges, ranges)


TESTED = """af AS (SELECT path, part FROM files UNION ALL SELECT replace(replace(path, '/tests/', CASE part % 4 WHEN 0 THEN '/' WHEN 1 THEN '/src/' ELSE '/far/away/' END), '.test.', CASE WHEN part % 4 = 3 THEN '_x.' ELSE '.' END), part FROM files WHERE path LIKE '%/tests/%' AND part % 3 = 0),
us AS (SELECT src AS test, dst AS path, symbol FROM symbol_edges JOIN files ON path = src WHERE src LIKE '%/tests/%' AND dst NOT LIKE '%/tests/%' AND part % 3 > 0),
ex AS (SELECT path, name FROM ranges JOIN files USING (path) WHERE part % 5 > 0),
im AS (SELECT DISTINCT test, us.path, CASE WHEN symbol IN ('*', '@import') THEN name ELSE symbol END AS symbol FROM us LEFT JOIN ex ON ex.path = us.path AND symbol IN ('*', '@import')),
rest AS (SELECT path AS test, part FROM files WHERE path LIKE '%/tests/%' AND path NOT IN (SELECT test FROM im)),
nm AS (SELECT test, af.path FROM rest JOIN af ON af.part = rest.part AND af.path <> test AND af.path NOT LIKE '%\\_x.%' ESCAPE '\\'),
tm AS (SELECT path, symbol, test, 'import' AS how FROM im UNION ALL SELECT path, NULL, test, 'name' FROM nm UNION ALL SELECT path, name, test, 'name' FROM nm JOIN ex USING (path))"""


def tested(spark, d):
    """Symbol tests where every third test imports nothing and has a file of its name (but for a quarter of them), and every fifth file exports nothing."""
    f = B.files(spark, d)
    own = f.where("path like '%/tests/%' and part % 3 = 0")
    k = F.col("part") % 4
    moved = F.replace(F.replace("path", F.lit("/tests/"), F.when(k == 0, "/").when(k == 1, "/src/").otherwise("/far/away/")), F.lit(".test."), F.when(k == 3, "_x.").otherwise("."))
    edges = B.symbol_edges(spark, d).join(f.where("path not like '%/tests/%' or part % 3 > 0").select(F.col("path").alias("src")), "src")
    exports = L.symbol_ranges(B.symbols(spark, d)).join(f.where("part % 5 > 0").select("path"), "path")
    return T.symbol_tests(f.select("path").unionByName(own.select(moved.alias("path"))), edges, exports)


@query("ag29_symbol_tests", f"WITH {TESTED} SELECT path, symbol, test, how FROM tm UNION ALL SELECT NULL, NULL, test, 'unmapped' FROM rest WHERE test NOT IN (SELECT test FROM nm)", "ranges symbol_edges")
def ag29_symbols(spark, d):
    return tested(spark, d)


ATTRIBUTED = "att AS (SELECT DISTINCT feature, flow || CAST(substr(name, 3) AS INTEGER) % 2 AS flow, path, name FROM (SELECT f.feature, f.flow, r.path, r.name FROM files f JOIN ranges r ON r.path = f.path UNION SELECT f.feature, f.flow, dst, symbol FROM symbol_edges JOIN files f ON f.path = src WHERE symbol IN ('fn1', 'fn2', 'fn4')))"


def attributed(spark, d):
    """(feature, flow, path, name): two flows for each, with symbols of their files by number, and what those import by name."""
    f = B.files(spark, d).select("feature", "flow", "path")
    own = f.join(L.symbol_ranges(B.symbols(spark, d)), "path").select("feature", "flow", "path", "name")
    used = B.symbol_edges(spark, d).where("symbol in ('fn1', 'fn2', 'fn4')").join(f.withColumnRenamed("path", "src"), "src").select("feature", "flow", F.col("dst").alias("path"), F.col("symbol").alias("name"))
    return own.unionByName(used).withColumn("flow", F.concat("flow", (F.substr("name", F.lit(3)).cast("int") % 2).cast("string"))).distinct()


@query("ag29_flow_tests", f"WITH {TESTED}, {ATTRIBUTED} SELECT feature, flow, count(DISTINCT test) AS tests FROM (SELECT feature, flow, test FROM att JOIN tm ON tm.path = att.path AND symbol = name UNION SELECT feature, flow, test FROM att JOIN tm USING (path) WHERE symbol IS NULL) GROUP BY 1, 2", "ranges symbol_edges")
def ag29_flows(spark, d):
    return T.flow_tests(attributed(spark, d), tested(spark, d)).groupBy("feature", "flow").agg(F.count(F.lit(1)).alias("tests"))


@query("gr8_shared_with", f"WITH {ATTRIBUTED}, o AS (SELECT DISTINCT a.feature, a.flow, a.path, b.flow AS other FROM att a JOIN att b ON b.feature = a.feature AND b.path = a.path AND b.name = a.name AND b.flow <> a.flow) SELECT feature, flow, path, string_agg(other, '|' ORDER BY other) AS others FROM o GROUP BY 1, 2, 3", "ranges symbol_edges")
def gr8_shared_with(spark, d):
    return T.shared_with(attributed(spark, d))


@query("gr8_shared_symbols", """WITH ff AS (SELECT feature, path FROM files UNION SELECT 'brand' || (part % 5 + 1) || (part % 3 + 1), path FROM files WHERE part % 4 = 0), sh AS (SELECT path FROM ff GROUP BY 1 HAVING count(*) > 1), pr AS (SELECT * FROM ff SEMI JOIN sh USING (path)),
us AS (SELECT DISTINCT ff.feature, dst AS path, symbol FROM symbol_edges JOIN ff ON ff.path = src SEMI JOIN pr ON pr.path = dst AND pr.feature = ff.feature), ask AS (SELECT * FROM us UNION ALL SELECT feature, path, '*' FROM pr ANTI JOIN us USING (feature, path)),
got AS (SELECT DISTINCT feature, path, name, start, stop FROM ask JOIN ranges USING (path) WHERE symbol IN ('*', name)), ln AS (SELECT DISTINCT feature, path, unnest(range(start, stop + 1)) AS line FROM got)
SELECT feature, path, string_agg(DISTINCT name, '|' ORDER BY name) AS symbols, (SELECT count(*) FROM ln WHERE ln.feature = got.feature AND ln.path = got.path) AS lines FROM got GROUP BY 1, 2""", "ranges symbol_edges")
def gr8_shared_symbols(spark, d):
    """Every fourth file is of a second feature too."""
    f = B.files(spark, d)
    also = f.where("part % 4 = 0").select(F.concat(F.lit("brand"), (F.col("part") % 5 + 1).cast("string"), (F.col("part") % 3 + 1).cast("string")).alias("feature"), "path")
    return T.shared_symbols(f.select("feature", "path").unionByName(also), B.symbol_edges(spark, d), L.symbol_ranges(B.symbols(spark, d)))
