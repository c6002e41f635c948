"""Traces of flows through imports with the symbols that each import touches, and what follows from the same edges: tests of symbols, shared files.

Edges are (src, dst, symbol). A symbol is the name of an export, `*` or `@http` (all exports of the target)
or `@import` (loaded for its side effects, no symbol). Exports are (path, name, start, stop).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from .graph import cut, kept, sized
from .lines import innermost, merged_ranges
from .lookups import name_matches

ALL = ("*", "@http")
SIDE_EFFECT = "@import"
# Names of test files by language, with the extensions of what they may test.
TEST_NAMES = (
    (r"^(.+?)\.(?:test|spec|e2e)\.tsx?$", (".ts", ".tsx")), (r"^(.+?)\.(?:test|spec|e2e)\.js$", (".js", ".jsx", ".mjs")), (r"^(.+?)\.(?:test|spec|e2e)\.jsx$", (".js", ".jsx")), (r"^(.+?)\.(?:test|spec|e2e)\.mjs$", (".mjs", ".js")),
    (r"^test_(.+?)\.py$", (".py",)), (r"^(.+?)_test\.py$", (".py",)), (r"^(.+?)_test\.go$", (".go",)), (r"^(.+?)\.rs$", (".rs",)),
)
TEST_DIRS = ("/tests/", "/__tests__/", "/test/", "/spec/")


def walk(edges: DataFrame, seeds: DataFrame, *, depth: int = 3, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(seed, path, depth) of files within `depth` imports of each seed, and (seed, path) of those whose imports were followed.

    A level is taken by name up to the `most` files that a seed may have; a seed that is full goes no
    further, so a hub that all seeds meet isn't expanded for each of them. Edges are read for each level, and the
    files that a level follows go to them while they are few. seeds: (seed, path), of any type.
    """
    steps = edges.where("src <> dst").select("src", "dst")
    level = cut(seeds.select("seed", "path").distinct())
    found, followed, room = level.withColumn("depth", F.lit(0)), None, level.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    for d in range(1, depth + 1):
        open_ = sized(level.join(room.where(F.col("n") < most), "seed").select("seed", "path", "n"))
        followed = open_.select("seed", "path") if followed is None else followed.unionByName(open_.select("seed", "path"))
        met = open_.join(steps, open_["path"] == steps["src"]).select("seed", F.col("dst").alias("path"), "n").distinct().join(found.select("seed", "path"), ["seed", "path"], "left_anti")
        place = F.row_number().over(W.partitionBy("seed").orderBy("path"))
        # the fixed bound lets every task keep `most` files of a seed before the shuffle
        level = cut(met.withColumn("place", place).where(F.col("place") <= most).where("place + n <= " + str(most)).select("seed", "path"))
        found = found.unionByName(level.withColumn("depth", F.lit(d)))
        room = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    return found, followed


def touched(edges: DataFrame, exports: DataFrame, keys: list[str], all_: tuple[str, ...] = ALL) -> DataFrame:
    """(keys, dst, name, start, stop): the exports that edges (keys, dst, symbol) touch; names that the target doesn't export touch none."""
    e = exports.select(F.col("path").alias("dst"), "name", "start", "stop")
    named = edges.where(~F.col("symbol").isin(*all_)).join(e, (edges["dst"] == e["dst"]) & (F.col("symbol") == F.col("name"))).drop(e["dst"])
    every = edges.where(F.col("symbol").isin(*all_)).select(*keys, "dst").distinct().join(e, "dst")
    return named.select(*keys, "dst", "name", "start", "stop").unionByName(every.select(*keys, "dst", "name", "start", "stop")).distinct()


def _joined(names: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(names), lambda x: x["name"]), "|")


def traced(edges: DataFrame, exports: DataFrame, ranges: DataFrame, entries: DataFrame, *, depth: int = 3, most: int = 200) -> DataFrame:
    """(seed, path, depth, symbols, side_effect): a flow's files with the symbols that it touches there, in order of their lines.

    entries: (seed, path, line); the symbol around the line (of `ranges`, the smallest) is what the flow
    touches in its own file, with what other files import from there. side_effect: every import of the file
    was for its side effects only.
    """
    edges = kept(edges.select("src", "dst", "symbol"))
    found, followed = walk(edges, entries, depth=depth, most=most)
    found, followed = cut(found), sized(followed)
    used = followed.join(edges.where("src <> dst"), followed["path"] == edges["src"]).select("seed", "dst", "symbol").distinct()
    used = cut(used.join(found.select("seed", F.col("path").alias("dst")).hint("merge"), ["seed", "dst"], "left_semi"))
    near = sized(found.select("path").distinct())
    exports, ranges = (cut(x.select("path", "name", "start", "stop").join(near, "path", "left_semi")).hint("merge") for x in (exports, ranges))
    lines = entries.where("line > 0").select("seed", "path", "line")
    at = innermost(lines, ranges).join(lines, ["path", "line"]).join(ranges.select("path", "name", "start", "stop"), ["path", "name"]).select("seed", F.col("path").alias("dst"), "name", "start", "stop")
    names = touched(used, exports, ["seed"]).unionByName(at).distinct().groupBy("seed", F.col("dst").alias("path")).agg(_joined(F.collect_list(F.struct("start", "name", "stop"))).alias("symbols"))
    real = used.groupBy("seed", F.col("dst").alias("path")).agg(F.bool_and(F.col("symbol") == SIDE_EFFECT).alias("side"))
    met = found.join(names.hint("merge"), ["seed", "path"], "left").join(real.hint("merge"), ["seed", "path"], "left")
    side = F.when(F.col("depth") == 0, False).otherwise(F.coalesce("side", F.lit(False)))
    return met.select("seed", "path", "depth", F.coalesce("symbols", F.lit("")).alias("symbols"), side.alias("side_effect"))


def directory_neighbours(files: DataFrame, most: int = 8) -> DataFrame:
    """(dir, neighbour, place): the first files of each directory, one more than `most`, as a file is no neighbour of its own."""
    own = files.select("path", P.parent(F.col("path")).alias("dir")).where("dir not in ('', '.')").distinct()
    return own.withColumn("place", F.row_number().over(W.partitionBy("dir").orderBy("path"))).where(F.col("place") <= most + 1).select("dir", F.col("path").alias("neighbour"), "place")


def traced_flows(flows: DataFrame, files: DataFrame, edges: DataFrame, exports: DataFrame, ranges: DataFrame, *, depth: int = 3, most: int = 200, extra: int = 8) -> DataFrame:
    """(owner, flow, path, depth, layer, symbols, side_effect): every flow's trace.

    A flow with an entry is traced from there; if that finds nothing else, the first `extra` other files of
    the entry's directory stand beside it, as if loaded for side effects. A flow without an entry has the
    `extra` files of its owner that share most words with its name. flows: (flow, owner, entry_file,
    entry_line), entry_file null without an entry; files: (owner, path).
    """
    seed = F.struct("owner", "flow")
    entries = flows.where("entry_file is not null").select(seed.alias("seed"), F.col("entry_file").alias("path"), F.coalesce("entry_line", F.lit(0)).alias("line"))
    walked = cut(traced(edges, exports, ranges, entries, depth=depth, most=most))
    alone = walked.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("entry")).where("n = 1")
    near = alone.withColumn("dir", P.parent(F.col("entry"))).join(directory_neighbours(files, extra), "dir").where("neighbour <> entry")
    near = near.withColumn("i", F.row_number().over(W.partitionBy("seed").orderBy("place"))).where(F.col("i") <= extra)  # of nine rows at most
    named = name_matches(flows.where("entry_file is null").select("flow", "owner"), files, most=extra)
    first = F.row_number().over(W.partitionBy("owner", "flow").orderBy(F.desc("score"), "path")) == 1
    rows = walked.select("seed.owner", "seed.flow", "path", "depth", "symbols", "side_effect")
    rows = rows.unionByName(near.select("seed.owner", "seed.flow", F.col("neighbour").alias("path"), F.lit(1).alias("depth"), F.lit("").alias("symbols"), F.lit(True).alias("side_effect")))
    rows = rows.unionByName(named.select("owner", "flow", "path", F.when(first, 0).otherwise(1).alias("depth"), F.lit("").alias("symbols"), F.lit(False).alias("side_effect")))
    return rows.withColumn("layer", F.coalesce(P.layer(F.col("path")), F.lit("support")))


def named_targets(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(test, target): the file that a test of that name most likely covers: beside it, in `src` in place of its tests directory, at the crate's root (Rust), else the first file anywhere of that name. tests: (test); sources: (path)."""
    name, none = P.file_name(F.col("test")), F.lit(None).cast("struct<base:string,exts:array<string>>")
    told = F.coalesce(*[F.when(name.rlike(p), F.struct(F.regexp_extract(name, p, 1).alias("base"), F.array(*map(F.lit, exts)).alias("exts"))) for p, exts in TEST_NAMES], none)
    t = tests.select("test", told.alias("x")).where("x is not null").select("test", "x.base", F.posexplode("x.exts").alias("i", "ext"))
    file = F.concat("base", "ext")

    def beside(folder: Column) -> Column:
        return F.when(folder.isin("", "."), file).otherwise(F.concat(folder, F.lit("/"), file))

    moved = [F.struct(F.lit(k + 1).alias("rank"), F.when(F.contains("test", F.lit(d)), beside(P.parent(F.replace("test", F.lit(d), F.lit("/src/"))))).alias("path")) for k, d in enumerate(TEST_DIRS)]
    root = F.struct(F.lit(len(TEST_DIRS) + 1).alias("rank"), F.when(F.col("test").endswith(".rs") & F.col("test").rlike("(?:^|/)tests/"), F.concat(F.lit("src/"), file)).alias("path"))
    tried = t.select("test", "i", F.inline(F.array(F.struct(F.lit(0).alias("rank"), beside(P.parent(F.col("test"))).alias("path")), *moved, root)))
    exact = tried.where("path is not null").join(sources.select("path").distinct(), "path").groupBy("test").agg(F.min_by("path", F.struct("rank", "i")).alias("target"))
    by_name = sources.groupBy(P.file_name(F.col("path")).alias("file")).agg(F.min("path").alias("path"))
    left = t.join(exact, "test", "left_anti").withColumn("file", file).join(by_name, "file").groupBy("test").agg(F.min_by("path", "i").alias("target"))
    return exact.unionByName(left)


def symbol_tests(files: DataFrame, edges: DataFrame, exports: DataFrame) -> DataFrame:
    """(path, symbol, test, how): what tests exercise, by their imports (`import`), else by their names (`name`); symbol is null where a whole file is all that is known. Tests that cover nothing have path null (`unmapped`).

    Importing `*` or for side effects covers every export, or the file where it has none; a name counts
    whether or not the file exports it.
    """
    test = P.is_test_path_regex(F.col("path"))
    tests, sources = files.where(test).select(F.col("path").alias("test")).distinct(), cut(files.where(~test).select("path").distinct())
    use = edges.join(tests, edges["src"] == tests["test"]).select("test", F.col("dst").alias("path"), "symbol").distinct().join(sources, "path")
    wide = F.col("symbol").isin("*", SIDE_EFFECT)
    names = exports.select("path", "name").distinct()
    every = use.where(wide).select("test", "path").distinct().join(names, "path", "left").select("test", "path", F.col("name").alias("symbol"))
    by_import = cut(use.where(~wide).select("test", "path", "symbol").unionByName(every).distinct().withColumn("how", F.lit("import")))
    target = cut(named_targets(tests.join(by_import.select("test").distinct(), "test", "left_anti"), sources)).select("test", F.col("target").alias("path"))
    by_name = target.withColumn("symbol", F.lit(None).cast("string")).unionByName(target.join(names, "path").select("test", "path", F.col("name").alias("symbol"))).withColumn("how", F.lit("name"))
    known = by_import.unionByName(by_name)
    rest = tests.join(known.select("test").distinct(), "test", "left_anti").select("test", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("symbol"), F.lit("unmapped").alias("how"))
    return known.unionByName(rest).select("path", "symbol", "test", "how")


def flow_tests(attributions: DataFrame, tests: DataFrame) -> DataFrame:
    """(feature, flow, test): tests of a flow's symbols, and of the files that they stand in where tests know no more. attributions: (feature, flow, path, name)."""
    by_symbol = attributions.join(tests.where("symbol is not null").select("path", F.col("symbol").alias("name"), "test"), ["path", "name"])
    by_file = attributions.select("feature", "flow", "path").distinct().join(tests.where("symbol is null and path is not null").select("path", "test"), "path")
    return by_symbol.select("feature", "flow", "test").unionByName(by_file.select("feature", "flow", "test")).distinct()


def shared_with(attributions: DataFrame) -> DataFrame:
    """(feature, flow, path, others): for each file of a flow the feature's other flows that touch one of the same symbols there.

    A symbol's flows are gathered once for each feature, which bounds the list; files then join those lists,
    so flows are not paired with each other. Files of flows without others are left out.
    """
    held = attributions.select("feature", "flow", "path", "name").distinct()
    flows = held.groupBy("feature", "path", "name").agg(F.collect_set("flow").alias("flows")).where("size(flows) > 1")
    met = held.join(flows, ["feature", "path", "name"]).groupBy("feature", "flow", "path").agg(F.array_distinct(F.flatten(F.collect_set("flows"))).alias("all"))
    return met.select("feature", "flow", "path", F.array_join(F.array_sort(F.array_remove("all", F.col("flow"))), "|").alias("others"))


def shared_symbols(feature_files: DataFrame, edges: DataFrame, exports: DataFrame) -> DataFrame:
    """(feature, path, symbols, lines): for files of two features and more what of them each feature's own files import, and how many lines that is.

    `*` means all symbols, and so does a shared file that none of the feature's files imports; names that the file lacks count for nothing. feature_files: (feature, path).
    """
    own = feature_files.select("feature", "path").distinct()
    shared = own.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path")
    pairs = cut(own.join(shared, "path"))
    e = edges.select("src", F.col("dst").alias("path"), "symbol").where("src <> path").join(shared, "path", "left_semi")
    use = e.join(own.withColumnRenamed("path", "src"), "src").select("feature", "path", "symbol").distinct().join(pairs, ["feature", "path"], "left_semi")
    none = pairs.join(use.select("feature", "path").distinct(), ["feature", "path"], "left_anti").withColumn("symbol", F.lit("*"))
    asked = cut(use.unionByName(none)).withColumnRenamed("path", "dst")
    got = touched(asked.select("feature", "dst", "symbol"), exports, ["feature"], ("*",)).withColumnRenamed("dst", "path")
    lines = merged_ranges(got.select("feature", "path", "start", "stop"), ["feature", "path"]).groupBy("feature", "path").agg(F.sum(F.expr("stop - start + 1")).cast("long").alias("lines"))
    names = got.groupBy("feature", "path").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("symbols"))
    return names.join(lines, ["feature", "path"]).select("feature", "path", "symbols", "lines")
