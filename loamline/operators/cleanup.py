"""Clean-up of a feature map by names, sizes and directories. Every rule takes and returns rows (feature, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import names as N
from ..functions import paths as P
from .graph import components, cut
from .rules import disjoint_names

# Names of features and directories that the rules know.
PROTECTED = ["shared-ui", "shared-infra", "project-config"]
SYNTHETIC = ["shared-infra", "documentation", "examples"]
TECH_LAYERS = ["prisma", "drizzle", "typeorm", "knex", "sequelize", "trpc", "graphql-schema", ".yarn", ".changeset", ".claude", ".agents", ".opencode", ".devcontainer", ".snaplet", ".storybook", ".husky", "specs", "testing", "example-apps", "examples", "dayjs"]
TOOLING = ["tsconfig", "typescript-config", "eslint-config", "prettier-config", "tailwind-config", "postcss-config", "babel-config", "stylelint-config", "vitest-config", "jest-config", "playwright-config", "config-eslint", "config-typescript", "config-prettier", "config-tailwind", "tooling", "build-config"]
INFRA_DIRS = ["hooks", "utils", "helpers", "lib", "types", "config", "configs", "constants", "middleware", "providers", "contexts", "assets", "styles", "icons", "svg", "public", "static"]
NEUTRAL_DIRS = ["src", "app", "core", "packages", "apps", "web", "api"]
SHARED_DIRS = ["components", "hooks", "lib", "utils", "helpers", "types", "models", "schemas", "constants", "config", "configs", "middleware", "providers", "contexts", "store", "stores", "assets", "styles", "icons", "svg", "stories", "storybook", "__tests__", "__mocks__", "fixtures", "test"]
WRAPPER_DIRS = ["src", "app", "pages", "api", "public", "static", "dist", "build", "views", "features", "modules", "domains", "routes", "screens"]
KEPT_PREFIXES = ["app", "shared", "custom"]
PLUGIN_WORDS = ["app", "store", "plugin", "connector", "integration"]
SHARED_UI = ["/components/ui/", "/ui/hooks/", "/ui/@types/"]
DOMAIN_UI = ["/views/", "/features/", "/pages/", "/screens/"]


def _kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1-$2"))


def _dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def _business_dirs(path: Column) -> Column:
    """Directories that are neither wrappers nor shared, in order."""
    return F.filter(_dirs(path), lambda s: ~F.lower(s).isin(*WRAPPER_DIRS, *SHARED_DIRS))


def _moved(files: DataFrame, to: DataFrame) -> DataFrame:
    """files with the features that `to` (feature, target) names renamed."""
    return files.join(to, "feature", "left").select(F.coalesce("target", "feature").alias("feature"), "path")


def _sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("feature").agg(F.count(F.lit(1)).alias("size"))


def folded_layers(files: DataFrame) -> DataFrame:
    """Features called like a technical layer go to shared-infra."""
    return files.select(F.when(F.lower("feature").isin(*TECH_LAYERS), "shared-infra").otherwise(F.col("feature")).alias("feature"), "path")


def folded_tooling(files: DataFrame) -> DataFrame:
    """Features whose last segment is a tooling package go to shared-infra, where paths are distinct then."""
    last = F.lower(F.substring_index("feature", "/", -1))
    moved = files.select(F.when(last.isin(*TOOLING), "shared-infra").otherwise(F.col("feature")).alias("feature"), "path")
    return moved.where("feature <> 'shared-infra'").unionByName(moved.where("feature = 'shared-infra'").distinct())


def folded_infra(files: DataFrame) -> DataFrame:
    """Features with all files in infrastructure directories go to shared-infra."""
    business = F.exists(_dirs(F.col("path")), lambda s: ~F.lower(s).isin(*INFRA_DIRS, *NEUTRAL_DIRS))
    bare = files.where(~F.col("feature").isin(*PROTECTED)).groupBy("feature").agg(F.bool_or(business).alias("any")).where(~F.col("any"))
    return _moved(files, bare.select("feature", F.lit("shared-infra").alias("target")))


def same_names(files: DataFrame) -> DataFrame:
    """Features that share their last segment, whatever its case, are one: that of most paths, the first by name of equals. If no two of them share a path, they are told apart by the first directory in which they differ instead. Synthetic features stay as they are."""
    own = files.distinct()
    free = own.where(~F.col("feature").isin(*SYNTHETIC)).withColumn("name", F.substring_index(F.lower(F.trim("feature")), "/", -1))
    size = free.groupBy("name", "feature").agg(F.count(F.lit(1)).alias("size"))
    many = size.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min_by("feature", F.struct(-F.col("size"), "feature")).alias("best")).where("n > 1").select("name", "best")
    met = free.join(many, "name")
    common = met.groupBy("name", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name").distinct()
    merged = met.join(common, "name", "left_semi").select("feature", F.col("best").alias("target")).distinct()
    apart = met.join(common, "name", "left_anti")
    told = disjoint_names(apart.select("name", F.col("feature").alias("part"), "path")).select(F.col("part").alias("feature"), F.col("renamed").alias("target"))
    taken = own.select(F.col("feature").alias("target")).distinct()
    told = told.join(taken, "target", "left_anti").select("feature", "target")
    return _moved(own, merged.unionByName(told)).distinct()


def named_without_numbers(files: DataFrame) -> DataFrame:
    """Features that end in -number lose it: their files go to prefix-directory by the deepest business directory that isn't the prefix.

    A new name is an existing feature's if that has it, or else the first by name that shares two of its
    words (or its only word). Existing features are those without a number; new names don't attract others.
    """
    numbered = files.where(F.col("feature").rlike(r"-\d+$"))
    prefix = F.regexp_replace("feature", r"-\d+$", "")
    own = F.filter(_business_dirs(F.col("path")), lambda s: _kebab(s) != F.lower(prefix))
    name = F.when(F.size(own) > 0, F.concat_ws("-", F.when(prefix != "", prefix), _kebab(F.element_at(own, -1)))).otherwise(F.when(prefix != "", prefix).otherwise(F.col("feature")))
    rows = numbered.withColumn("name", name)
    word = lambda c: F.array_remove(F.array_distinct(F.split(c, "-")), "")
    new = rows.select("name").distinct().withColumn("words", word(F.col("name")))
    old = files.where(~F.col("feature").rlike(r"-\d+$")).select(F.col("feature").alias("known")).distinct()
    shared = new.select("name", F.size("words").alias("n"), F.explode("words").alias("w")).join(old.select("known", F.explode(word(F.col("known"))).alias("w")), "w").groupBy("name", "n", "known").agg(F.count(F.lit(1)).alias("shared"))
    near = shared.where("known = name or shared >= 2 or shared = n and n = 1").groupBy("name").agg(F.min_by("known", F.struct(F.col("known") != F.col("name"), "known")).alias("known"))
    moved = rows.join(near, "name", "left").select(F.coalesce("known", "name").alias("feature"), "path")
    return files.where(~F.col("feature").rlike(r"-\d+$")).select("feature", "path").unionByName(moved)


def merged_siblings(files: DataFrame, *, least: int = 2) -> DataFrame:
    """Features with a common prefix of words are one, called like the shortest prefix that at least `least` names go on from. Prefixes of one letter and a few general ones don't count.

    A prefix that isn't merged at its shortest can't be merged later, as its names only grow fewer; so one round does.
    """
    names = files.select("feature").distinct()
    parts = F.split("feature", "-")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))
    each = names.where(F.size(parts) > 1).select("feature", F.explode(prefix).alias("prefix")).where((F.length("prefix") >= 2) & ~F.lower("prefix").isin(*KEPT_PREFIXES))
    many = each.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("prefix")
    return _moved(files, each.join(many, "prefix").groupBy("feature").agg(F.min_by("prefix", F.length("prefix")).alias("target")))


def merged_by_directory(files: DataFrame, *, share: float = 0.5) -> DataFrame:
    """Features that have most of their files (`share` of them) below one and the same first business directory are one: that called like the directory, else that of most files (the first by name of equals)."""
    own = files.select("feature", F.get(_business_dirs(F.col("path")), F.lit(0)).alias("dir"))
    n = own.groupBy("feature", "dir").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("feature").agg(F.sum("n").alias("size"), F.min_by(F.when(F.col("dir").isNotNull(), F.struct("dir", "n")), F.struct(F.col("dir").isNull(), -F.col("n"), "dir")).alias("top"))
    main = top.where("top is not null").select("feature", "size", "top.*").where(F.col("n") >= F.col("size") * share)
    named = (F.col("feature") == _kebab(F.col("dir"))) | (F.col("feature") == F.lower("dir"))
    best = main.groupBy("dir").agg(F.count(F.lit(1)).alias("features"), F.min_by("feature", F.struct(~named, -F.col("size"), "feature")).alias("target")).where("features > 1")
    return _moved(files, main.join(best, "dir").select("feature", "target"))


def absorbed_tiny(files: DataFrame, *, least: int = 5) -> DataFrame:
    """Features of at most max(2, a tenth of the median size) files go to the larger feature with most words in common, ten points a word and one for each of up to 50 files (the first by name of equals), or to shared-infra if none has any. Maps of fewer than `least` features stay."""
    size = _sizes(files)
    counts = size.where(~F.col("feature").isin(*PROTECTED)).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.select("size", F.sum("n").over(W.orderBy("size")).alias("upto"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("all"))  # one row for each size
    bound = upto.where((F.col("all") >= least) & (F.col("upto") > F.floor(F.col("all") / 2))).agg(F.min("size").alias("median")).select(F.greatest(F.lit(2), F.floor(F.col("median") / 10)).alias("bound")).where("bound is not null")
    judged = size.crossJoin(F.broadcast(upto.agg(F.max("all").alias("all")))).crossJoin(F.broadcast(bound)).where(F.col("all") >= least)
    tiny = judged.where((F.col("size") <= F.col("bound")) & ~F.col("feature").isin(*PROTECTED)).select("feature")
    large = size.join(tiny, "feature", "left_anti")
    word = lambda c: F.array_remove(F.array_distinct(F.split(c, "[-_]")), "")
    open_to = large.where(~F.col("feature").isin(*PROTECTED)).select(F.col("feature").alias("known"), "size", F.explode(word(F.col("feature"))).alias("w"))
    score = (F.count(F.lit(1)) * 10 + F.least(F.first("size"), F.lit(50))).alias("score")
    met = tiny.select("feature", F.explode(word(F.col("feature"))).alias("w")).join(open_to, "w").groupBy("feature", "known").agg(score)
    to = met.groupBy("feature").agg(F.min_by("known", F.struct(-F.col("score"), "known")).alias("known"))
    any_large = large.limit(1).select(F.lit(True).alias("any"))
    targets = tiny.join(to, "feature", "left").crossJoin(F.broadcast(any_large)).select("feature", F.coalesce("known", F.lit("shared-infra")).alias("target"))
    return _moved(files, targets)


def collapsed_plugins(files: DataFrame, *, siblings: int = 8, most: int = 8, gate: int = 20) -> DataFrame:
    """Where at least `siblings` features of at most `most` files each lie two levels below one directory, they are one feature called like its last business directory, or integrations if that says store, plugin and the like. Maps of fewer than `gate` features stay."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), "/")).when(F.size(parts) == 2, F.get(parts, F.lit(0)))
    one = files.groupBy("feature").agg(F.count(F.lit(1)).alias("size"), F.min(above).alias("low"), F.max(above).alias("high"))
    near = one.where((F.col("size") <= most) & (F.col("low") == F.col("high"))).select("feature", F.col("low").alias("above"))
    many = near.groupBy("above").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= siblings)
    own = F.filter(F.split("above", "/"), lambda s: ~F.lower(s).isin(*WRAPPER_DIRS, *SHARED_DIRS))
    last = _kebab(F.element_at(own, -1))
    name = F.when((F.size(own) == 0) | last.rlike("|".join(PLUGIN_WORDS)), "integrations").otherwise(last)
    enough = one.agg(F.count(F.lit(1)).alias("features")).where(F.col("features") >= gate)
    return _moved(files, near.join(many, "above").crossJoin(F.broadcast(enough)).select("feature", name.alias("target")))


def extracted_ui(files: DataFrame) -> DataFrame:
    """Files of shared UI directories go to shared-ui, unless they lie below a view, page, screen or feature; paths there are distinct."""
    path = F.col("path")
    before = F.when(F.contains(path, F.lit(SHARED_UI[0])), F.substring_index(path, SHARED_UI[0], 1)).when(F.contains(path, F.lit(SHARED_UI[1])), F.substring_index(path, SHARED_UI[1], 1)).otherwise("")
    shared = path.rlike("|".join(SHARED_UI)) & ~before.rlike("|".join(DOMAIN_UI))
    moved = files.select(F.when(shared, "shared-ui").otherwise(F.col("feature")).alias("feature"), "path")
    return moved.where("feature <> 'shared-ui'").unionByName(moved.where("feature = 'shared-ui'").distinct())


def final_clean_up(files: DataFrame) -> DataFrame:
    """The rules in their order: layers, numbers, prefixes, tiny features, infrastructure. Each rule reads its input several times, so its rows are written once."""
    for rule in (folded_layers, named_without_numbers, merged_siblings, absorbed_tiny, folded_infra):
        files = cut(rule(files))
    return files


def second_look(flows: DataFrame, features: DataFrame, *, apart: float = 0.30, catch_all: float = 0.15, stake: float = 0.05) -> DataFrame:
    """(flow, owner, other, own_share, other_share): flows to be judged again, as another feature has a larger share of their files, by `apart` and more.

    `catch_all` is enough if a catch-all owner stands against a domain with a share of `stake` and more.
    flows: (flow, owner, path), of two paths and more; features: (feature, path), a path counted for each that has it.
    """
    own = flows.select("flow", "owner", "path").distinct()
    size = own.groupBy("flow", "owner").agg(F.count(F.lit(1)).alias("paths")).where("paths > 1")
    n = own.join(features.select("feature", "path").distinct(), "path").groupBy("flow", "owner", "feature").agg(F.count(F.lit(1)).alias("n"))
    at_home = F.col("feature") == F.col("owner")
    met = n.groupBy("flow", "owner").agg(F.max(F.when(at_home, F.col("n"))).alias("mine"), F.min(F.when(~at_home, F.struct((-F.col("n")).alias("n"), "feature"))).alias("best"))
    shares = size.join(met, ["flow", "owner"]).where("best is not null").select("flow", "owner", F.col("best.feature").alias("other"), (F.coalesce("mine", F.lit(0)) / F.col("paths")).alias("own_share"), (-F.col("best.n") / F.col("paths")).alias("other_share"))
    low = D.is_catch_all(F.col("owner")) & D.is_domain_target(F.col("other")) & (F.col("other_share") >= stake)
    return shares.where(F.col("other_share") - F.col("own_share") >= F.when(low, catch_all).otherwise(apart))


def import_groups(kept: DataFrame, files: DataFrame, *, absolute: int = 300, floor: int = 20, part: int = 4) -> DataFrame:
    """(path, root): components over `kept` import edges (src, dst), single files included. Groups over min(absolute, max(floor, files / part)) are split by business domain; parts of equal domain are one, so no file is lost."""
    all_files = files.select("path").distinct()
    root = components(kept, "src", "dst")
    own = all_files.join(root.select(F.col("node").alias("path"), "root"), "path", "left").select("path", F.coalesce("root", "path").alias("root"))
    most = own.agg(F.least(F.lit(absolute), F.greatest(F.lit(floor), F.floor(F.count(F.lit(1)) / part))).alias("most"))
    large = own.groupBy("root").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(most)).where("n > most").select("root", F.lit(True).alias("large"))
    met = own.join(large, "root", "left")
    return met.select("path", F.when(F.col("large"), P.domain_key(F.col("path"))).otherwise(F.col("root")).alias("root"))


def finalised(groups: DataFrame, segment: Column) -> DataFrame:
    """(name, path): groups (path, root) of two and more are named for their most frequent segment, with -2, -3 and so on for further groups of a name; a single file joins the last group, by name, that has files in its directory, or else the bucket of its segment."""
    own = groups.select("path", "root", segment.alias("segment"), P.parent(F.col("path")).alias("dir"))
    size = own.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    counted = own.groupBy("root", "segment").agg(F.count(F.lit(1)).alias("n"))
    modal = counted.groupBy("root").agg(F.min_by("segment", F.struct(-F.col("n"), "segment")).alias("modal"), F.sum("n").alias("size")).where("size > 1")
    i = F.row_number().over(W.partitionBy("modal").orderBy("root"))
    names = modal.select("root", "modal", i.alias("i")).select("root", "modal", F.when(F.col("i") == 1, F.col("modal")).otherwise(F.concat_ws("-", "modal", "i")).alias("name"))
    many = own.join(names, "root").select("name", "path", "dir")
    single = own.join(size.where("size = 1").select("root"), "root", "left_semi")
    near = many.groupBy("dir").agg(F.max("name").alias("near"))
    used = names.groupBy(F.col("modal").alias("segment")).agg(F.count(F.lit(1)).alias("used"))
    bucket = F.when(F.col("used").isNull(), F.col("segment")).otherwise(F.concat_ws("-", "segment", F.col("used") + 1))
    rest = single.join(near, "dir", "left").join(used, "segment", "left").select(F.coalesce("near", bucket).alias("name"), "path")
    return many.select("name", "path").unionByName(rest)


def queued(events: DataFrame, *, every: str = "60 seconds", most: int = 5000, batch: int = 200, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """events with the flush (`window` start) and batch they leave in: a queue holds `most` events until it is flushed, so the newest beyond that are dropped, which is what the bound is for."""
    flush = F.window(F.col(ts), every)["start"]
    i = F.row_number().over(W.partitionBy("flush").orderBy(ts, key)) - 1
    return events.withColumn("flush", flush).withColumn("place", i).where(F.col("place") < most).withColumn("batch", F.floor(F.col("place") / batch)).drop("place")


def configured(files: DataFrame, renames: DataFrame, features: DataFrame) -> DataFrame:
    """Rows (feature, path), distinct, as a repository's rules (see sources.config.rules) want them: forced merges, variants, automatic variants, features below a configured one folded into it, the token match, and skips last.

    Each kind of rename takes one step; of several for a name the first by name counts. A feature that is not
    configured takes a configured name under the same parent if the words of one are all among the other's
    and no feature has that name; the first configured name that matches decides, and of several features
    that match it the first by name takes it.
    """
    for rank in (1, 2, 3):
        step = renames.where((F.col("rank") == rank) & F.col("new").isNotNull()).groupBy(F.col("old").alias("feature")).agg(F.min("new").alias("target"))
        files = _moved(files, step)
    known = features.select("feature").distinct()
    top = known.where(~F.contains("feature", F.lit("/"))).select(F.col("feature").alias("top"))
    child = files.select("feature").distinct().where(F.contains("feature", F.lit("/"))).withColumn("top", F.substring_index("feature", "/", 1))
    files = cut(_moved(files, child.join(top, "top").select("feature", F.col("top").alias("target"))).distinct())

    def worded(names: DataFrame, name: str, words: str) -> DataFrame:
        split = F.contains("feature", F.lit("/"))
        tail = F.when(split, F.regexp_replace("feature", "^[^/]*/", "")).otherwise(F.col("feature"))
        rows = names.select(F.col("feature").alias(name), F.when(split, F.concat(F.lit("/"), F.substring_index("feature", "/", 1))).otherwise("").alias("parent"), N.name_tokens(tail).alias(words))
        return rows.withColumn("w", F.explode(words))

    names = files.select("feature").distinct()
    met = worded(names.join(known, "feature", "left_anti"), "variant", "vw").join(worded(known, "name", "nw"), ["parent", "w"])
    close = met.where((F.size(F.array_except("vw", "nw")) == 0) | (F.size(F.array_except("nw", "vw")) == 0)).groupBy("variant").agg(F.min("name").alias("name"))
    free = close.join(names.select(F.col("feature").alias("name")), "name", "left_anti").groupBy(F.col("name").alias("target")).agg(F.min("variant").alias("feature"))
    skipped = renames.where("new is null").select(F.col("old").alias("feature")).distinct()
    return _moved(files, free).join(skipped, "feature", "left_anti")


# Verbs of flows.
CRUD_VERBS = ["create", "add", "new", "update", "edit", "patch", "modify", "delete", "remove", "destroy"]


def clean_flows(flows: DataFrame, files: DataFrame, *, most_domains: int = 2, least_files: int = 3) -> DataFrame:
    """Rows (feature, flow, path) without flows named for techniques or files, without flows of one verb over more than `most_domains` domains, and each flow at one feature only: that which has most of its files, the smaller of equals, then the first by name."""
    own = flows.select("feature", "flow", "path").distinct().where(~N.is_technical_flow(F.col("flow")) & ~N.is_filename_flow(F.col("flow")))
    words = F.split(F.regexp_replace(F.replace(F.lower("flow"), F.lit("-flow"), F.lit("")), "^-+|-+$", ""), "-")
    verb = (F.size(words) > 1) & F.get(words, F.lit(0)).isin(*CRUD_VERBS)
    domain = F.nullif(D.path_domain(F.col("path")), F.lit(""))
    wide = own.where(verb).groupBy("feature", "flow").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(domain).alias("domains")).where((F.col("n") >= least_files) & (F.col("domains") > most_domains))
    left = own.join(wide.select("feature", "flow"), ["feature", "flow"], "left_anti")
    has = files.select("feature", "path").distinct().withColumn("has", F.lit(1))
    overlap = left.join(has, ["feature", "path"], "left").groupBy("flow", "feature").agg(F.count("has").alias("overlap"))
    ranked = overlap.join(_sizes(files.select("feature", "path").distinct()), "feature", "left")
    won = ranked.groupBy("flow").agg(F.min_by("feature", F.struct(-F.col("overlap"), F.coalesce("size", F.lit(0)), "feature")).alias("feature"))
    return left.join(won, ["flow", "feature"], "left_semi").select("feature", "flow", "path")


def without_singletons(files: DataFrame, flows: DataFrame) -> DataFrame:
    """General names become shared-infra, and features of one file without a flow go there."""
    own = files.select(P.canonical_bucket(F.col("feature")).alias("feature"), "path")
    single = _sizes(own).where("size = 1 and feature <> 'shared-infra'").select("feature").join(flows.select("feature").distinct(), "feature", "left_anti")
    return _moved(own, single.withColumn("target", F.lit("shared-infra")))


def applied_delta(files: DataFrame, matched: DataFrame, deleted: DataFrame) -> DataFrame:
    """A map after a change: files matched to a feature (feature, path) are put in where the feature exists, deleted ones (path) are left out."""
    new = matched.select("feature", "path").join(files.select("feature").distinct(), "feature", "left_semi")
    return files.select("feature", "path").unionByName(new).join(deleted.select("path").distinct(), "path", "left_anti").select("feature", "path")


# Words of file names that tell nothing of a domain.
NOISE_ENDINGS = ["dto", "dtos", "type", "types", "schema", "schemas", "interface", "interfaces", "model", "models", "contract", "contracts", "request", "response", "config", "constants", "props", "spec", "test", "stories", "fixture", "fixtures", "mock", "mocks", "index", "main", "init", "common", "util", "utils", "helper", "helpers"]
NOISE_WORDS = ["the", "a", "an", "of", "to", "for", "with", "from", "and", "or", "is", "in", "on", "by"]
DEVELOPER_BUCKET = "developer-infrastructure"
# Names of features that are test infrastructure.
TEST_FEATURES = ["test", "tests", "__tests__", "testing", "testutils", "e2e", "e2e-tests", "integration-tests", "unit-tests", "spec", "specs", "fixtures", "__fixtures__", "mocks", "__mocks__", "__snapshots__", "vitest-mocks", "jest-mocks", "cypress", "playwright"]


def file_words(path: Column) -> Column:
    """Words of a file's name and its directory, of three letters and more, without those that tell nothing."""
    stem = F.regexp_replace(P.file_name(path), r"(?<=.)\.[^.]*$", "")
    end = F.lower(F.regexp_extract(stem, r"\.([^.]*)$", 1))
    stem = F.when(end.isin(*NOISE_ENDINGS), F.regexp_replace(stem, r"\.[^.]*$", "")).otherwise(stem)
    parts = F.split(F.regexp_replace(stem, "(?<=[a-z])(?=[A-Z])", " "), r"[\s\-_/]+")
    parent = F.regexp_extract(path, "(?:^|/)([^/]+)/[^/]*$", 1)
    words = F.transform(F.concat(parts, F.array(parent)), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*NOISE_ENDINGS, *NOISE_WORDS)))


def _pieces(word: Column, least: Column) -> Column:
    """All distinct parts of a word that have `least` letters and more."""
    n = F.length(word)
    starts = F.sequence(F.lit(1), n)
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.sequence(F.lit(1), n), lambda k: (k >= least) & (i + k <= n + 1)), lambda k: F.substring(word, i, k)))))


def consumers(files: DataFrame, edges: DataFrame, shared: str) -> DataFrame:
    """(path, consumer, how): for each file of the feature `shared` the features whose files import it; where none does, those whose name holds a word of four letters and more of the file's name, or lies in one.

    Words and names meet by their parts as equal keys, so no word is held against every name. files: (feature, path).
    """
    own = files.where(F.col("feature") == shared).select("path").distinct()
    src = files.where(F.col("feature") != shared).select(F.col("path").alias("src"), F.col("feature").alias("consumer"))
    told = edges.join(own.select(F.col("path").alias("dst")), "dst").join(src, "src").select(F.col("dst").alias("path"), "consumer").distinct()
    words = own.join(told.select("path").distinct(), "path", "left_anti").select("path", F.explode(file_words(F.col("path"))).alias("word")).where(F.length("word") >= 4)
    names = files.select(F.col("feature").alias("consumer")).distinct().where(F.col("consumer") != shared).withColumn("name", F.regexp_replace(F.lower("consumer"), "[^a-z0-9]", "")).where("name <> ''")
    inside = words.join(names.select("consumer", F.explode(_pieces(F.col("name"), F.lit(4))).alias("word")), "word").select("path", "consumer")
    around = words.select("path", F.explode(_pieces(F.col("word"), F.lit(1))).alias("name")).join(names, "name").select("path", "consumer")
    return told.withColumn("how", F.lit("import")).unionByName(inside.unionByName(around).distinct().withColumn("how", F.lit("name")))


def classified(files: DataFrame, verdicts: DataFrame, used: DataFrame, commits: DataFrame, *, least_confidence: int = 4, most_files: int = 50, most_commits: int = 200, locked_from: int = 30) -> DataFrame:
    """Rows (feature, path, origin) after verdicts (feature, kind, confidence, proposed) on what features are.

    Files of a shared-aggregator go to all their consumers (used: path, consumer), with their former feature as
    origin, or to shared-infra without any. A developer-internal feature takes its proposed name if that
    is sure and free, or else goes to developer infrastructure; tooling-infra goes to shared-infra; both
    only up to `most_files` files and `most_commits` commits (commits: feature, commits). A product-feature takes its
    proposed name. The largest feature, if it has `locked_from` files, is never folded. Of several features for a name the first takes it.
    """
    own = files.select("feature", "path").distinct()
    size = _sizes(own)
    largest = size.agg(F.min_by(F.struct("feature", "size"), F.struct(-F.col("size"), "feature")).alias("b")).select("b.*").where(F.col("size") >= locked_from).select("feature", F.lit(True).alias("locked"))
    v = verdicts.groupBy("feature").agg(F.max_by(F.struct("kind", "confidence", "proposed"), F.struct("confidence", "kind")).alias("v")).select("feature", "v.*")
    judged = v.join(size, "feature").join(F.broadcast(largest), "feature", "left").join(commits.select("feature", "commits"), "feature", "left")  # `largest` is one row
    sure, open_ = F.col("confidence") >= least_confidence, F.col("locked").isNull()
    small = open_ & (F.col("size") <= most_files) & (F.coalesce("commits", F.lit(0)) <= most_commits)
    step = F.when((F.col("kind") == "shared-aggregator") & sure & open_, "spread").when((F.col("kind") == "developer-internal") & small, "developer").when((F.col("kind") == "tooling-infra") & sure & small, "tooling").when((F.col("kind") == "product-feature") & sure, "rename")
    judged = judged.select("feature", step.alias("step"), F.when(sure & (F.col("proposed") != F.col("feature")), F.col("proposed")).alias("proposed")).where("step is not null")
    wish = judged.where("proposed is not null and step in ('developer', 'rename')").join(size.select(F.col("feature").alias("proposed")), "proposed", "left_anti")
    named = wish.groupBy(F.col("proposed").alias("target")).agg(F.min(F.struct(F.col("step") != "developer", "feature")).alias("f")).select(F.col("f.feature").alias("feature"), "target")
    met = own.join(judged.select("feature", "step"), "feature", "left").join(named, "feature", "left")
    to = F.coalesce("target", F.when(F.col("step") == "developer", DEVELOPER_BUCKET).when(F.col("step") == "tooling", "shared-infra").otherwise(F.col("feature")))
    kept = met.where("step is null or step <> 'spread'").select(to.alias("feature"), "path", F.lit(None).cast("string").alias("origin"))
    spread = met.where("step = 'spread'").join(used.select("path", "consumer").distinct(), "path", "left")
    return kept.unionByName(spread.select(F.coalesce("consumer", F.lit("shared-infra")).alias("feature"), "path", F.when(F.col("consumer").isNotNull(), F.col("feature")).alias("origin"))).distinct()


def with_orphans(files: DataFrame, source: DataFrame) -> DataFrame:
    """files and, under shared-infra, those of `source` (path) that no feature has."""
    rest = source.select("path").distinct().join(files.select("path").distinct(), "path", "left_anti")
    return files.select("feature", "path").unionByName(rest.select(F.lit("shared-infra").alias("feature"), "path"))


def unattached(entries: DataFrame, attributed: DataFrame) -> DataFrame:
    """Entry points (file, symbol, ..) that are in no flow; attributed: (file, symbol)."""
    return entries.join(attributed.select("file", "symbol").distinct(), ["file", "symbol"], "left_anti")


def without_ghosts(flows: DataFrame, touched: DataFrame) -> DataFrame:
    """flows (flow, ..) that a commit touched; touched: (flow, ..)."""
    return flows.join(touched.select("flow").distinct(), "flow", "left_semi")


def clean_inputs(files: DataFrame) -> DataFrame:
    """Rows (feature, path) without test files and test features, with documentation in one feature."""
    doc = P.is_documentation(F.col("path"))
    kept = files.where(~F.lower(F.trim("feature")).isin(*TEST_FEATURES) & ~doc & ~P.is_test_path_segments(F.col("path"))).select("feature", "path")
    return kept.unionByName(files.where(doc).select(F.lit("documentation").alias("feature"), "path").distinct())


def promoted_roots(files: DataFrame) -> DataFrame:
    """Files of root and init, which catch all of a library, under a feature for each stem."""
    stem = F.coalesce(F.nullif(D.library_stem(F.col("path")), F.lit("")), F.col("feature"))
    return files.select(F.when(F.col("feature").isin("root", "init"), stem).otherwise(F.col("feature")).alias("feature"), "path")


#: For each verb in order: words of file names, methods of routes, starts of exported names, and parts of flow names that cover it.
# What tells of each verb.
CRUD = {
    "delete": (["delete", "remove", "destroy"], r"(?i)\bDELETE\b", "^(?:delete|remove|destroy)[A-Z_]|^use(?:Delete|Remove|Destroy)", "delete|remove|destroy"),
    "create": (["create", "add", "new"], r"(?i)\bPOST\b", "^(?:create|add)[A-Z_]|^use(?:Create|Add)", "create|add|new"),
    "update": (["edit", "update", "patch"], r"(?i)\b(?:PUT|PATCH)\b", "^(?:edit|update|patch)[A-Z_]|^use(?:Edit|Update|Patch)", "edit|update|modify"),
}


def crud_gaps(files: DataFrame, flows: DataFrame, signatures: DataFrame) -> DataFrame:
    """Rows (feature, flow, path) of flows for delete, create and update that a feature lacks, from the names, routes and exports of files that no flow has; a file goes to the first verb that fits.

    A verb is not lacking if a flow of the feature, also one just put in, has one of its words in its name.
    files: (feature, path); flows: (feature, flow, path); signatures: (path, routes, exports), arrays of texts.
    """
    stem = F.regexp_replace(P.file_name(F.col("path")), r"(?<=.)\.[^.]*$", "")
    words = F.split(F.lower(F.regexp_replace(stem, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "-")), r"[._\-\s]+")
    base = F.regexp_replace(F.lower(F.trim("feature")), "[_ ]", "-")
    ies, plural = base.endswith("ies") & (F.length(base) > 3), base.endswith("s") & ~base.endswith("ss") & (F.length(base) > 2)
    noun = F.when(F.contains(base, F.lit("-")), base).when(ies, F.regexp_replace(base, "ies$", "y")).when(plural, F.regexp_replace(base, "s$", "")).otherwise(base)
    signed = signatures.groupBy("path").agg(F.array_join(F.flatten(F.collect_list("routes")), " ").alias("routes"), F.flatten(F.collect_list("exports")).alias("exports"))
    known = flows.select("feature", "flow", "path")
    free = files.select("feature", "path").distinct().join(known.select("feature", "path").distinct(), ["feature", "path"], "left_anti").join(signed, "path", "left")
    free = cut(free.select("feature", "path", noun.alias("noun"), words.alias("words"), F.coalesce("routes", F.lit("")).alias("routes"), F.coalesce("exports", F.array().cast("array<string>")).alias("exports")))
    names, found = known.select("feature", "flow").distinct(), None
    for verb, (own, method, start, hints) in CRUD.items():
        fits = F.arrays_overlap("words", F.array(*map(F.lit, own))) | F.col("routes").rlike(method) | F.array_join("exports", "\n").rlike(f"(?m){start}")
        covered = names.where(F.lower("flow").rlike(hints)).select("feature").distinct()
        new = cut(free.where(fits).join(covered, "feature", "left_anti").select("feature", F.concat(F.lit(f"{verb}-"), "noun", F.lit("-flow")).alias("flow"), "path"))
        names = names.unionByName(new.select("feature", "flow").distinct())
        free = free.join(new.select("feature", "path"), ["feature", "path"], "left_anti")
        found = new if found is None else found.unionByName(new)
    return found
