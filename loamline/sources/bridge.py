"""Code-history relations over the star-schema tables, so that every operator runs at any scale.

Parts are files, orders commits, order lines the files that a commit touches. `SQL` holds the same
definitions as common table expressions for an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commits as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, part, feature, flow): a tenth of the parts are test files."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    feature = F.lower(F.regexp_replace("p_brand", "#", ""))
    kind = F.lower("p_type")
    base = F.concat(F.lit("src/"), feature, F.lit("/"), kind, F.lit("/"))
    name = F.concat(F.element_at(F.split("p_name", " "), -1), F.lit("_"), F.col("p_partkey").cast("string"))
    ext = F.element_at(F.array(F.lit(".ts"), F.lit(".tsx"), F.lit(".py"), F.lit(".go")), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.when(F.col("p_size") % 10 == 0, F.concat(base, F.lit("tests/"), name, F.lit(".test.ts"))).otherwise(F.concat(base, name, ext))
    return p.select(path.alias("path"), F.col("p_partkey").alias("part"), feature.alias("feature"), F.concat(feature, F.lit("-"), kind).alias("flow"))


def feature_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, path, part) with gaps, so that some commits resolve by directory only."""
    return files(spark, sf_dir).where("part % 17 <> 0").select("feature", "path", "part")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, author, ts, message, is_bug_fix, pr_number)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k, level = (F.col("o_orderkey") % 1000).cast("string"), F.substring("o_orderpriority", 1, 1)
    message = (
        F.when(level == "1", F.concat(F.lit("fix: crash in module (#"), k, F.lit(")")))
        .when(level == "2", F.concat(F.lit("Merge pull request #"), k, F.lit(" from x/revert-y\nrevert: z")))
        .when(level == "3", F.lit("fix typo in docs"))
        .when(level == "4", F.concat(F.lit("feat(scope"), (F.col("o_orderkey") % 7).cast("string"), F.lit("): add (#"), k, F.lit(")")))
        .otherwise(F.lit("chore: bump"))
    )
    rows = o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(F.col("o_orderkey").alias("sha"), F.col("c_mktsegment").alias("author"), F.col("o_orderdate").alias("ts"), message.alias("message"))
    return rows.withColumn("is_bug_fix", C.is_bug_fix(F.col("message"))).withColumn("pr_number", C.pr_number(F.col("message")))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, path), distinct."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("part")).distinct()
    return lines.join(files(spark, sf_dir).select("part", "path"), "part").select("sha", "path")


def as_of(history: DataFrame) -> DataFrame:
    """One row: the time that ages are counted to."""
    return history.agg(F.max("ts").alias("as_of"))


def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, sha): the last commit of each line."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("line"), "l_shipdate", "l_orderkey")
    last = l.groupBy("part", "line").agg(F.max(F.struct("l_shipdate", "l_orderkey"))["l_orderkey"].alias("sha"))
    return last.join(files(spark, sf_dir).select("part", "path"), "part").select("path", "line", "sha")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, name, start): up to five declarations of each file."""
    p = files(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_size").hint("merge"), "part")
    i = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return p.select("path", "p_size", i.alias("i")).select("path", F.concat(F.lit("fn"), F.col("i").cast("string")).alias("name"), (F.lit(1) + F.col("i") * (F.col("p_size") % 7 + 3)).cast("int").alias("start"))


def coverage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, hits)."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("line"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("hit"))
    return l.groupBy("part", "line").agg(F.max("hit").alias("hits")).join(files(spark, sf_dir).select("part", "path").hint("merge"), "part").select("path", "line", "hits")


def edge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_partkey, to), distinct: parts of consecutive lines of all orders."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    nxt = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to"))
    return l.join(nxt, ["l_orderkey", "l_linenumber"]).where("l_partkey <> to").select("l_partkey", "to").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): imports, from files of consecutive lines of all orders. Files meet them by key, as they grow with the parts."""
    pairs, f = edge_parts(spark, sf_dir), files(spark, sf_dir).select("part", "path").hint("merge")
    return pairs.join(f.select(F.col("part").alias("l_partkey"), F.col("path").alias("src")), "l_partkey").join(f.select(F.col("part").alias("to"), F.col("path").alias("dst")), "to").select("src", "dst")


def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, symbol): the edges with what they import: all, nothing, or one of six names, of which files declare five."""
    number = lambda c: F.regexp_extract(c, r"_(\d+)\.", 1).cast("long")
    k = (number("src") * 3 + number("dst")) % 8
    return edges(spark, sf_dir).select("src", "dst", F.when(k == 0, "*").when(k == 1, "@import").otherwise(F.concat(F.lit("fn"), (k - 2).cast("string"))).alias("symbol"))


#: The same relations for an independent SQL engine.
SQL = {
    "files": """SELECT p_partkey AS part, lower(replace(p_brand, '#', '')) AS feature, lower(replace(p_brand, '#', '')) || '-' || lower(p_type) AS flow,
  'src/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '/' || CASE WHEN p_size % 10 = 0 THEN 'tests/' ELSE '' END || split_part(p_name, ' ', -1) || '_' || p_partkey
  || CASE WHEN p_size % 10 = 0 THEN '.test.ts' ELSE CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.py' ELSE '.go' END END AS path FROM part""",
    "feature_files": "SELECT feature, path, part FROM files WHERE part % 17 <> 0",
    "commits": r"""SELECT sha, author, ts, message, regexp_matches(message, '(?i)\b(fix|bug|hotfix|patch|revert|regression|crash|error|broken|issue|defect|resolve|timeout|undefined|nan|deadlock|overflow)\b') AND NOT regexp_matches(message, '(?i)\bfix\s+(typo|lint|docs?|test|ci|build)\b') AS is_bug_fix,
  CAST(coalesce(nullif(regexp_extract(message, '(?i)merge pull request #(\d+)', 1), ''), nullif(regexp_extract(message, '\(#(\d+)\)\s*(\n|$)', 1), '')) AS INTEGER) AS pr_number
  FROM (SELECT o_orderkey AS sha, c_mktsegment AS author, o_orderdate AS ts, CASE o_orderpriority[1]
  WHEN '1' THEN 'fix: crash in module (#' || o_orderkey % 1000 || ')' WHEN '2' THEN 'Merge pull request #' || o_orderkey % 1000 || ' from x/revert-y' || chr(10) || 'revert: z'
  WHEN '3' THEN 'fix typo in docs' WHEN '4' THEN 'feat(scope' || o_orderkey % 7 || '): add (#' || o_orderkey % 1000 || ')' ELSE 'chore: bump' END AS message FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""",
    "commit_files": "SELECT DISTINCT l_orderkey AS sha, path FROM lineitem JOIN files ON part = l_partkey",
    "blame_lines": "SELECT path, line, sha FROM (SELECT l_partkey, CAST(l_quantity AS INTEGER) AS line, max_by(l_orderkey, (l_shipdate, l_orderkey)) AS sha FROM lineitem GROUP BY 1, 2) JOIN files ON part = l_partkey",
    "symbols": "SELECT path, 'fn' || i AS name, CAST(1 + i * (p_size % 7 + 3) AS INTEGER) AS start FROM files JOIN part ON p_partkey = part, (SELECT unnest([0, 1, 2, 3, 4]) AS i)",
    "ranges": "SELECT path, name, start, greatest(start, coalesce(lead(start) OVER (PARTITION BY path ORDER BY start) - 1, 50)) AS stop FROM symbols",
    "coverage_lines": "SELECT path, line, hits FROM (SELECT l_partkey, CAST(l_quantity AS INTEGER) AS line, max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS hits FROM lineitem GROUP BY 1, 2) JOIN files ON part = l_partkey",
    "edges": "SELECT DISTINCT a.path AS src, b.path AS dst FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 JOIN files a ON a.part = x.l_partkey JOIN files b ON b.part = y.l_partkey WHERE x.l_partkey <> y.l_partkey",
    "symbol_edges": "SELECT src, dst, CASE k WHEN 0 THEN '*' WHEN 1 THEN '@import' ELSE 'fn' || (k - 2) END AS symbol FROM (SELECT src, dst, (3 * a.part + b.part) % 8 AS k FROM edges JOIN files a ON a.path = src JOIN files b ON b.path = dst)",
    "clock": "SELECT max(ts) AS as_of FROM commits",
}
_NEEDS = {"feature_files": ("files",), "commit_files": ("files",), "blame_lines": ("files",), "symbols": ("files",), "ranges": ("files", "symbols"), "coverage_lines": ("files",), "edges": ("files",), "symbol_edges": ("files", "edges"), "clock": ("commits",)}


def with_relations(names: str, body: str, recursive: bool = False) -> str:
    """`body` with the named relations, and those they need, in front."""
    wanted: list[str] = []
    for n in names.split():
        for m in (*_NEEDS.get(n, ()), n):
            if m not in wanted:
                wanted.append(m)
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}, {body[5:]}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"
