"""The scalar rules as functions of SQL, made of the same native expressions; no Python runs when they are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import commits as C
from . import domains as D
from . import names as N
from . import paths as P

#: Name in SQL, rule, arguments. All arguments are strings; rules with lambdas have no form in SQL text.
FUNCTIONS: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "is_bug_fix": (C.is_bug_fix, ("message",)), "is_digest_bug_fix": (C.is_digest_bug_fix, ("message",)), "pr_number": (C.pr_number, ("message",)), "commit_scope": (C.scope, ("message",)),
    "parent_dir": (P.parent, ("path",)), "is_test_path": (P.is_test_path_regex, ("path",)), "file_bucket": (P.bucket, ("path",)), "file_layer": (P.layer, ("path",)), "content_layer": (P.content_layer, ("content",)),
    "file_route": (P.file_route, ("path",)), "url_path": (P.url_path, ("url",)), "api_pattern": (P.api_pattern, ("path",)), "remote_url": (P.remote_url, ("url",)), "normal_stem": (P.normal_stem, ("stem",)), "app_route": (P.app_route, ("path",)),
    "library_stem": (D.library_stem, ("path",)), "domain_stem": (D.domain_stem, ("stem",)), "team_name": (D.team_name, ("owner",)), "is_catch_all": (D.is_catch_all, ("owner",)), "is_domain_target": (D.is_domain_target, ("name",)),
    "flow_domain": (N.flow_domain, ("flow",)), "is_filename_flow": (N.is_filename_flow, ("flow",)), "is_technical_flow": (N.is_technical_flow, ("flow",)), "is_marketing_flow": (N.is_marketing_flow, ("flow",)),
}


def register_udfs(spark: SparkSession) -> list[str]:
    """Makes FUNCTIONS known to this session's SQL as temporary functions and returns their names."""
    for name, (rule, arguments) in FUNCTIONS.items():
        empty = spark.range(0).select(*[F.lit("").alias(a) for a in arguments])
        made = empty.select(rule(*map(F.col, arguments)).alias("v"))
        body = made._jdf.queryExecution().analyzed().expressions().head().child().sql()
        given = ", ".join(f"{a} STRING" for a in arguments)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {made.schema['v'].dataType.simpleString()} RETURN {body}")
    return list(FUNCTIONS)
