"""Commit messages as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a bug fix, and what a fix must not be about.
FIX = r"(?i)\b(?:fix|bug|hotfix|patch|revert|regression|crash|error|broken|issue|defect|resolve|timeout|null\s*(?:pointer|check|ref)|undefined|NaN|race\s*condition|deadlock|memory\s*leak|overflow)\b"
NOT_A_FIX = r"(?i)\bfix\s+(?:typo|lint|format\w*|style|import|indent|spacing|whitespace|test|spec|mock|snapshot|docs?|readme|comment|changelog|merge|conflict|rebase|ci|pipeline|build|deploy)\b"
DIGEST_FIX = r"(?i)\b(?:fix|bug|hotfix|patch|revert|regression|crash|error|broken|issue|defect)\b"
DIGEST_NOT_A_FIX = r"(?i)\bfix\s+(?:typo|lint|format\w*|style|import|indent|spacing|test|docs?|merge|ci|build)\b"
MERGE_PR = r"(?i)merge pull request #(\d+)"
SQUASH_PR = r"\(#(\d+)\)\s*(?:\n|$)"
SCOPE = r"(?i)^[a-z]+\(([a-z][a-z0-9_/-]+)\):"
BARE = r"^([a-z][a-z0-9_/-]+):"
#: Prefixes that name the kind of a commit, not a domain.
KINDS = (
    "fix", "feat", "chore", "docs", "doc", "refactor", "test", "tests", "build", "ci", "perf", "style", "revert", "wip", "deps", "dep", "security", "release", "merge", "bump",
    "update", "rename", "remove", "feature", "ref", "hotfix", "patch", "minor", "major", "tick", "readme", "license", "changelog", "deps-dev",
)


def is_bug_fix(message: Column) -> Column:
    """Any word of FIX and nothing of NOT_A_FIX in the whole message; null counts as no fix."""
    return F.coalesce(message.rlike(FIX) & ~message.rlike(NOT_A_FIX), F.lit(False))


def is_digest_bug_fix(message: Column) -> Column:
    """The shorter profile, on the first line."""
    first = F.substring_index(message, "\n", 1)
    return F.coalesce(first.rlike(DIGEST_FIX) & ~first.rlike(DIGEST_NOT_A_FIX), F.lit(False))


def pr_number(message: Column) -> Column:
    """Number of the merge form, else of the squash form at a line's end, else null."""
    found = [F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in (MERGE_PR, SQUASH_PR)]
    return F.coalesce(*found).cast("int")


def scope(message: Column) -> Column:
    """Domain that a subject line is filed under: `type(scope):`, else `scope:`; null for kinds of commits."""
    line = F.substring_index(message, "\n", 1)
    named = F.lower(F.nullif(F.regexp_extract(line, SCOPE, 1), F.lit("")))
    bare = F.nullif(F.regexp_extract(line, BARE, 1), F.lit(""))
    found = F.coalesce(named, bare)
    return F.when(found.isin(*KINDS), None).otherwise(found)
