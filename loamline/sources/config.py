"""Small files that steer a scan, read on the driver: path aliases, a repository's rules, expected results."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession

#: Where path aliases are looked for, in this order.
TSCONFIGS = ("tsconfig.json", "src/tsconfig.json", "tsconfig.base.json", "src/tsconfig.base.json")


def loads_commented(text: str) -> object:
    """JSON with comments and trailing commas. Comment marks inside strings are text."""
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept))


def path_aliases(files: dict[str, str]) -> dict[str, str]:
    """Prefix of an import -> directory from the repository's top, of the first configuration (path -> text) that names any. Broken ones are passed over."""
    for at in TSCONFIGS:
        try:
            options = loads_commented(files[at]).get("compilerOptions", {}) if at in files else {}
        except (ValueError, AttributeError):
            continue
        base = posixpath.join(posixpath.dirname(at), options.get("baseUrl", "."))
        found = {}
        for pattern, targets in options.get("paths", {}).items():
            if targets and pattern.endswith("/*"):
                found[pattern[:-1]] = posixpath.normpath(posixpath.join(base, targets[0].removesuffix("/*"))).rstrip("/") + "/"
        if found:
            return {k: "" if v == "./" else v for k, v in found.items()}
    return {}


def parsed_yaml(text: str) -> dict:
    import yaml

    data = yaml.safe_load(text)
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ValueError("the top level must be a mapping")
    return data


def _texts(values: object, what: str) -> list[str]:
    if not isinstance(values or [], list):
        raise ValueError(f"{what} must be a list")
    return [t for t in (str(v).strip() for v in values or []) if t]


def rules(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Tables of a repository's rules: `renames` (old, new, rank), new null for features to skip: forced merges come before variants of features, those before automatic ones."""
    rows: list[tuple[str, str | None, int]] = [(s, None, 0) for s in _texts(config.get("skip_features"), "skip_features")]
    merges = config.get("force_merges") or []
    if not isinstance(merges, list) or not all(isinstance(m, dict) for m in merges):
        raise ValueError("force_merges must be a list of mappings")
    for m in merges:
        into, sources = str(m.get("into") or "").strip(), _texts(m.get("from"), "from")
        if not into or not sources:
            raise ValueError("a forced merge needs `into` and `from`")
        rows += [(s, into, 1) for s in sources]
    described = []
    for rank, part in ((2, "features"), (3, "auto_aliases")):
        features = {} if config.get(part) is None else config[part]
        if not isinstance(features, dict):
            raise ValueError(f"{part} must be a mapping")
        for name, body in features.items():
            name, body = str(name).strip(), body or {}
            if not name or not isinstance(body, dict):
                raise ValueError(f"{part} needs names with mappings")
            described.append((name, str(body.get("description") or "").strip(), rank))
            rows += [(v, name, rank) for v in _texts(body.get("variants"), "variants")]
    return {"renames": spark.createDataFrame(rows, "old string, new string, rank int"), "features": spark.createDataFrame(described, "feature string, description string, rank int")}


def expected(spark: SparkSession, config: dict, kind: str = "features") -> DataFrame:
    """(name, aliases, feature, description) that a run should find: features or flows. Names must be there and differ."""
    entries = config.get(kind) or []
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError(f"{kind} must be a list of mappings")
    rows, seen = [], set()
    for e in entries:
        name = str(e.get("name") or "").strip()
        if not name or name in seen:
            raise ValueError(f"{kind}: a name is missing or repeated: {name!r}")
        seen.add(name)
        rows.append((name, _texts(e.get("aliases"), "aliases"), str(e.get("feature") or "").strip() or None, str(e.get("description") or "").strip()))
    return spark.createDataFrame(rows, "name string, aliases array<string>, feature string, description string")


def samples(spark: SparkSession, config: dict) -> DataFrame:
    """(path, expected): files whose feature is known; a path may stand there once."""
    entries = config.get("samples") or []
    rows = [(str(e.get("path") or "").strip(), str(e.get("expected") or "").strip()) for e in entries]
    if not all(p and x for p, x in rows) or len({p for p, _ in rows}) < len(rows):
        raise ValueError("samples: a path or feature is missing, or a path repeated")
    return spark.createDataFrame(rows, "path string, expected string")
