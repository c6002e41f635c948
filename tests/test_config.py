"""Steering files."""

import pytest
from loamline.operators import evaluation as E
from loamline.operators import rules as R
from loamline.sources import config as C


def test_commented_json_with_trailing_commas():
    assert C.loads_commented('{ // note\n "a": "http://x//y", /* b */ "c": [1, 2,], "d": "/* no */ , }",\n}') == {"a": "http://x//y", "c": [1, 2], "d": "/* no */ , }"}


def test_aliases_of_the_first_configuration_that_names_any():
    files = {"tsconfig.json": '{"compilerOptions": {"paths": {}}}', "src/tsconfig.json": "{broken", "tsconfig.base.json": '{"compilerOptions": {"baseUrl": "./web", "paths": {"@/*": ["./src/*", "./x/*"], "~lib/*": ["../lib/*"], "exact": ["a"], "none/*": []}}}'}
    assert C.path_aliases(files) == {"@/": "web/src/", "~lib/": "lib/"}
    assert C.path_aliases({}) == {} and C.path_aliases({"tsconfig.json": '{"compilerOptions": {"paths": {"#/*": ["./*"]}}}'}) == {"#/": ""}


def test_rules_become_renames(spark):
    pytest.importorskip("yaml")
    text = "features:\n  billing: {description: Money, variants: [payments, ' invoices ']}\nskip_features: [junk]\nforce_merges:\n  - {into: core, from: [a, b]}\nauto_aliases:\n  auth:\n"
    tables = C.rules(spark, C.parsed_yaml(text))
    assert sorted((r.old, r.new, r.rank) for r in tables["renames"].collect()) == [("a", "core", 1), ("b", "core", 1), ("invoices", "billing", 2), ("junk", None, 0), ("payments", "billing", 2)]
    rows = spark.createDataFrame([("a",), ("junk",), ("payments",), ("other",)], "feature string")
    assert sorted(r.feature for r in R.renamed(rows, tables["renames"].select("old", "new")).collect()) == ["billing", "core", "other"]
    assert {r.feature for r in tables["features"].collect()} == {"billing", "auth"}
    assert C.rules(spark, C.parsed_yaml(""))["renames"].count() == 0


@pytest.mark.parametrize("config", [{"features": []}, {"skip_features": "x"}, {"force_merges": [{"into": "a"}]}, {"force_merges": ["a"]}, {"features": {"": {}}}])
def test_broken_rules_are_errors(spark, config):
    with pytest.raises(ValueError):
        C.rules(spark, config)


def test_expected_results(spark):
    config = {"features": [{"name": "auth", "aliases": ["login", ""]}, {"name": "pay"}], "flows": [{"name": "log-in", "feature": "auth"}], "samples": [{"path": "a.ts", "expected": "auth"}]}
    features = C.expected(spark, config)
    assert [(r.name, r.aliases) for r in features.orderBy("name").collect()] == [("auth", ["login"]), ("pay", [])]
    assert E.recall(features.select("name", "aliases"), spark.createDataFrame([("login",)], "name string")).collect()[0].recall == 0.5
    assert C.expected(spark, config, "flows").collect()[0].feature == "auth" and C.samples(spark, config).count() == 1
    for broken in ({"features": [{"name": "a"}, {"name": "a"}]}, {"features": [{}]}, {"features": {}, "flows": 1}):
        with pytest.raises(ValueError):
            C.expected(spark, broken, "flows" if "flows" in broken else "features")
    with pytest.raises(ValueError):
        C.samples(spark, {"samples": [{"path": "a", "expected": "x"}, {"path": "a", "expected": "y"}]})
