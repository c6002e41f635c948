"""Clean-up rules on small maps."""

from loamline.operators import cleanup as U


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "feature string, path string")


def names(df):
    return sorted(tuple(r) for r in df.select("feature", "path").collect())


def test_numbers_go_to_features_that_share_words(spark):
    m = rows(spark, ("ndr-2", "src/NDR/AutoSegment/a.ts"), ("ndr-2", "src/NDR/b.ts"), ("ui-4", "lib/c.ts"), ("auto-segment", "x/d.ts"), ("-7", "e.ts"))
    assert names(U.named_without_numbers(m)) == [("-7", "e.ts"), ("auto-segment", "src/NDR/AutoSegment/a.ts"), ("auto-segment", "x/d.ts"), ("ndr", "src/NDR/b.ts"), ("ui", "lib/c.ts")]


def test_siblings_meet_at_the_shortest_prefix(spark):
    m = rows(spark, ("issues-sub-a", "1"), ("issues-sub-b", "2"), ("issues", "3"), ("app-x-a", "4"), ("app-x-b", "5"), ("solo-one", "6"), ("a-b", "7"), ("a-c", "8"))
    assert names(U.merged_siblings(m)) == [("a-b", "7"), ("a-c", "8"), ("app-x", "4"), ("app-x", "5"), ("issues", "1"), ("issues", "2"), ("issues", "3"), ("solo-one", "6")]


def test_tiny_features_need_a_larger_one(spark):
    few = rows(spark, ("a", "1"), ("b", "2"))
    assert names(U.absorbed_tiny(few)) == names(few)
    tiny = rows(spark, *[(f"f{i}", str(i)) for i in range(6)])
    assert names(U.absorbed_tiny(tiny)) == names(tiny)  # none is larger
    mixed = rows(spark, *[("order-list", f"o{i}") for i in range(9)], *[("pay", f"p{i}") for i in range(9)], *[("user", f"u{i}") for i in range(9)], ("order_tax", "t"), ("zebra", "z"))
    got = dict((p, f) for f, p in names(U.absorbed_tiny(mixed)))
    assert got["t"] == "order-list" and got["z"] == "shared-infra" and got["o1"] == "order-list"


def test_directories_and_names(spark):
    m = rows(spark, ("survey-list", "app/surveys/a"), ("survey-list", "app/surveys/b"), ("answers", "app/surveys/c"), ("top", "README"))
    assert names(U.merged_by_directory(m)) == [("survey-list", "app/surveys/a"), ("survey-list", "app/surveys/b"), ("survey-list", "app/surveys/c"), ("top", "README")]
    same = rows(spark, ("a/cred", "x/1"), ("b/Cred", "y/2"), ("p/log", "l/1"), ("q/log", "l/1"), ("q/log", "l/2"))
    assert names(U.same_names(same)) == [("cred-x", "x/1"), ("cred-y", "y/2"), ("q/log", "l/1"), ("q/log", "l/2")]


def test_empty_maps_stay_empty(spark):
    empty = rows(spark)
    for rule in (U.final_clean_up, U.same_names, U.merged_by_directory, U.collapsed_plugins, U.extracted_ui, U.folded_tooling):
        assert rule(empty).count() == 0
