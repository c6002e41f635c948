import subprocess

from loamline.__main__ import main, scan
from loamline.sources import sinks as S


def test_map_round_trip(spark, tmp_path):
    features = spark.createDataFrame([("auth", 3), ("pay", 5)], "feature string, commits int")
    files = spark.createDataFrame([("auth", "b"), ("auth", "a"), ("pay", "c")], "feature string, path string")
    for stamp in ("20240101", "20240102"):
        S.write_map(S.feature_document(features, files).where("feature = 'auth'" if stamp < "20240102" else "true"), str(tmp_path), "Org/My Repo", stamp)
    got = {r.feature: (r.commits, r.paths) for r in S.latest_map(spark, str(tmp_path), "Org/My Repo", "feature string, commits int, paths array<string>").collect()}
    assert got == {"auth": (3, ["a", "b"]), "pay": (5, ["c"])}


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")], "path string, line int, sha string")
    new = spark.createDataFrame([("a", 1, "y")], "path string, line int, sha string")
    assert sorted(tuple(r) for r in S.upsert_blame(old, new).collect()) == [("a", 1, "y"), ("b", 1, "x")]
    seen = lambda rows: spark.createDataFrame(rows, "path string, name string, seen int")
    assert sorted(tuple(r) for r in S.assignments(seen([("a", "x", 1), ("b", "z", 1)]), seen([("a", "y", 2)])).collect()) == [("a", "y", 2), ("b", "z", 1)]


def test_scan_of_a_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    for name, message in (("src/auth/a.ts", "feat: start"), ("src/auth/b.ts", "fix: crash"), ("src/pay/c.ts", "chore: x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(message)
        git("add", "-A")
        git("commit", "-qm", message)
    got = {r.feature: (r.total_commits, r.bug_fixes) for r in scan(spark, str(tmp_path), 365).collect()}
    assert got == {"auth": (2, 1), "pay": (1, 0)}


def test_list(capsys):
    main(["list"])
    assert "ag1_feature_metrics" in capsys.readouterr().out
