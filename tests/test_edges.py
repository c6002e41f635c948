"""Import edges against the pairs of consecutive lines."""

from loamline.sources import bridge


def test_edges_are_those_of_all_orders(spark, sf_dir):
    path = {r.part: r.path for r in bridge.files(spark, sf_dir).collect()}
    lines = {}
    for r in bridge.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").collect():
        lines.setdefault((r.l_orderkey, r.l_linenumber), set()).add(r.l_partkey)
    want = {(path[a], path[b]) for (o, n), parts in lines.items() for a in parts for b in lines.get((o, n + 1), ()) if a != b}
    got = [(r.src, r.dst) for r in bridge.edges(spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_flow_reach_has_no_cap(spark):
    """Levels in plain Python; the first 200 files of a seed were all that came out."""
    from loamline.plans import structure

    sf_dir = "/root/testdata/sf0.01"
    out = {}
    for r in bridge.edges(spark, sf_dir).collect():
        out.setdefault(r.src, set()).add(r.dst)
    want = set()
    for r in bridge.files(spark, sf_dir).where("part % 97 = 0").collect():
        seen = level = {r.path}
        want.add((r.path, r.path, 0))
        for d in range(1, 4):
            level = {y for x in level for y in out.get(x, ())} - seen
            seen = seen | level
            want |= {(r.path, x, d) for x in level}
    got = [tuple(r) for r in structure.gr5(spark, sf_dir).select("seed", "node", "depth").collect()]
    assert len(got) > 200 * 21 and len(got) == len(set(got)) and set(got) == want
