"""Work is dealt over tasks, whatever the files of a table or the sizes of kinds."""

from collections import defaultdict

import pytest

from twinleaf.plans import catalog, corpora, engine
from twinleaf.sources.tables import from_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def alike(spark):
    """400 functions of two shapes in one partition of a table."""
    rows = [(f"m{i:03}.py", f"def f{i}(x):\n    return g(x, {i})\n" if i % 4 else f"def f{i}(x):\n    y = x\n    return y\n") for i in range(400)]
    return spark.createDataFrame(rows, "path string, src string").coalesce(1)


def test_a_table_in_one_part_is_parsed_in_many_tasks(spark, alike):
    sizes = from_table(alike).rdd.glom().map(len).collect()
    assert sum(sizes) == 400 and len(sizes) >= 4 * spark.sparkContext.defaultParallelism and max(sizes) <= 60
    parts = corpora.table(spark, "/root/testdata/sf0.001", "part").coalesce(1)
    assert corpora.generated(parts).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_a_kind_is_not_moved(spark, alike):
    """The first two functions of each kind, found without a shuffle of more than two rows of a kind from each task."""
    scan = engine.Scan(from_table(alike), canonical=False)
    members = engine.kind_members(engine.with_kinds(scan.functions()))
    assert "WindowGroupLimit" in plan(members) and "Partial" in plan(members)[plan(members).index("WindowGroupLimit") :]
    want = defaultdict(list)
    for i in range(400):
        want[i % 4 == 0].append(f"m{i:03}.py")
    assert sorted((r.path, r.place, r.members) for r in members.collect()) == sorted((p, k + 1, len(paths)) for paths in want.values() for k, p in enumerate(paths[:2]))
    told = plan(engine.near_members(scan))  # kinds go to the functions
    assert told.index("BroadcastHashJoin") < told.index("SortMergeJoin")
    scan.close()
    assert not scan.rows.storageLevel.useMemory and all(not x.storageLevel.useMemory for x in scan._kept)


def test_two_files_of_one_path_are_one_place(spark):
    """A path that stands twice in a table: the second function of a kind is that of the next path."""
    src = "def f(x):\n    return g(x)\n"
    scan = engine.Scan(from_table(spark.createDataFrame([("a.py", src), ("a.py", src), ("b.py", src)], "path string, src string")), canonical=False)
    members = engine.kind_members(engine.with_kinds(scan.functions()))
    assert sorted((r.path, r.place, r.members) for r in members.collect()) == [("a.py", 1, 3), ("b.py", 2, 3)]


def test_groups_gather_only_what_is_shown(spark, alike):
    scan = engine.Scan(from_table(alike), normal=(True, True), features=False)
    groups = engine.exact_groups(scan, shown=("qualname",)).collect()
    assert [[tuple(o.asDict()) for o in g.occurrences][:1] for g in groups] == [[("qualname",)]] * 2
    assert [o.qualname for o in groups[0].occurrences] == [f"f{i}" for i in range(400) if i % 4]
    assert sorted(tuple(r) for r in engine.group_sizes(scan).collect()) == sorted((g.hash, g["count"]) for g in groups)
    counts = catalog.report_summary(spark, "/root/testdata/sf0.001")
    assert "collect_list" not in plan(counts)
