import os

import pytest
from pyspark.sql import functions as F

from twinleaf.sources.python_files import EXCLUDED_DIRS
from twinleaf.sources.tables import from_directory, from_table, in_excluded_dir, scan_key


@pytest.fixture
def tree(tmp_path):
    files = ["z.py", "a/x.py", "a/__init__.py", "a/_private.py", "a/.hidden.py", "_sub/y.py", "venv/no.py", "a/build/no.py", "a/venv2/yes.py", "a/no.txt", "a/no.PY", "site-packages/no.py"]
    for name in files:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"# {name}\n")
    (tmp_path / "dir.py").mkdir()
    os.symlink(tmp_path / "z.py", tmp_path / "link.py")
    os.symlink(tmp_path / "a", tmp_path / "linked_dir")
    return tmp_path


def walk(root):
    out = []
    for at, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in EXCLUDED_DIRS)
        out += [os.path.relpath(os.path.join(at, f), root) for f in sorted(files) if f.endswith(".py")]
    return out


@pytest.mark.parametrize("batch", [1, 4 << 20])
def test_directory_scan(spark, tree, batch):
    rows = from_directory(spark, tree, batch)
    got = [r.rel for r in rows.orderBy(scan_key(F.col("rel"))).collect()]
    assert got == walk(tree) and "a/__init__.py" in got and "link.py" in got
    one = rows.where("rel = 'a/x.py'").first()
    assert one.path == str(tree / "a/x.py") and bytes(one.content) == b"# a/x.py\n" and one.read_error is None
    assert (rows.rdd.getNumPartitions() > 3) == (batch == 1)


def test_excluded_root_name_is_scanned(spark, tree):
    assert [r.rel for r in from_directory(spark, tree / "venv").collect()] == ["no.py"]


def test_empty_directory(spark, tmp_path):
    assert from_directory(spark, tmp_path).collect() == []


def test_tables_follow_the_same_rules(spark, tree):
    names = [os.path.relpath(os.path.join(at, f), tree) for at, _, files in os.walk(tree) for f in files]
    df = spark.createDataFrame([(n, "x = 1") for n in names], "path string, src string")
    assert sorted(r.rel for r in from_table(df).collect()) == sorted(walk(tree))
    one = spark.createDataFrame([("venv/a.py",), ("a/venv",), ("venv",)], "p string")
    assert [r.v for r in one.coalesce(1).select(in_excluded_dir(F.col("p")).alias("v")).collect()] == [True, False, False]


def test_bytes_that_do_not_parse_become_errors(spark):
    from twinleaf.operators.parse import parse

    cases = {"bom.py": b"\xef\xbb\xbfx = 1", "nul.py": b"x = '\x00'", "latin.py": b"x = '\xe9'", "crlf.py": b"def f():\r\n    return 1\r\n"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()] + [("none.py", None)], "path string, src binary")
    rows = {r.path: r for r in parse(from_table(df)).collect()}
    assert rows["crlf.py"].error is None and rows["crlf.py"].qualname == "f"
    assert rows["latin.py"].error.startswith("UnicodeDecodeError: ") and rows["bom.py"].error.startswith("SyntaxError: ") and rows["nul.py"].error.startswith("SyntaxError: ")
    assert rows["none.py"].error is not None
