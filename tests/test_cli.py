import json
from textwrap import dedent

import pytest

from twinleaf import cli
from twinleaf.operators.plugins import BUILT_IN, PythonPlugin


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "m.py").write_text(
        dedent("""
        def first(a):
            return clean(a, 1)
        def second(b):
            return clean(b, 2)
        def third(b):
            return clean(b, 2)
        """)
    )
    return root


@pytest.fixture(scope="module")
def broken(tmp_path_factory):
    root = tmp_path_factory.mktemp("broken")
    for i in range(7):
        (root / f"bad{i}.py").write_text("def broken(:\n")
    return root


@pytest.fixture
def run(spark, capsys):
    def call(*args, plugins=BUILT_IN):
        code = cli.main([str(a) for a in args], spark, plugins)
        got = capsys.readouterr()
        return code, got.out, got.err

    return call


def test_exact(run, repo):
    code, out, _ = run("exact", repo, "--format", "json", "--include-canonical", "--normalize-local-names")
    results = json.loads(out)["results"]
    assert code == 0 and [g["count"] for g in results] == [2] and results[0]["canonical"].startswith("FunctionDef")
    assert set(results[0]["occurrences"][0]) == {"path", "lineno", "end_lineno", "col_offset", "name", "qualname", "kind", "param_count", "is_method"}
    code, out, _ = run("exact", repo, "--normalize-local-names", "--normalize-constants")
    assert code == 0 and out.startswith("1 groups of exact duplicates\n* ") and ": 3 functions\n" in out and f"    def first ({repo}/m.py, line 2)\n" in out
    assert run("exact", repo, "-n", "4")[1] == "0 groups of exact duplicates\n"


def test_near_and_abstract(run, repo, tmp_path):
    code, out, _ = run("near", repo)
    assert code == 0 and "similarity 0.9350, refactorability " in out and ": merge_into_single_function_with_param\n" in out
    target = tmp_path / "deep" / "out.json"
    code, out, err = run("abstract", repo, "--format", "json", "--output", target, "--top-k", 2)
    rows = json.loads(target.read_text())["results"]
    assert code == 0 and out == "" and "results are in" in err and len(rows) == 2
    assert rows[0]["metadata"]["currying"] == {} and rows[0]["metadata"]["wrapper"]["a_wrapper_target"] == "clean" and list(rows[0]["metadata"])[0] == "size_ratio"
    assert run("near", repo, "--threshold", "0.99")[1] == "0 pairs of similar functions\n"
    assert json.loads(run("near", repo, "--top-k", "0", "--format", "json")[1])["results"] == []


def test_report_counts_after_the_limit(run, repo):
    got = json.loads(run("report", repo, "--top-k", "1")[1])["results"]
    assert got["summary"] == {"exact_group_count": 1, "near_count": 1, "abstract_count": 1}
    assert got["settings"] == {"threshold": 0.8, "top_k": 1, "exact_normalization": {"normalize_local_names": True, "normalize_constants": True}}
    got = json.loads(run("report", repo, "--no-normalize-constants", "--no-normalize-local-names")[1])["results"]
    assert got["summary"]["exact_group_count"] == 1 and got["summary"]["near_count"] == 3


def test_showcase_counts_everything(run, repo):
    got = json.loads(run("simulate", repo, "--top-k", "1", "--format", "json")[1])["results"]
    assert got["summary"]["near_count"] == 3 and len(got["top_examples"]["near"]) == 1
    assert list(got["top_examples"]["exact"][0]) == ["count", "hash_prefix", "qualnames"]
    code, out, _ = run("showcase", repo)
    assert code == 0 and "exact groups: 1\n" in out and "near pairs: 3\n" in out and " | " in out


def test_diagnostics(run, broken):
    code, out, err = run("exact", broken, "--format", "json")
    assert code == 0 and json.loads(out)["diagnostics"]["scan_errors_count"] == 7 and len(json.loads(out)["diagnostics"]["scan_error_samples"]) == 5
    assert "7 files not scanned" in err and "and 2 others" in err
    code, out, err = run("near", broken, "--strict")
    assert code == 2 and err.startswith("Error: Failed to parse/read") and "bad0.py" in err


@pytest.mark.parametrize("args", [("near", "{root}", "--output", "x.json"), ("near", "/no/such/dir"), ("check", "{root}", "--config", "/no/such.toml"), ("check", "/no/such/dir"), ("check", "{root}", "--output", "a\nb")])
def test_exit_2(run, repo, args, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert run(*(a.replace("{root}", str(repo)) for a in args))[0] == 2


@pytest.mark.parametrize("args", [("exact", ".", "-n", "1"), ("near", ".", "--threshold", "2"), ("near", ".", "--top-k", "-1"), ("check", "--max-exact-groups", "x"), ()])
def test_bad_arguments(run, args):
    with pytest.raises(SystemExit):
        run(*args)


def test_check(run, repo, broken, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    target = tmp_path / "r.json"
    code, out, err = run("check", repo, "--output", target, "--top-k", 1, "--github", "--annotation-limit", 4)
    got = json.loads(target.read_text())["results"]
    assert code == 1 and out.startswith("twinleaf check: failed (exact=1, near=3, abstract=3)\n") and "- exact groups: 1 found, 0 allowed" in err
    assert got["check"]["report_truncated"] == {"near": True, "abstract": True} and len(got["near"]) == 1 and got["summary"]["near_count"] == 3
    shown = [x for x in out.splitlines() if x.startswith("::")]
    assert len(shown) == 4 and all("Exact duplicate group (3 occurrences)" in x for x in shown[:3]) and "Abstraction candidate" in shown[3]
    code, out, _ = run("check", repo, "--output", target, "--max-exact-groups", "NONE", "--max-abstract-candidates", "3")
    assert code == 0 and "passed" in out
    target.unlink()
    assert run("check", broken, "--output", target)[0] == 2 and not target.exists()
    code, _, err = run("check", broken, "--output", target, "--no-strict")
    assert code == 1 and "scan errors: 7 found" in err


def _fail(a, b, evidence):
    raise ValueError("no")


def test_plugin_errors_are_told_once(run, repo, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    plugins = (*BUILT_IN, PythonPlugin("moody", _fail))
    code, out, err = run("near", repo, "--format", "json", "--top-k", "1", plugins=plugins)
    got = json.loads(out)
    assert got["diagnostics"]["plugin_error_samples"] == ["moody: ValueError: no"] and got["results"][0]["metadata"]["_plugin_errors"] == ["moody: ValueError: no"]
    assert "moody" not in got["results"][0]["metadata"] and "1 errors of plugins" in err and code == 0
    assert json.loads(run("near", repo, "--format", "json", "--top-k", "0", plugins=plugins)[1])["diagnostics"]["plugin_errors_count"] == 0
    assert run("check", repo, "--max-exact-groups", "none", "--max-abstract-candidates", "none", plugins=plugins)[0] == 1
