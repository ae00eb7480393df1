"""Command line: exact, near, abstract, report, check, showcase, simulate."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import engine, policy, sinks
from .sources.tables import from_directory


def _number(kind, least, most, message):
    def parse(text: str):
        value = kind(text)
        if value < least or (most is not None and value > most):
            raise argparse.ArgumentTypeError(message)
        return value

    return parse


min_count = _number(int, 2, None, "a group has two members at least")
threshold = _number(float, 0.0, 1.0, "expected 0 to 1")
top_k = _number(int, 0, None, "expected 0 or more")
non_negative = _number(int, 0, None, "expected 0 or more")


def optional_limit(text: str) -> int | str:
    return "none" if text.lower() == "none" else non_negative(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog=sinks.NAME, description="Finds duplicated and similar functions in Python code.")
    commands = top.add_subparsers(dest="cmd", required=True)

    def command(name: str, help_text: str, root: str | None = None, near: float | None = None, k: int | None = None, formats: tuple[str, ...] = ("text", "json")) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_text)
        p.add_argument("root", **({} if root is None else {"nargs": "?", "default": root}))
        if near is not None:
            p.add_argument("--threshold", type=threshold, default=near)
            p.add_argument("--top-k", type=top_k, default=k)
        p.add_argument("--top-level-only", action="store_true")
        p.add_argument("--strict", action="store_true")
        p.add_argument("--format", choices=formats, default=formats[0])
        p.add_argument("--output", help="file that the JSON document goes to (with --format json)")
        return p

    exact = command("exact", "groups of functions with one canonical form")
    exact.add_argument("-n", "--min-count", type=min_count, default=2)
    for flag in ("--normalize-local-names", "--normalize-constants", "--include-canonical"):
        exact.add_argument(flag, action="store_true")
    command("near", "similar pairs, best to merge first", near=0.8)
    command("abstract", "similar pairs that are worth merging", near=0.82)
    report = command("report", "One document of exact, near and abstraction results.", near=0.8, k=200, formats=("json",))
    for name in ("local-names", "constants"):
        report.add_argument(f"--no-normalize-{name}", action="store_false", dest=f"normalize_{name.replace('-', '_')}")
    for name in ("showcase", "simulate"):
        command(name, "Compact summary of a corpus.", root=".", near=0.75, k=5)

    check = commands.add_parser("check", help="Hold findings against a policy.")
    check.add_argument("root", nargs="?")
    check.add_argument("--config", type=Path)
    check.add_argument("--threshold", type=threshold)
    check.add_argument("--top-k", type=top_k)
    for name in ("top-level-only", "strict", "normalize-local-names", "normalize-constants", "fail-on-scan-errors", "fail-on-plugin-errors"):
        check.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
    for name in ("exact-groups", "near-matches", "abstract-candidates"):
        check.add_argument(f"--max-{name}", type=optional_limit)
    check.add_argument("--annotation-limit", type=non_negative)
    check.add_argument("--output", type=Path, default=Path(f"{sinks.NAME}-report.json"))
    check.add_argument("--github", action="store_true", help="Emit CI annotations, job summary and outputs.")
    return top


def _session() -> SparkSession:
    spark = SparkSession.builder.appName(sinks.NAME).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _fail(message: str) -> int:
    print(message, file=sys.stderr)
    return 2


def counted(near: DataFrame) -> tuple[int, int]:
    """Pairs, and pairs worth merging, in one pass."""
    row = near.agg(F.count("*").alias("n"), F.count_if(F.col("suggested_refactor_kind") != "leave_separate").alias("m")).first()
    return row.n, row.m


def main(argv: list[str] | None = None, spark: SparkSession | None = None, plugins: tuple = engine.BUILT_IN) -> int:
    args = parser().parse_args(argv)
    if args.cmd == "check":
        names = ("root", "threshold", "top_k", "top_level_only", "strict", "normalize_local_names", "normalize_constants", "fail_on_scan_errors", "fail_on_plugin_errors", "max_exact_groups", "max_near_matches", "max_abstract_candidates", "annotation_limit")
        try:
            config = policy.with_overrides(policy.load_config(args.config), **{n: getattr(args, n) for n in names})
        except policy.ConfigError as error:
            return _fail(f"Error: {error}")
        found = args.config or (Path(policy.CONFIG_FILENAME) if Path(policy.CONFIG_FILENAME).is_file() else None)
        return run_check(spark, Path(config.root), config, args.output, args.github, found, plugins)
    root = Path(args.root)
    if not root.is_dir():
        return _fail(f"Invalid directory: {root}")
    if args.output and args.format != "json":
        return _fail("Error: --output requires --format json.")
    try:
        return _query(spark or _session(), root, args, plugins)
    except (RuntimeError, ValueError) as error:
        return _fail(f"Error: {error}")


def _query(spark: SparkSession, root: Path, args: argparse.Namespace, plugins: tuple) -> int:
    normal = (True, True) if args.cmd in ("showcase", "simulate") else (getattr(args, "normalize_local_names", False), getattr(args, "normalize_constants", False))
    exact_too = args.cmd not in ("near", "abstract")
    scan = engine.Scan(from_directory(spark, str(root)), top_level_only=args.top_level_only, strict=args.strict, normal=normal, features=args.cmd != "exact", canonical=exact_too, source=any(isinstance(p, engine.PythonPlugin) for p in plugins))
    try:
        if args.cmd == "exact":
            rows = engine.exact_groups(scan, args.min_count, args.include_canonical).collect()
            return _emit(args, [sinks.group_json(r) for r in rows], sinks.exact_text(rows), scan.error_messages(), [])
        limit = None if args.cmd in ("showcase", "simulate") else args.top_k
        # errors of plugins depend on the threshold, not on top_k
        every = engine.near_matches(scan, args.threshold, 0 if limit == 0 else None, plugins).persist()
        errors = [r.message for r in engine.plugin_errors(every).collect()]
        near = every if limit is None else every.limit(limit)
        if args.cmd in ("near", "abstract"):
            rows = (near if args.cmd == "near" else engine.worth_merging(near)).collect()
            return _emit(args, [sinks.pair_json(r) for r in rows], sinks.near_text(rows), scan.error_messages(), errors)
        groups = engine.exact_groups(scan)
        if args.cmd == "report":
            exact, rows = groups.collect(), near.collect()
            worth = [r for r in rows if r.suggested_refactor_kind != "leave_separate"]
            document = {"root": str(root), "settings": sinks.settings_json(args.threshold, args.top_k, normal), "summary": sinks.summary_json(len(exact), len(rows), len(worth))}
            document |= {"exact": [sinks.group_json(r) for r in exact], "near": [sinks.pair_json(r) for r in rows], "abstract": [sinks.pair_json(r) for r in worth]}
            return _emit(args, document, "", scan.error_messages(), errors)
        examples = {
            "exact": [sinks.showcase_group(r) for r in groups.limit(args.top_k).collect()],
            "near": [sinks.showcase_pair(r) for r in near.limit(args.top_k).collect()],
            "abstract": [sinks.showcase_pair(r) for r in engine.worth_merging(near).limit(args.top_k).collect()],
        }
        document = {"root": str(root), "settings": sinks.settings_json(args.threshold, args.top_k, normal), "summary": sinks.summary_json(groups.count(), *counted(near)), "top_examples": examples}
        return _emit(args, document, sinks.showcase_text(document), scan.error_messages(), errors)
    finally:
        scan.close()


def _emit(args: argparse.Namespace, document: object, text: str, scan_errors: list[str], plugin_errors: list[str]) -> int:
    sinks.print_diagnostics(scan_errors, plugin_errors)
    if args.format == "json":
        sinks.write_json(document, args.output, scan_errors, plugin_errors)
    else:
        print(text)
    return 0


def run_check(spark: SparkSession | None, root: Path, config: policy.CheckConfig, output: Path, github: bool, config_path: Path | None = None, plugins: tuple = engine.BUILT_IN) -> int:
    """0 if the policy holds, 1 if not, 2 if the analysis or a report failed."""
    if not root.is_dir():
        return _fail(f"Invalid directory: {root}")
    if {"\n", "\r"} & set(str(output)):
        return _fail("Invalid output path: line breaks are not allowed.")
    spark = spark or _session()
    normal = (config.normalize_local_names, config.normalize_constants)
    scan = engine.Scan(from_directory(spark, str(root)), top_level_only=config.top_level_only, strict=config.strict, normal=normal, source=any(isinstance(p, engine.PythonPlugin) for p in plugins))
    try:
        exact = engine.exact_groups(scan).persist()
        near = engine.near_matches(scan, config.threshold, None, plugins).persist()
        abstract = engine.worth_merging(near)
        n_exact, (n_near, n_abstract) = exact.count(), counted(near)
        scan_errors, plugin_errors = scan.error_messages(), [r.message for r in engine.plugin_errors(near).collect()]
        groups, pairs, worth = exact.collect(), near.limit(config.top_k).collect(), abstract.limit(config.top_k).collect()
    except (RuntimeError, ValueError) as error:
        if github:
            print(sinks.annotation("error", str(error), title=f"{sinks.NAME} analysis failed"))
        return _fail(f"Error: {error}")
    finally:
        scan.close()
    counts = {"exact_groups": n_exact, "near_matches": n_near, "abstract_candidates": n_abstract, "scan_errors": len(scan_errors), "plugin_errors": len(plugin_errors)}
    broken = policy.evaluate(spark, config, counts)
    summary = sinks.summary_json(n_exact, n_near, n_abstract)
    document = {
        "root": str(root),
        "config": None if config_path is None else str(config_path),
        "settings": sinks.settings_json(config.threshold, config.top_k, normal, top_level_only=config.top_level_only, strict=config.strict),
        "summary": summary,
        "check": {"passed": not broken, "limits": config.limits(), "violations": [v.as_dict() for v in broken], "report_truncated": {"near": n_near > config.top_k, "abstract": n_abstract > config.top_k}},
        "exact": [sinks.group_json(r) for r in groups],
        "near": [sinks.pair_json(r) for r in pairs],
        "abstract": [sinks.pair_json(r) for r in worth],
    }
    try:
        sinks.write_json(document, output, scan_errors, plugin_errors, quiet=True)
    except OSError as error:
        if github:
            print(sinks.annotation("error", str(error), title=f"{sinks.NAME} report failed"))
        return _fail(f"Error: Could not write report {output}: {error}")
    print(f"{sinks.NAME} check: {'failed' if broken else 'passed'} (exact={n_exact}, near={n_near}, abstract={n_abstract})\nReport: {output}")
    for v in broken:
        print(f"- {v.message}", file=sys.stderr)
    if github:
        failing = {v.category for v in broken}
        shown = sinks.finding_annotations(failing, exact, near, abstract, config.annotation_limit)
        print("\n".join([*shown, *sinks.diagnostic_annotations(failing, scan_errors, plugin_errors, config.annotation_limit - len(shown))]))
        try:
            sinks.write_outputs(summary, not broken, output)
            sinks.write_step_summary(root, config, summary, broken, output, config_path)
        except OSError as error:
            print(sinks.annotation("error", str(error), title=f"{sinks.NAME} CI output failed"))
            return _fail(f"Error: Could not write CI metadata: {error}")
    return 1 if broken else 0


if __name__ == "__main__":
    raise SystemExit(main())
