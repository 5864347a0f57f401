"""The command line: ``python -m sparkprep.cli VERB ...``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sparkprep.errors import InvalidConfig, PrepError
from sparkprep.functions import text as tx
from sparkprep.operators import columns, doctests, federated, rows, splits
from sparkprep.operators.fim import fim
from sparkprep.profile import drift, quality, sketches
from sparkprep.registry import Registry
from sparkprep.sources import hub
from sparkprep.sources.files import load, save


def session() -> SparkSession:
    return SparkSession.builder.appName("sparkprep").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkprep")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, under=verbs, **options):
        p = under.add_parser(name)
        for a in args:
            p.add_argument(a)
        for k, v in options.items():
            p.add_argument(f"--{k.replace('_', '-')}", **(v if isinstance(v, dict) else {"default": v, "type": type(v)} if v is not None else {}))
        return p

    flag = {"action": "store_true"}
    verb("convert", "input", "output")
    verb("info", "input")
    verb("head", "input", rows=10)
    verb("schema", "input")
    verb("mix", "inputs", output={"required": True}, seed=42, max_rows={"type": int}, key={"required": True})._actions[1].nargs = "+"
    verb("fim", "input", "output", column=None, key={"required": True}, rate=0.5, layout="psm", seed=42)
    verb("dedup", "input", "output", column=None, key={"required": True})
    verb("filter-text", "input", "output", column=None, min_score=0.5, min_length=0, max_length=2**31 - 1)
    verb("view", "input", order={"required": True}, page=20, start=0)
    verb("import", "input", "output")
    group = lambda name: verbs.add_parser(name).add_subparsers(dest="sub", required=True)
    g = group("drift")
    for name in ("detect", "report"):
        verb(name, "reference", "current", under=g, tests="ks,psi", alpha=0.05)
    verb("sketch", "input", "output", under=g, kind="ddsketch")
    verb("merge", "inputs", under=g, output={"required": True})._actions[1].nargs = "+"
    verb("compare", "reference", "current", under=g, threshold=0.1)
    g = group("quality")
    for name in ("check", "report"):
        verb(name, "input", under=g, null_threshold=0.1, duplicate_threshold=0.5, json=flag)
    verb("score", "input", under=g, profile="default", json=flag, badge=flag, suggest=flag)
    verb("profiles", under=g)
    g = group("fed")
    verb("manifest", "input", "output", under=g, node={"required": True}, label=None)
    verb("plan", "manifests", "output", under=g, strategy="local_with_seed", train_ratio=0.8, seed=42, label=None)
    verb("split", "input", "plan", "output", under=g, node={"required": True}, key={"required": True})
    verb("verify", "manifests", under=g)
    g = group("registry")
    verb("init", "root", under=g)
    verb("list", "root", under=g)
    verb("push", "root", "name", "version", "input", under=g, description="", tags="")
    verb("pull", "root", "name", "output", under=g, version=None)
    verb("search", "root", "text", under=g)
    verb("show", "root", "name", under=g)
    verb("delete", "root", "name", "version", under=g)
    g = group("hub")
    verb("pull", "repo", "output", under=g, subset=None, split="train", revision="main")
    verb("push", "repo", "input", under=g, path="data/train.parquet", token={"required": True}, card=None)
    g = group("doctest")
    verb("extract", "folder", "output", under=g, source="source", version="0")
    verb("merge", "inputs", under=g, output={"required": True})._actions[1].nargs = "+"
    verb("repl")
    return top


def _show(df: DataFrame, out) -> None:
    for r in df.toArrow().to_pylist():
        print(json.dumps(r, default=str), file=out)


def _quality(a, spark: SparkSession, out) -> int:
    if a.sub == "profiles":
        for p in quality.PROFILES.values():
            print(f"{p.name}: {p.description}", file=out)
        return 0
    df = load(spark, a.input)
    if a.sub in ("check", "report"):
        r = quality.check(df, quality.Thresholds(max_null_ratio=a.null_threshold, max_duplicate_ratio=a.duplicate_threshold))
        if a.json:
            print(json.dumps({"score": r.score, "rows": r.row_count, "duplicates": r.duplicate_row_count, "issues": [vars(i) | {"severity": i.severity} for i in r.issues]}), file=out)
        else:
            print(f"score {r.score:.1f}, {r.row_count} rows, {r.duplicate_row_count} repeated", file=out)
            for i in r.issues:
                print(f"[{i.severity}] {i.kind} {i.column or ''} {i.value if i.value is not None else ''}", file=out)
            if a.sub == "report":
                _show(quality.column_profile(df), out)
        return 0
    p = quality.profile_by_name(a.profile)
    card = quality.scorecard(quality.checklist(quality.check(df, p.thresholds), p))
    print(card.to_json() if a.json else card.badge_url() if a.badge else f"{card.grade} {card.score:.1f}: {card.decision}", file=out)
    if a.suggest:
        for c in card.failed():
            print(f"- {c.text}: {c.suggestion}", file=out)
    return int(bool(card.failed("critical")))


def _drift(a, spark: SparkSession, out) -> int:
    if a.sub in ("detect", "report"):
        r = drift.report(load(spark, a.reference), load(spark, a.current), a.tests.split(","), a.alpha)
        for row in r.rows if a.sub == "report" else [x for x in r.rows if x["drifted"]]:
            print(json.dumps(row), file=out)
        print(f"drifted: {', '.join(r.drifted_columns) or 'none'}; severity {r.max_severity}", file=out)
    elif a.sub == "sketch":
        kinds = {"ddsketch": sketches.ddsketch, "tdigest": sketches.tdigest}
        if a.kind not in kinds:
            raise InvalidConfig("kind is ddsketch or tdigest")
        save(kinds[a.kind](load(spark, a.input)), a.output)
    elif a.sub == "merge":
        parts = [load(spark, x) for x in a.inputs]
        save(sketches.merge_ddsketches(*parts) if "bucket" in parts[0].columns else sketches.merge_tdigests(columns.union_all(*parts)), a.output)
    else:
        sides = [load(spark, x) for x in (a.reference, a.current)]
        if len({"bucket" in s.columns for s in sides}) > 1:
            raise InvalidConfig("sketches of two kinds")
        at = sketches.dd_quantiles if "bucket" in sides[0].columns else sketches.td_quantiles
        _show(sketches.compare(*(at(s, sketches.steps()) for s in sides), threshold=a.threshold), out)
    return 0


def _fed(a, spark: SparkSession, out) -> int:
    if a.sub == "manifest":
        save(federated.manifests(load(spark, a.input), a.node, label=a.label), a.output)
    elif a.sub == "plan":
        save(federated.plan(load(spark, a.manifests), federated.Strategy(a.strategy, a.train_ratio, a.seed, a.label)), a.output)
    elif a.sub == "split":
        save(federated.execute(load(spark, a.input), load(spark, a.plan), a.node, a.key), a.output)
    else:
        r = federated.global_report(load(spark, a.manifests))
        print(json.dumps(r, default=str), file=out)
        return int(not r["quality_passed"])
    return 0


def _registry(a, spark: SparkSession, out) -> int:
    r = Registry(spark, a.root)
    if a.sub == "init":
        r.init()
    elif a.sub == "list":
        _show(r.frame(), out)
    elif a.sub == "push":
        r.publish(a.name, a.version, load(spark, a.input), description=a.description, tags=[t for t in a.tags.split(",") if t])
    elif a.sub == "pull":
        save(r.pull(a.name, a.version), a.output)
    elif a.sub == "search":
        _show(r.search(a.text), out)
    elif a.sub == "show":
        print(json.dumps(vars(r.info(a.name))), file=out)
    else:
        r.delete(a.name, a.version)
    return 0


def run(argv: Sequence[str], spark: SparkSession | None = None, out=None) -> int:
    a, out = parser().parse_args(argv), out or sys.stdout
    spark = spark or session()
    if a.verb in ("convert", "import"):
        save(load(spark, a.input), a.output)
    elif a.verb == "info":
        print(json.dumps(columns.info(load(spark, a.input))), file=out)
    elif a.verb == "head":
        _show(rows.head(load(spark, a.input), a.rows), out)
    elif a.verb == "schema":
        _show(columns.schema_table(load(spark, a.input)), out)
    elif a.verb == "mix":
        pairs = [x.rpartition(":") if ":" in x.removeprefix("file://") else (x, "", "1") for x in a.inputs]
        save(splits.mix([(load(spark, p), float(w)) for p, _, w in pairs], a.key, a.seed, a.max_rows), a.output)
    elif a.verb == "fim":
        df = load(spark, a.input)
        save(df.transform(fim(a.column or tx.find_text_column(df), a.key, a.rate, a.layout, seed=a.seed)), a.output)
    elif a.verb == "dedup":
        df = load(spark, a.input)
        save(df.transform(rows.unique(a.column or tx.find_text_column(df), a.key)), a.output)
    elif a.verb == "filter-text":
        save(tx.filter_text(load(spark, a.input), a.column, a.min_score, a.min_length, a.max_length), a.output)
    elif a.verb == "view":
        from sparkprep.viewer import Viewer

        v = Viewer(load(spark, a.input), a.order, a.page)
        v.move(a.start)
        print(v.render(), file=out)
    elif a.verb == "repl":
        from sparkprep.repl import loop

        loop(spark)
    elif a.verb == "hub":
        if a.sub == "pull":
            save(hub.HubDataset(a.repo, a.subset, a.split, a.revision).download(spark), a.output)
        else:
            p = hub.Publisher(a.repo, a.token)
            p.create()
            p.upload_table(a.path, load(spark, a.input))
            if a.card:
                with open(a.card) as f:
                    p.upload_card(f.read())
    elif a.verb == "doctest":
        if a.sub == "extract":
            save(doctests.from_directory(spark, a.folder, a.source, a.version), a.output)
        else:
            save(doctests.merge(*(load(spark, x) for x in a.inputs)), a.output)
    else:
        return {"drift": _drift, "quality": _quality, "fed": _fed, "registry": _registry}[a.verb](a, spark, out)
    return 0


def main() -> int:
    try:
        return run(sys.argv[1:])
    except PrepError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2



if __name__ == "__main__":
    sys.exit(main())
