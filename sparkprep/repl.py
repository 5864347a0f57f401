"""An interactive session over named tables."""

from __future__ import annotations

import json
import shlex
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sparkprep.content import Constraint, Field, Schema
from sparkprep.errors import NotFound, ParseError, PrepError
from sparkprep.operators import columns, rows
from sparkprep.profile import drift, quality
from sparkprep.sources.files import load, save

#: Verbs and their topics of help.
HELP = {
    "load": "load PATH: read a table and make it active", "datasets": "datasets: names of the tables", "use": "use NAME: make a table active",
    "info": "info: rows and columns", "head": "head [N]: the first rows", "schema": "schema: columns and types",
    "quality": "quality check | quality score [--suggest] [--json] [--badge]", "drift": "drift detect REFERENCE: compare with another table",
    "convert": "convert FORMAT: write the active table beside its source", "export": "export quality|history [--json]",
    "validate": "validate --schema FILE: check against a content schema", "history": "history [--export]: what was entered", "help": "help [TOPIC]", "quit": "quit",
}
_SAME = {"?": "help", "exit": "quit", "q": "quit"}


@dataclass(frozen=True)
class Command:
    verb: str
    args: tuple[str, ...] = ()
    flags: frozenset[str] = frozenset()
    options: dict = field(default_factory=dict)


def parse(line: str) -> Command:
    """A verb (any case), words, and --flags; --schema takes a value."""
    try:
        words = shlex.split(line)
    except ValueError as e:
        raise ParseError(str(e)) from e
    if not words:
        raise ParseError("empty command")
    verb = _SAME.get(words[0].lower(), words[0].lower())
    if verb not in HELP:
        raise ParseError(f"unknown command {words[0]!r}")
    args, flags, options, rest = [], set(), {}, iter(words[1:])
    for w in rest:
        if w == "--schema":
            options["schema"] = next(rest, None)
        elif w.startswith("--"):
            flags.add(w[2:])
        else:
            args.append(w)
    need = {"load": "a path", "use": "a name", "convert": "a format", "export": "what to export"}
    if verb in need and not args:
        raise ParseError(f"{verb} needs {need[verb]}")
    if verb == "quality" and args[:1] not in (["check"], ["score"]):
        raise ParseError("quality check or quality score")
    if verb == "drift" and (args[:1] != ["detect"] or len(args) < 2):
        raise ParseError("drift detect REFERENCE")
    if verb == "validate" and not options.get("schema"):
        raise ParseError("validate needs --schema FILE")
    if verb == "head" and args and not args[0].isdigit():
        raise ParseError("head takes a number")
    return Command(verb, tuple(args), frozenset(flags), options)


def read_schema(path: str) -> Schema:
    with open(path) as f:
        d = json.load(f)
    fields = tuple(Field(x["name"], x.get("type", "string"), x.get("nullable", False), x.get("description"), x.get("default"), tuple(Constraint(k, v) for k, v in x.get("constraints", {}).items())) for x in d["fields"])
    return Schema(d.get("name", "schema"), d.get("version", "1.0"), fields)


class Session:
    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.paths, self.active = spark, {}, {}, None
        self.history: list[str] = []
        self._reports: dict[str, quality.QualityReport] = {}

    def table(self) -> DataFrame:
        if self.active is None:
            raise NotFound("no active table")
        return self.tables[self.active]

    def add(self, name: str, df: DataFrame, path: str = "") -> None:
        self.tables[name], self.paths[name], self.active = df, path, name
        df.createOrReplaceTempView("".join(c if c.isalnum() else "_" for c in name))
        self._reports.pop(name, None)

    def report(self) -> quality.QualityReport:
        if self.active not in self._reports:
            self._reports[self.active] = quality.check(self.table())
        return self._reports[self.active]

    def health(self) -> str:
        """none, or the grade of the active table."""
        return "none" if self.active is None else quality.scorecard(quality.basic_checklist(self.report())).grade

    def prompt(self) -> str:
        return "prep> " if self.active is None else f"{self.active}{' ' + self._grade() if self.active in self._reports else ''}> "

    def _grade(self) -> str:
        return f"[{self.health()}]"

    def complete(self, text: str) -> list[str]:
        """Verbs first, then names of tables and columns."""
        words = text.split(" ")
        pool = sorted(HELP) if len(words) == 1 else [*sorted(self.tables), *(self.table().columns if self.active else [])]
        return [w for w in pool if w.startswith(words[-1])]

    def execute(self, line: str) -> str:
        c = parse(line)
        self.history.append(line)
        if c.verb == "load":
            name = c.args[0].rstrip("/").rsplit("/", 1)[-1].split(".")[0]
            self.add(name, load(self.spark, c.args[0]), c.args[0])
            return f"loaded {name}"
        if c.verb == "datasets":
            return "\n".join(("* " if n == self.active else "  ") + n for n in sorted(self.tables))
        if c.verb == "use":
            if c.args[0] not in self.tables:
                raise NotFound(c.args[0])
            self.active = c.args[0]
            return f"using {self.active}"
        if c.verb == "info":
            return json.dumps(columns.info(self.table()))
        if c.verb == "head":
            return "\n".join(json.dumps(r, default=str) for r in rows.head(self.table(), int(c.args[0]) if c.args else 10).toArrow().to_pylist())
        if c.verb == "schema":
            return "\n".join(f"{f.name}: {f.dataType.simpleString()}" for f in self.table().schema)
        if c.verb == "quality":
            r = self.report() if self.table() is not None else None
            if c.args[0] == "check":
                return "\n".join([f"score {r.score:.1f}", *(f"[{i.severity}] {i.kind} {i.column or ''}".rstrip() for i in r.issues)])
            card = quality.scorecard(quality.basic_checklist(r))
            if "json" in c.flags:
                return card.to_json()
            if "badge" in c.flags:
                return card.badge_url()
            hints = [f"- {x.text}" for x in card.failed()] if "suggest" in c.flags else []
            return "\n".join([f"{card.grade} {card.score:.1f}: {card.decision}", *hints])
        if c.verb == "drift":
            other = self.tables[c.args[1]] if c.args[1] in self.tables else load(self.spark, c.args[1])
            d = drift.report(other, self.table(), ["ks", "psi"])
            return f"drifted: {', '.join(d.drifted_columns) or 'none'}; severity {d.max_severity}"
        if c.verb == "convert":
            path = f"{self.paths[self.active].rsplit('.', 1)[0]}.{c.args[0]}"
            save(self.table(), path)
            return f"wrote {path}"
        if c.verb == "export":
            if c.args[0] == "history":
                return json.dumps(self.history) if "json" in c.flags else "\n".join(self.history)
            r = self.report()
            return json.dumps({"score": r.score, "issues": [vars(i) for i in r.issues]}) if "json" in c.flags else f"score {r.score:.1f}"
        if c.verb == "validate":
            bad = read_schema(c.options["schema"]).validate(self.table()).filter("size(_violations) > 0").count()
            return "valid" if not bad else f"{bad} rows break the schema"
        if c.verb == "history":
            return "\n".join(["#!/usr/bin/env sparkprep", *self.history]) if "export" in c.flags else "\n".join(f"{i + 1} {x}" for i, x in enumerate(self.history))
        if c.verb == "help":
            return HELP.get(c.args[0], "no such topic") if c.args else "\n".join(HELP.values())
        raise EOFError


def loop(spark: SparkSession) -> None:
    s = Session(spark)
    while True:
        try:
            print(s.execute(input(s.prompt())))
        except EOFError:
            return
        except PrepError as e:
            print(f"error: {e}")
