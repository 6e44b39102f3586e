"""Configuration: JSON with comments, the tree of monitoring objects, and cloning of templates.

A monitoring object is a folder with a file mo.conf; folders within it are its children, which see only
the flows that it matches. Its name is its path with _ for /; a window's table is called after both.
"""

from __future__ import annotations

import json
import os
import re
import shutil
from dataclasses import dataclass, field

from . import dsl

_COMMENT = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
_TRAILING = re.compile(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', re.S)
TEMPLATE_MARK = "//!tmpl"


def loads(text: str):
    """JSON that may hold // and /* */ comments and a comma behind the last item."""
    text = _COMMENT.sub(lambda m: m[0] if m[0].startswith('"') else " ", text)
    return json.loads(_TRAILING.sub(lambda m: m[1] or m[2], text))


@dataclass
class Window:
    name: str
    fields: list[str]
    seconds: int = 30
    limit: int = 0
    extended: bool = False
    index: bool = True


@dataclass
class Limit:
    """default: one limit for each counter of the moving average; ext: windows to count while an alert lasts."""

    name: str
    default: list[float]
    file: str | None = None
    action: str | None = None
    back_action: str | None = None
    back_to_norm: int = 30
    ext: list[str] = field(default_factory=list)


@dataclass
class Average:
    name: str
    fields: list[str]
    seconds: int = 5
    dump: int = 0
    memory_mb: int = 256
    over: list[Limit] = field(default_factory=list)
    under: list[Limit] = field(default_factory=list)


@dataclass
class Classifier:
    number: int
    fields: list[str]
    value: str
    percent: int
    seconds: int = 30


@dataclass
class MonitoringObject:
    name: str
    filter: str = ""
    windows: list[Window] = field(default_factory=list)
    averages: list[Average] = field(default_factory=list)
    classifiers: list[Classifier] = field(default_factory=list)
    dump_flows: str = "none"
    children: list["MonitoringObject"] = field(default_factory=list)
    path: str | None = None
    changed: float = 0.0

    def walk(self, parent: "MonitoringObject | None" = None):
        """(object, the object above it) of it and all below it, parents first."""
        yield self, parent
        for child in self.children:
            yield from child.walk(self)

    def table(self, window: str) -> str:
        return f"{self.name}_{window}"


def _limits(items: list[dict], folder: str | None) -> list[Limit]:
    out = []
    for x in items:
        file = x.get("limits")
        if file and folder and not os.path.isabs(file):
            file = os.path.join(folder, file)
        out.append(Limit(x["name"], [float(v) for v in x.get("default", [])], file, x.get("action-script"), x.get("back2norm-script"), int(x.get("back2norm-time", 30)), list(x.get("ext", []))))
    return out


def monitoring_object(conf: dict, name: str, path: str | None = None) -> MonitoringObject:
    """The object of one mo.conf; filters and fields are parsed, so errors show at once."""
    folder = os.path.dirname(path) if path else None
    windows = [Window(w["name"], list(w["fields"]), int(w.get("time", 30)), int(w.get("limit", 0)), bool(w.get("extended", False)), bool(w.get("create-index", True))) for w in conf.get("fwm", [])]
    averages = [
        Average(
            a["name"], list(a["fields"]), int(a.get("time", 5)), int(a.get("dump", 0)), int(a.get("mem-m", 256)),
            _limits(a.get("overlimit", []), folder), _limits(a.get("underlimit", []), folder)
        )
        for a in conf.get("mavg", [])
    ]
    classifiers = [
        Classifier(int(c.get("id", k)), list(c["fields"]), c["val"], int(c.get("top-percents", 0)), int(c.get("time", 30))) for k,
        c in enumerate(conf.get("classification", []))
    ]
    out = MonitoringObject(name, conf.get("filter", ""), windows, averages, classifiers, conf.get("debug", {}).get("dump-flows", "none"), path=path)
    dsl.parse(out.filter)
    for fields in [w.fields for w in windows] + [a.fields for a in averages] + [c.fields for c in classifiers]:
        for text in fields:
            dsl.parse_rule(text)
    if any(not 0 <= c.number <= 4 for c in classifiers):
        raise ValueError(f"{name}: classifiers are numbered 0 to 4")
    return out


def load_tree(folder: str, name: str = "") -> list[MonitoringObject]:
    """The monitoring objects in a folder, with their children, by name; hidden folders are left out."""
    out = []
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        if entry.name.startswith(".") or not entry.is_dir():
            continue
        path = os.path.join(entry.path, "mo.conf")
        own = f"{name}_{entry.name}" if name else entry.name
        if not os.path.isfile(path):
            continue
        with open(path) as f:
            mo = monitoring_object(loads(f.read()), own, path)
        mo.changed = os.stat(path).st_mtime
        mo.children = load_tree(entry.path, own)
        out.append(mo)
    return out


def reload_limits(tree: list[MonitoringObject]) -> list[str]:
    """Reads the limits of objects whose file has changed since; other parts stay. Returns their names."""
    changed = []
    for root in tree:
        for mo, _ in root.walk():
            if mo.path and os.path.isfile(mo.path) and os.stat(mo.path).st_mtime != mo.changed:
                with open(mo.path) as f:
                    new = monitoring_object(loads(f.read()), mo.name, mo.path)
                by_name = {a.name: a for a in new.averages}
                for a in mo.averages:
                    if a.name in by_name:
                        a.over, a.under = by_name[a.name].over, by_name[a.name].under
                mo.changed = os.stat(mo.path).st_mtime
                changed.append(mo.name)
    return changed


def replacements(text: str) -> dict[str, str]:
    """A=B;C=D as a dictionary."""
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in text.split(";") if x.strip())}


def clone_text(text: str, values: dict[str, str]) -> str:
    """A configuration whose template lines are filled in: each stays, and what it makes takes the place of the line after it.

    A template that names an unknown macro is left as it is, with the line after it.
    """
    out, skip = [], False
    for line in text.splitlines(keepends=True):
        if skip:
            skip = False
            continue
        out.append(line)
        if TEMPLATE_MARK in line:
            made = line.replace(TEMPLATE_MARK, "", 1)
            for k, v in values.items():
                made = made.replace("${" + k + "}", v)
            if "${" not in made:
                out.append(made)
                skip = True
    return "".join(out)


def clone_tree(source: str, target: str, values: dict[str, str]) -> None:
    """Copies a folder of configurations with their templates filled in; hidden files are left out."""
    os.makedirs(target, exist_ok=True)
    for entry in os.scandir(source):
        if entry.name.startswith("."):
            continue
        to = os.path.join(target, entry.name)
        if entry.is_dir():
            clone_tree(entry.path, to, values)
        elif entry.is_file():
            with open(entry.path) as f, open(to, "w") as g:
                g.write(clone_text(f.read(), values))
            shutil.copymode(entry.path, to)
