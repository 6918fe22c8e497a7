"""Path patterns as Spark columns.

A pattern is ``Name <glob>``, ``Path <glob>``, ``BelowPath <glob>`` or
``Regex <expression>``; a bare text means ``Name``. Patterns are compiled once
on the driver; what reaches the executors is one regular expression per scope,
evaluated inside code generation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.config import OWN_ENTRIES
from concordat.functions import paths as P

_SCOPES = {"Name": "name", "Path": "path", "BelowPath": "below", "Regex": "regex"}

_GLOB_TOKEN = re.compile(
    r"\\(?P<escaped>.)"
    r"|\[(?P<negated>!?)(?P<members>(?:\\.|[^\]\\])+)\]"
    r"|(?P<char>.)",
    re.DOTALL,
)


def _class_text(members: str) -> str:
    plain = re.sub(r"\\(.)", lambda m: "\\" + m[1] if not m[1].isalnum() else m[1], members)
    return re.sub(r"(?<!\\)([\[\]^&~|])", r"\\\1", plain)


def glob_pattern(glob: str, component: bool = False) -> str:
    """Regular expression text for a glob: ``*`` and ``?`` stop at ``/``,
    ``[a-z]``, ``[!x]``, nested ``{a,b}`` and ``\\`` escapes are understood.
    With ``component`` a negated class does not match ``/`` either."""
    out, depth = [], 0
    for token in _GLOB_TOKEN.finditer(glob):
        char = token["char"]
        if token["escaped"] is not None:
            out.append(re.escape(token["escaped"]))
        elif token["members"] is not None:
            head = ("^/" if component else "^") if token["negated"] else ""
            out.append(f"[{head}{_class_text(token['members'])}]")
        elif char == "{":
            depth += 1
            out.append("(?:")
        elif char == "}" and depth:
            depth -= 1
            out.append(")")
        elif char == "," and depth:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(char, re.escape(char)))
    return "".join(out) + ")" * depth


@dataclass(frozen=True)
class PathPattern:
    scope: str
    text: str

    @classmethod
    def parse(cls, spec: str) -> "PathPattern":
        spec = spec.strip()
        head = re.match(r"(Name|Path|BelowPath|Regex)[ \t]", spec)
        if head:
            return cls(_SCOPES[head[1]], spec[head.end():].strip())
        return cls("name", spec)


def _by_scope(specs: Iterable[str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for spec in specs:
        pattern = PathPattern.parse(spec)
        found.setdefault(pattern.scope, []).append(pattern.text)
    return found


def _either(parts: list[Column]) -> Column:
    if not parts:
        return F.lit(False)
    out = parts[0]
    for part in parts[1:]:
        out = out | part
    return out


def _alternatives(globs: list[str], component: bool = False) -> str:
    return "(?:" + "|".join(glob_pattern(g, component) for g in globs) + ")"


def match_name(path: Column, *globs: str) -> Column:
    """The last component matches one of the globs."""
    return P.name(path).rlike(rf"\A{_alternatives(list(globs))}\z")


def match_path(path: Column, *globs: str) -> Column:
    """The whole path matches one of the globs."""
    return path.rlike(rf"\A{_alternatives(list(globs))}\z")


def match_below(path: Column, *globs: str) -> Column:
    """The path or one of its ancestors matches one of the globs."""
    return path.rlike(rf"\A{_alternatives(list(globs))}(?:/[\s\S]*)?\z")


def match_regex(path: Column, *expressions: str) -> Column:
    """One of the expressions is found anywhere in the path."""
    return _either([path.rlike(e) for e in expressions])


def any_of(path: Column, specs: Iterable[str]) -> Column:
    """At least one pattern matches; no patterns match nothing."""
    tests = {"name": match_name, "path": match_path, "below": match_below, "regex": match_regex}
    return _either([tests[scope](path, *texts) for scope, texts in _by_scope(specs).items()])


def first_match(path: Column, rules: Iterable[tuple[str, Column]]) -> Column:
    """Value of the first rule whose pattern matches, else null."""
    chain = None
    for spec, value in rules:
        test = any_of(path, [spec])
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return F.lit(None) if chain is None else chain


def ignored(path: Column, ignore: Iterable[str], ignore_not: Iterable[str] = (),
            own: Iterable[str] = OWN_ENTRIES) -> Column:
    """The entry itself is ignored. The root never is; exceptions win over the
    built-in and the given patterns. Ancestors are not looked at."""
    drop = any_of(path, [*own, *ignore])
    keep = (path == "") | any_of(path, ignore_not)
    return drop & ~keep


def ignored_or_below(path: Column, ignore: Iterable[str], ignore_not: Iterable[str] = (),
                     own: Iterable[str] = OWN_ENTRIES) -> Column:
    """The entry or any of its ancestors is ignored; an exception on a child
    does not rescue it from an ignored parent.

    Without exceptions, globs are tested against all ancestors at once by one
    expression that may end at any component. Exceptions and free regular
    expressions need the ancestors one by one.
    """
    specs, ignore_not = [*own, *ignore], list(ignore_not)
    if ignore_not:
        return F.exists(P.ancestors(path), lambda a: ignored(a, specs, ignore_not, own=()))
    tests, scopes = [], _by_scope(specs)
    names = [g for g in scopes.get("name", []) if "/" not in g]
    if names:
        tests.append(path.rlike(rf"(?:\A|/){_alternatives(names, True)}(?:/|\z)"))
    rooted = scopes.get("path", []) + scopes.get("below", [])
    if rooted:
        tests.append(path.rlike(rf"\A{_alternatives(rooted)}(?:/|\z)"))
    if "regex" in scopes:
        tests.append(F.exists(P.ancestors(path), lambda a: match_regex(a, *scopes["regex"])))
    return (path != "") & _either(tests)
