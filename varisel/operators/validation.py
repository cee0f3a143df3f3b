"""Whether a rule file has the language's structure: faults with their place.

Each element's children are read as a sequence of names by its content model, an automaton; attributes, names that are defined twice and
names that are used without definition are checked too. The compiler is more lenient in one point: it takes several operations in one match."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.parsers import expat

from .rules import RuleError, compile_rules

# Fixed values of the rule language: children of each element, and its attributes; those with ! are required.
_BODY = "match|or|repeat|seq|begin|param|set"
CHILDREN = {
    "lrx": "(rules|def-macros|def-seqs)*", "rules": "(rule|macro)*", "def-macros": "(def-macro)*", "def-macro": "(rule|macro)*", "def-seqs": "(def-seq|def-set)+",
    "def-seq": "(match|or|repeat|seq|begin)*", "def-set": "(lemma)*", "lemma": "text", "rule": f"({_BODY})*", "or": f"({_BODY})*", "repeat": f"({_BODY})*", "begin": "", "seq": "", "set": "",
    "macro": "(with-param)*", "with-param": f"({_BODY})*", "param": "", "match": "(select|remove)?", "select": "", "remove": "",
}
_WORD = "lemma suffix contains case surface tags plemma psuffix pcontains pcase psurface ptags"
ATTRIBUTES = {
    "lrx": "glob", "rules": "glob", "def-macro": "n! nodes npar", "def-seq": "n!", "def-set": "n! tags", "rule": "weight c v pweight", "repeat": "from upto pfrom pupto", "seq": "n pn",
    "set": "n pn tags ptags", "macro": "n pn", "with-param": "v pv", "param": "n pn", "match": _WORD, "select": _WORD, "remove": _WORD,
}
VALUES = {("lrx", "glob"): ("plus", "star"), ("rules", "glob"): ("plus", "star")}
DEFINES, USES = ("def-macro", "def-seq", "def-set"), ("seq", "set", "macro")


def _automaton(model: str) -> re.Pattern:
    """A content model over names that a blank ends."""
    return re.compile(re.sub(r"[a-z-]+", lambda m: f"{m[0]} ", model) + r"\Z")


MODELS = {name: _automaton(m) for name, m in CHILDREN.items() if m != "text"}


@dataclass
class Fault:
    line: int
    column: int
    element: str
    what: str

    def __str__(self) -> str:
        return f"line {self.line}, column {self.column}, {self.element}: {self.what}"


@dataclass
class _Open:
    name: str
    line: int
    column: int
    children: list[str] = field(default_factory=list)
    text: bool = False


class _Checker:
    def __init__(self):
        self.parser = expat.ParserCreate()
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.data
        self.open, self.faults, self.defined, self.used = [], [], {}, []

    def fault(self, at: _Open, what: str) -> None:
        self.faults.append(Fault(at.line, at.column, at.name, what))

    def start(self, name: str, attrs: dict[str, str]) -> None:
        here = _Open(name, self.parser.CurrentLineNumber, self.parser.CurrentColumnNumber + 1)
        if self.open:
            self.open[-1].children.append(name)
        self.open.append(here)
        if name not in CHILDREN:
            self.fault(here, "unknown element")
            return
        allowed = ATTRIBUTES.get(name, "").split()
        for a, v in attrs.items():
            if a not in [x.rstrip("!") for x in allowed]:
                self.fault(here, f"unknown attribute {a}")
            if v not in VALUES.get((name, a), (v,)):
                self.fault(here, f"{a} may not be {v}")
        for a in (x[:-1] for x in allowed if x.endswith("!")):
            if a not in attrs:
                self.fault(here, f"attribute {a} is missing")
        if name in DEFINES and "n" in attrs:
            if attrs["n"] in self.defined:
                self.fault(here, f"{attrs['n']} is defined twice")
            self.defined[attrs["n"]] = here
        if name in USES and "n" in attrs:
            self.used.append((attrs["n"], here))

    def end(self, name: str) -> None:
        here = self.open.pop()
        if name not in MODELS:
            if name == "lemma" and here.children:
                self.fault(here, "may hold text only")
            return
        if here.text:
            self.fault(here, "may not hold text")
        if not MODELS[name].match("".join(f"{c} " for c in here.children)):
            first = next((c for i, c in enumerate(here.children) if c in CHILDREN and not self.begins(name, here.children[: i + 1])), None)
            self.fault(here, f"{first} may not stand here" if first else f"children have to be {CHILDREN[name] or 'none'}")

    @staticmethod
    def begins(name: str, children: list[str]) -> bool:
        return bool(MODELS[name].match("".join(f"{c} " for c in children)))

    def data(self, text: str) -> None:
        if self.open and (text.strip() or CHILDREN.get(self.open[-1].name) == ""):
            self.open[-1].text = True

    def check(self, xml: str) -> list[Fault]:
        try:
            self.parser.Parse(xml.encode(), True)
        except expat.ExpatError as e:
            return [*self.faults, Fault(e.lineno, e.offset + 1, self.open[-1].name if self.open else "", expat.ErrorString(e.code))]
        for name, at in self.used:
            if name not in self.defined:
                self.fault(at, f"{name} is not defined")
        return sorted(self.faults, key=lambda f: (f.line, f.column))


def faults(xml: str) -> list[Fault]:
    """Structural faults of a rule file, in order; none if it is valid."""
    return _Checker().check(xml)


def validate_rules(xml: str) -> list[str]:
    """Structural faults as text, and what the compiler refuses beyond them."""
    found = [str(f) for f in faults(xml)]
    try:
        compile_rules(xml)
    except (RuleError, ValueError) as e:
        found.append(str(e))
    return found
