"""The selection-rule language: XML to tables.

A rule is a sequence of word patterns; a word may select or remove translations. ``compile_rules`` fills in macros and named sequences
and sets and lays each rule out as a graph: words are arcs between junctions. An alternation's branches
leave one junction and meet in another, a repetition is a chain whose later junctions may be left early, so nothing is
multiplied out and the rows go with the words of the file (times the copies of a repetition). Alternatives that are single words with the same
operations are one word of several patterns. An anchored rule is a graph of its own that starts at a segment's beginning. Rule files are small;
they are read on the driver."""

from __future__ import annotations

import copy
import re
import warnings
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from itertools import count, product

from pyspark.sql import DataFrame, SparkSession

from ..functions.lu import TAG_CLOSE, TAG_OPEN

ANY, TAG = f"[^{TAG_OPEN}{TAG_CLOSE}]", f"{TAG_OPEN}[^{TAG_CLOSE}]+{TAG_CLOSE}"
LEAST_WEIGHT = -(2**31 - 1)
#: Letters of a key for suffixes and parts.
GRAM = 3
#: Upper-case letters beside upper() whose simple lower case is the letter.
EXTRA_UPPER = {"k": "K", "å": "Å", "ω": "Ω"}
RULES = "rule_id int, weight double, comment string"
PATTERNS = "word_id int, key string, sl_regex string"
ARCS = "graph int, rule_id int, anchored boolean, plain boolean, off int, word_id int, source int, target int, ends boolean, op_text string"
OPS = "op_key string, op_type string, tl_regex string"
OP_TEXTS = "op_text string, op_key string"
#: The streaming form writes rules out as paths; more than so many are refused there.
MOST_PATHS = 20_000


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Word:
    """Patterns (index key, regex), of which one has to match, and operations."""

    patterns: tuple[tuple[str, str], ...]
    ops: tuple[tuple[str, str], ...] = ()


BEGIN = Word((("*", "^"),), (("begin", ""),))


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    low: int
    high: int
    part: Seq


def merged(alternatives: list) -> Either | Word:
    """Alternatives that are single words of the same operations as one word."""
    out: dict = {}
    for x in alternatives:
        while isinstance(x, Seq) and len(x.parts) == 1:
            x = x.parts[0]
        for one in x.parts if isinstance(x, Either) else (x,):
            key = ("word", one.ops) if isinstance(one, Word) else ("other", one)
            if key in out and isinstance(one, Word):
                one = Word(tuple(dict.fromkeys((*out[key].patterns, *one.patterns))), one.ops)
            out[key] = one
    return next(iter(out.values())) if len(out) == 1 else Either(tuple(out.values()))


def op_text(word: Word) -> str:
    return "".join(f"<{kind}>{regex}" for kind, regex in word.ops)


class Graph:
    """A rule's arcs (source, word, target), and which junctions may be passed without a word."""

    def __init__(self, body: Seq):
        self.names, self.arcs, self.free = count(), [], {}
        self.start = next(self.names)
        self.end = self.lay(body, self.start)

    def lay(self, part, at: int) -> int:
        """Arcs for a part from a junction on; the junction where it ends."""
        if isinstance(part, Word):
            to = next(self.names)
            self.arcs.append((at, part, to))
            return to
        if isinstance(part, Seq):
            for x in part.parts:
                at = self.lay(x, at)
            return at
        to = next(self.names)
        if isinstance(part, Either):
            for x in part.parts:
                self.skip(self.lay(x, at), to)
            return to
        for k in range(part.high + 1):
            if k >= part.low:
                self.skip(at, to)
            if k < part.high:
                at = self.lay(part.part, at)
        return to

    def skip(self, a: int, b: int) -> None:
        if a != b:
            self.free.setdefault(a, set()).add(b)

    def reached(self, at: int) -> set[int]:
        out, todo = {at}, [at]
        while todo:
            new = self.free.get(todo.pop(), set()) - out
            out |= new
            todo += new
        return out

    def rows(self, anchored: bool) -> list[tuple[int, Word, int, int, bool]]:
        """(words before, word, source, target, whether the rule may end there) of every arc, for each number of words before it. With
        ``anchored`` the paths behind a begin, else those without one."""
        leaving: dict[int, list] = {}
        for a, w, b in self.arcs:
            leaving.setdefault(a, []).append((w, b))
        now = self.reached(self.start)
        if anchored:
            now = set().union(*(self.reached(b) for a in now for w, b in leaving.get(a, ()) if w == BEGIN))
        out, off = [], 0
        while now:
            after: set[int] = set()
            for a in sorted(now):
                for w, b in leaving.get(a, ()):
                    if w != BEGIN:  # an anchor behind a word can never match
                        # a junction that words leave, or the end: what is passed without a word
                        to = self.reached(b)
                        out += [(off, w, a, x, self.end in self.reached(x)) for x in sorted(to) if x in leaving or x == self.end]
                        after |= to
            now, off = after, off + 1
        return out


@dataclass
class Rules:
    rules: list[tuple] = field(default_factory=list)
    patterns: list[tuple] = field(default_factory=list)
    arcs: list[tuple] = field(default_factory=list)
    ops: dict[str, tuple] = field(default_factory=dict)
    op_texts: dict[str, list[str]] = field(default_factory=dict)
    bodies: list[Seq] = field(default_factory=list)

    @property
    def longest(self) -> int:
        return max((a[4] + 1 for a in self.arcs), default=0)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        make = spark.createDataFrame
        texts = [(t, k) for t, keys in self.op_texts.items() for k in keys]
        return {"rules": make(self.rules, RULES), "patterns": make(self.patterns, PATTERNS), "arcs": make(self.arcs, ARCS), "ops": make(list(self.ops.values()), OPS), "op_texts": make(texts, OP_TEXTS)}

    def paths(self, most: int = MOST_PATHS) -> list[tuple[int, tuple[Word, ...], bool]]:
        """(rule_id, words, anchored) of every way through a rule, for rule sets of modest size."""
        out: list = []

        def ways(part) -> list[tuple[Word, ...]]:
            if isinstance(part, Word):
                return [(part,)]
            if isinstance(part, Either):
                return [w for x in part.parts for w in ways(x)]
            if isinstance(part, Seq):
                combos = [ways(x) for x in part.parts]
            else:
                return list(dict.fromkeys(w for k in range(part.low, part.high + 1) for w in ways(Seq((part.part,) * k))))
            size = 1
            for c in combos:
                size *= len(c)
            if size > most:
                raise RuleError(f"a rule has over {most} paths")
            return [tuple(w for seq in combo for w in seq) for combo in product(*combos)]

        for rule_id, body in enumerate(self.bodies, 1):
            for words in dict.fromkeys(ways(body)):
                anchored = bool(words) and words[0] == BEGIN
                rest = words[1:] if anchored else words
                if rest and BEGIN not in rest:
                    out.append((rule_id, rest, anchored))
            if len(out) > most:
                raise RuleError(f"the rules have over {most} paths")
        return out


def literal(text: str) -> str:
    """A lower-case letter also matches its upper case; an upper-case letter only itself."""
    out = []
    for c in text:
        up = c.upper()
        if c.islower() and len(up) == 1 and up != c:
            out.append(f"[{c}{up}{EXTRA_UPPER.get(c, '')}]")
        else:
            out.append(re.escape(c))
    return "".join(out)


def folded(text: str) -> str:
    """Case-folded as Spark's lower() does it, with one small sigma."""
    return text.lower().replace("ς", "σ")


def lemma_regex(attrs: dict[str, str]) -> tuple[str | None, str]:
    """Index key (null: any lemma) and regex of the lemma's part of a pattern.

    Keys are what every LU that matches has in common with the pattern: l and the lemma, s and the last GRAM letters of a suffix, c and GRAM letters of a
    part, all lower-case; shorter suffixes and parts have shorter keys. LUs and patterns meet by keys, the regex decides."""
    given = [a for a in ("lemma", "suffix", "contains", "case") if a in attrs]
    if len(given) > 1:
        raise RuleError(f"only one of {', '.join(given)} may be given")
    if "surface" in attrs:
        warnings.warn("surface is accepted and has no effect", stacklevel=2)
    if "suffix" in attrs:
        return (f"s{folded(attrs['suffix'])[-GRAM:]}" if attrs["suffix"] else None), f"{ANY}*{literal(attrs['suffix'])}"
    if "contains" in attrs:
        low = folded(attrs["contains"])
        return (f"c{low[len(low) // 2 - len(low[:GRAM]) // 2 :][:GRAM]}" if low else None), f"{ANY}*{literal(attrs['contains'])}{ANY}*"
    if "case" in attrs:
        return None, "".join(r"\p{Lu}+" if c.isupper() else f"[^\\p{{Lu}}{TAG_OPEN}{TAG_CLOSE}]+" for c in attrs["case"])
    value = attrs.get("lemma", "*")
    return (None, f"{ANY}+") if value == "*" else (f"l{folded(value)}", literal(value))


def first_tag_key(tags: str) -> str:
    """Key of a pattern for any lemma: t and its first tag, or * where that is open."""
    first = tags.split(".")[0]
    return "*" if first in ("*", "+", "?") else f"t{first}"


def tags_regex(value: str, star: bool) -> str:
    if value == "":
        return ""
    part = {"*": f"(?:{TAG}){'*' if star else '+'}", "+": f"(?:{TAG})+", "?": TAG}
    return "".join(part.get(t, f"{TAG_OPEN}{re.escape(t)}{TAG_CLOSE}") for t in value.split("."))


class _Compiler:
    def __init__(self):
        self.star, self.sequences, self.sets, self.macros, self.out = False, {}, {}, {}, Rules()
        self.word_ids, self.graphs = {}, count(1)

    def pattern(self, attrs: dict[str, str]) -> tuple[str | None, str]:
        key, lemma = lemma_regex(attrs)
        key = key or first_tag_key(attrs.get("tags", "*"))
        return key, f"^{lemma}{tags_regex(attrs.get('tags', '*'), self.star)}$"

    def glob(self, node: ET.Element) -> None:
        self.star = self.star or node.get("glob") == "star"

    def body(self, nodes) -> Seq:
        return Seq(tuple(self.node(n) for n in nodes))

    def node(self, n: ET.Element):
        if n.tag == "match":
            return self.match(n)
        if n.tag == "or":
            return merged([self.node(child) for child in n])
        if n.tag == "repeat":
            low, high = int(n.get("from", 0)), int(n.get("upto", 0))
            if low < 0 or low > high:
                raise RuleError(f"repeat from {low} upto {high}")
            return Repeat(low, high, self.body(n))
        if n.tag == "seq":
            if n.get("n") not in self.sequences:
                raise RuleError(f"sequence {n.get('n')} is not defined before its use")
            return self.sequences[n.get("n")]
        if n.tag == "set":
            if n.get("n") not in self.sets:
                raise RuleError(f"set {n.get('n')} is not defined before its use")
            lemmas, own = self.sets[n.get("n")]
            return merged([Word((self.pattern({"lemma": x, "tags": n.get("tags", own)}),)) for x in lemmas])
        if n.tag == "begin":
            return BEGIN
        raise RuleError(f"{n.tag} may not stand in a rule")

    def match(self, n: ET.Element) -> Word:
        ops = []
        for o in n:
            if o.tag not in ("select", "remove"):
                raise RuleError(f"{o.tag} may not stand in match")
            ops.append((o.tag, self.pattern(o.attrib)[1]))
        return Word((self.pattern(n.attrib),), tuple(ops))

    def rule(self, n: ET.Element) -> None:
        weight = float(n.get("weight", 1.0))
        rule_id = len(self.out.rules) + 1
        self.out.rules.append((rule_id, 1.0 if weight <= LEAST_WEIGHT else weight, n.get("c")))
        body = self.body(n)
        self.out.bodies.append(body)
        laid = Graph(body)
        for anchored in (False, True):
            rows = laid.rows(anchored)
            graph, offs = next(self.graphs), [r[0] for r in rows]
            # one arc at each place, and an end at the last alone: every word has to match
            plain = len(set(offs)) == len(offs) and [r[4] for r in rows] == [False] * (len(rows) - 1) + [True] * bool(rows)
            for off, w, source, target, ends in rows:
                for kind, regex in w.ops:
                    key = f"<{kind}>{regex}"
                    self.out.ops[key] = (key, kind, regex)
                    self.out.op_texts.setdefault(op_text(w), [])
                    if key not in self.out.op_texts[op_text(w)]:
                        self.out.op_texts[op_text(w)].append(key)
                self.out.arcs.append((graph, rule_id, anchored, plain, off, self.word(w), source, target, ends, op_text(w)))

    def word(self, w: Word) -> int:
        """A word's number; equal patterns are one word."""
        own = frozenset(w.patterns)
        if own not in self.word_ids:
            self.word_ids[own] = len(self.word_ids) + 1
            self.out.patterns += [(self.word_ids[own], key, regex) for key, regex in w.patterns]
        return self.word_ids[own]

    # macros
    def fill(self, node: ET.Element, strings: list[str], nodes: list[list[ET.Element]]) -> list[ET.Element]:
        """A template's node with its parameters put in."""
        if node.tag == "param":
            at = int(node.get("n", 0))
            if not 1 <= at <= len(nodes):
                raise RuleError(f"node parameter {at} of {len(nodes)}")
            return copy.deepcopy(nodes[at - 1])
        out = ET.Element(node.tag)
        for a, v in node.attrib.items():
            if a.startswith("p"):
                if not v.isdigit() or not 1 <= int(v) <= len(strings):
                    raise RuleError(f"string parameter {v} of {len(strings)}")
                out.set(a[1:], strings[int(v) - 1])
            else:
                out.set(a, v)
        out.text = node.text
        for child in node:
            out.extend(self.fill(child, strings, nodes))
        return [out]

    def macro(self, n: ET.Element) -> None:
        if n.get("n") not in self.macros:
            raise RuleError(f"macro {n.get('n')} is not defined")
        made = self.macros[n.get("n")]
        strings = [p.get("v") for p in n if p.get("v") is not None]
        nodes = [list(p) for p in n if p.get("v") is None]
        if len(strings) != int(made.get("npar", 0)) or len(nodes) != int(made.get("nodes", 0)):
            raise RuleError(f"macro {n.get('n')} takes {made.get('npar', 0)} strings and {made.get('nodes', 0)} nodes")
        for child in made:
            for filled in self.fill(child, strings, nodes):
                self.top(filled)

    def top(self, n: ET.Element) -> None:
        self.glob(n)
        if n.tag in ("lrx", "rules", "def-seqs", "def-macros"):
            for child in n:
                self.top(child)
        elif n.tag == "rule":
            self.rule(n)
        elif n.tag == "macro":
            self.macro(n)
        elif n.tag == "def-seq":
            self.sequences[n.get("n")] = self.body(n)
        elif n.tag == "def-set":
            self.sets[n.get("n")] = ([x.text or "" for x in n.iter("lemma")], n.get("tags", "*"))
        elif n.tag == "def-macro":
            if n.get("n") in self.macros:
                raise RuleError(f"macro {n.get('n')} is defined twice")
            self.macros[n.get("n")] = n
        else:
            raise RuleError(f"{n.tag} is unknown")


def compile_rules(xml: str) -> Rules:
    """Rules from the text of an XML file; ids are ordinals in order of expansion."""
    compiler = _Compiler()
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        raise RuleError(str(e)) from e
    compiler.top(root)
    return compiler.out
