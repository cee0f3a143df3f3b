"""Rules on small texts of our own: (rules, text, expected)."""

import random

import pytest

from pyspark.sql import functions as F

from varisel.operators import matching
from varisel.operators.matching import apply_rules, apply_to_text, apply_to_units, parse_segments, trace_rules
from varisel.operators.rules import RuleError, compile_rules, op_text
from varisel.operators.validation import faults, validate_rules

CASES = {
    "select": ('<rules><rule><match lemma="bank"><select lemma="orilla"/></match></rule></rules>', "^bank<n>/banco<n>/orilla<n>$", "^bank<n>/orilla<n>$"),
    "context and blanks": (
        '<rules><rule><match lemma="river"/><match lemma="bank" tags="n.*"><select lemma="orilla" tags="n.*"/></match></rule></rules>',
        "[ \\$1 ]^River<n>/río<n>$[x]^bank<n><sg>/banco<n><sg>/orilla<n><sg>$ ^bank<n><sg>/banco<n><sg>/orilla<n><sg>$ end\n",
        "[ \\$1 ]^River<n>/río<n>$[x]^bank<n><sg>/orilla<n><sg>$ ^bank<n><sg>/banco<n><sg>/orilla<n><sg>$ end\n",
    ),
    "heavier wins": ('<rules><rule weight="1"><match lemma="a"><select lemma="x"/></match></rule><rule weight="2"><match lemma="a"><select lemma="y"/></match></rule></rules>', "^a<n>/x<n>/y<n>$", "^a<n>/y<n>$"),
    "weights add up": (
        '<rules><rule weight="1"><match lemma="a"><select lemma="x"/></match></rule><rule weight="1"><match lemma="a"><select lemma="x"/></match><match lemma="b"/></rule><rule weight="1.5"><match lemma="a"><select lemma="y"/></match></rule></rules>',
        "^a<n>/x<n>/y<n>$ ^b<n>/b<n>$",
        "^a<n>/x<n>$ ^b<n>/b<n>$",
    ),
    "remove, then select of the removed": ('<rules><rule weight="3"><match lemma="a"><remove lemma="x"/></match></rule><rule weight="1"><match lemma="a"><select lemma="x"/></match></rule></rules>', "^a<n>/x<n>/y<n>/z<n>$", "^a<n>/y<n>/z<n>$"),
    "the last is not removed": ('<rules><rule><match lemma="a"><remove tags="*"/></match></rule></rules>', "^a<n>/x<n>/y<n>$", "^a<n>/y<n>$"),
    "or": ('<rules><rule><or><match lemma="b"/><match lemma="c"/></or><match lemma="a"><select lemma="y"/></match></rule></rules>', "^b<n>/b<n>$ ^a<n>/x<n>/y<n>$ ^d<n>/d<n>$ ^a<n>/x<n>/y<n>$", "^b<n>/b<n>$ ^a<n>/y<n>$ ^d<n>/d<n>$ ^a<n>/x<n>/y<n>$"),
    "repeat": ('<rules><rule><match lemma="a"><select lemma="y"/></match><repeat from="1" upto="2"><match tags="adv"/></repeat><match lemma="z"/></rule></rules>', "^a<n>/x<n>/y<n>$ ^q<adv>/q<adv>$ ^q<adv>/q<adv>$ ^z<n>/z<n>$ ^a<n>/x<n>/y<n>$ ^z<n>/z<n>$", "^a<n>/y<n>$ ^q<adv>/q<adv>$ ^q<adv>/q<adv>$ ^z<n>/z<n>$ ^a<n>/x<n>/y<n>$ ^z<n>/z<n>$"),
    "case": ('<rules><rule><match lemma="a"><select lemma="y"/></match><match case="Aa" tags=""/></rule></rules>', "^a<n>/x<n>/y<n>$ ^*Rome/*Rome$ ^a<n>/x<n>/y<n>$ ^*rome/*rome$", "^a<n>/y<n>$ ^*Rome/*Rome$ ^a<n>/x<n>/y<n>$ ^*rome/*rome$"),
    "upper pattern, lower input": ('<rules><rule><match lemma="Terra"><select lemma="y"/></match></rule></rules>', "^terra<n>/x<n>/y<n>$ ^TERRA<n>/x<n>/y<n>$", "^terra<n>/x<n>/y<n>$ ^TERRA<n>/y<n>$"),
    "suffix and contains": ('<rules><rule><match suffix="ing"><select contains="mm"/></match></rule></rules>', "^ring<v>/x<v>/hammer<v>$ ^rings<v>/x<v>/hammer<v>$", "^ring<v>/hammer<v>$ ^rings<v>/x<v>/hammer<v>$"),
    "globs": ('<lrx glob="star"><rules><rule><match lemma="a" tags="n.*"><select lemma="y" tags="?.pl"/></match></rule></rules></lrx>', "^a<n>/x<n><sg>/y<n><pl>$ ^a<v>/x<n><sg>/y<n><pl>$", "^a<n>/y<n><pl>$ ^a<v>/x<n><sg>/y<n><pl>$"),
    "begin": ('<rules><rule weight="2"><begin/><match lemma="a"><select lemma="y"/></match></rule><rule weight="1"><match lemma="a"><select lemma="x"/></match></rule></rules>', "^a<n>/x<n>/y<n>$ ^a<n>/x<n>/y<n>$", "^a<n>/y<n>$ ^a<n>/x<n>$"),
    "sequences, sets": (
        '<lrx><def-seqs><def-seq n="s"><or><match lemma="b"/><match lemma="c"/></or></def-seq><def-set n="t" tags="n"><lemma>d</lemma><lemma>e</lemma></def-set></def-seqs><rules><rule><seq n="s"/><match lemma="a"><select lemma="y"/></match><set n="t"/></rule></rules></lrx>',
        "^c<x>/c<x>$ ^a<n>/x<n>/y<n>$ ^e<n>/e<n>$ ^b<x>/b<x>$ ^a<n>/x<n>/y<n>$ ^e<v>/e<v>$",
        "^c<x>/c<x>$ ^a<n>/y<n>$ ^e<n>/e<n>$ ^b<x>/b<x>$ ^a<n>/x<n>/y<n>$ ^e<v>/e<v>$",
    ),
    "macros": (
        '<lrx><def-macros><def-macro n="m" npar="1" nodes="1"><rule><param n="1"/><match plemma="1"><select lemma="y"/></match></rule></def-macro></def-macros><rules><macro n="m"><with-param v="a"/><with-param><match lemma="b"/></with-param></macro></rules></lrx>',
        "^b<n>/b<n>$ ^a<n>/x<n>/y<n>$",
        "^b<n>/b<n>$ ^a<n>/y<n>$",
    ),
    "escapes": ('<rules><rule><match lemma="$"><select lemma="y"/></match></rule></rules>', "^\\$<sym>/x<n>/y<n>$", "^\\$<sym>/y<n>$"),
    "across lines": ('<rules><rule><match lemma="b"/><match lemma="a"><select lemma="y"/></match></rule></rules>', "^b<n>/b<n>$\n^a<n>/x<n>/y<n>$\n", "^b<n>/b<n>$\n^a<n>/y<n>$\n"),
    "any lemma, one tag": ('<rules><rule><match lemma="*" tags="n.?"/><match lemma="a" tags="+"><select lemma="y" tags="n.?"/></match></rule></rules>', "^q<n><sg>/q<n>$ ^a<n>/x<n><pl>/y<n><pl>$ ^q<n>/q<n>$ ^a<n>/x<n><pl>/y<n><pl>$", "^q<n><sg>/q<n>$ ^a<n>/y<n><pl>$ ^q<n>/q<n>$ ^a<n>/x<n><pl>/y<n><pl>$"),
    "no tags are unknown words": ('<rules><rule><match tags=""/><match lemma="a"><select lemma="y"/></match></rule></rules>', "^*q/*q$ ^a<n>/x<n>/y<n>$ ^q<n>/q<n>$ ^a<n>/x<n>/y<n>$", "^*q/*q$ ^a<n>/y<n>$ ^q<n>/q<n>$ ^a<n>/x<n>/y<n>$"),
    "several removes": ('<rules><rule><match lemma="a"><remove lemma="x"/><remove lemma="z"/></match></rule></rules>', "^a<n>/x<n>/y<n>/z<n>$", "^a<n>/y<n>$"),
    "sets by weight": (
        '<lrx><def-seqs><def-set n="t"><lemma>d</lemma><lemma>e</lemma></def-set></def-seqs><rules><rule weight="1"><set n="t"/><match lemma="a"><select lemma="x"/></match></rule><rule weight="4"><set n="t" tags="v"/><match lemma="a"><select lemma="y"/></match></rule></rules></lrx>',
        "^d<n>/d<n>$ ^a<n>/x<n>/y<n>$ ^e<v>/e<v>$ ^a<n>/x<n>/y<n>$ ^f<v>/f<v>$ ^a<n>/x<n>/y<n>$",
        "^d<n>/d<n>$ ^a<n>/x<n>$ ^e<v>/e<v>$ ^a<n>/y<n>$ ^f<v>/f<v>$ ^a<n>/x<n>/y<n>$",
    ),
    "alternatives with operations": ('<rules><rule><or><match lemma="a"><select lemma="y"/></match><match lemma="b"/></or><match lemma="c"><select lemma="q"/></match></rule></rules>', "^a<n>/x<n>/y<n>$ ^c<n>/p<n>/q<n>$ ^b<n>/x<n>/y<n>$ ^c<n>/p<n>/q<n>$", "^a<n>/y<n>$ ^c<n>/q<n>$ ^b<n>/x<n>/y<n>$ ^c<n>/q<n>$"),
    "a slash in a tag, an escaped backslash": ('<rules><rule><match lemma="a"><select lemma="y"/></match></rule></rules>', "^a<n>/x<p/q>/y<p/q>$ ^b\\\\/x<n>/y<n>$", "^a<n>/y<p/q>$ ^b\\\\/x<n>/y<n>$"),
    "no translation": ("<rules/>", "^a<n>$ ^b<n>/$", "^a<n>/$ ^b<n>/$"),
}


def test_cases(spark):
    for name, (xml, text, expected) in CASES.items():
        segment = spark.createDataFrame([(7, text)], "segment_id long, text string")
        rules = compile_rules(xml)
        assert apply_to_text(segment, rules).first().text == expected, name
        from varisel.functions import lu
        from pyspark.sql import functions as F

        streamed = segment.select(F.concat(lu.render_units(apply_to_units(lu.parse_units(F.col("text")), rules)), lu.trailing(F.col("text"))).alias("text")).first().text
        assert streamed == expected, name


def test_segments_are_apart(spark):
    rules = compile_rules('<rules><rule><match lemma="b"/><match lemma="a"><select lemma="y"/></match></rule></rules>')
    rows = spark.createDataFrame([(1, "^b<n>/b<n>$"), (2, "^a<n>/x<n>/y<n>$")], "segment_id long, text string")
    assert {r.text for r in apply_to_text(rows, rules).collect()} == {"^b<n>/b<n>$", "^a<n>/x<n>/y<n>$"}


def test_properties(spark):
    """Without rules nothing changes; output translations are some of the input's, never none; the order of
    rules of different weights does not matter."""
    rng = random.Random(5)
    lemmas = "abcde"
    lus = [(s, p, " ", f"{rng.choice(lemmas)}<n>", [f"{x}<n>" for x in "uvw"[: rng.randint(1, 3)]]) for s in range(6) for p in range(20)]
    df = spark.createDataFrame(lus, "segment_id long, pos int, blank string, sl string, tls array<string>")
    assert apply_rules(df, compile_rules("<rules/>")).count() == len(lus)
    rules = [f'<rule weight="{1 + i * 0.37}"><match lemma="{rng.choice(lemmas)}"/><match lemma="{rng.choice(lemmas)}"><{rng.choice(["select", "remove"])} lemma="{rng.choice("uvw")}"/></match></rule>' for i in range(12)]
    out = []
    for order in (rules, rules[::-1]):
        got = {(r.segment_id, r.pos): r.tls for r in apply_rules(df, compile_rules(f"<rules>{''.join(order)}</rules>")).collect()}
        out.append(got)
    assert out[0] == out[1]
    for s, p, _, _, tls in lus:
        kept = out[0][s, p]
        assert kept and [t for t in tls if t in kept] == kept
    steps = trace_rules(df, compile_rules(f"<rules>{''.join(rules)}</rules>")).collect()
    left = {}
    for t in sorted(steps, key=lambda t: (t.segment_id, t.pos, t.step)):
        assert t.step == 0 or t.weight <= left[t.segment_id, t.pos][1]  # heavier first
        left[t.segment_id, t.pos] = (t.n_keep, t.weight)
    assert {k: n for k, (n, _) in left.items()} == {k: len(v) for k, v in out[0].items() if k in left}
    assert {k for k, v in out[0].items() if len(v) < len({(s, p): t for s, p, _, _, t in lus}[k])} <= set(left)


def test_sets_are_not_multiplied_out():
    lemmas = "".join(f"<lemma>w{i}</lemma>" for i in range(3000))
    rules = compile_rules(f'<lrx><def-seqs><def-set n="t">{lemmas}</def-set></def-seqs><rules><rule><set n="t"/><repeat from="1" upto="2"><set n="t"/></repeat><match lemma="a"><select lemma="y"/></match></rule></rules></lrx>')
    assert len(rules.patterns) == 3001 and len(rules.arcs) <= 8 and len(rules.paths()) == 2


@pytest.mark.parametrize(
    "xml",
    [
        '<rules><rule><match lemma="a" suffix="b"/></rule></rules>',
        '<rules><rule><repeat from="2" upto="1"><match lemma="a"/></repeat></rule></rules>',
        '<rules><rule><seq n="no"/></rule></rules>',
        '<rules><macro n="no"/></rules>',
        "<rules><rule>",
        "<other/>",
        '<lrx><def-macros><def-macro n="m" npar="1"><rule/></def-macro></def-macros><rules><macro n="m"/></rules></lrx>',
    ],
)
def test_errors(xml):
    with pytest.raises(RuleError):
        compile_rules(xml)
    assert validate_rules(xml)


def test_parse_round_trip(spark):
    text = "a \\^ b ^x\\/y<n>/p\\$<n>/q<n>$ [t]^*un/*un$ tail"
    df = spark.createDataFrame([(0, text)], "segment_id long, text string")
    rows = parse_segments(df).orderBy("pos").collect()
    assert [r.sl for r in rows] == ["x\\/y<n>", "*un"] and rows[0].tls == ["p\\$<n>", "q<n>"] and rows[0].blank == "a \\^ b "
    assert apply_to_text(df, compile_rules("<rules/>")).first().text == text


def written_out(rules, lus):
    """Matches by every path of every rule at every place: (segment, start, end, rule), once for a rule and end."""
    import regex

    def text(sl):
        bare = sl.removeprefix("*")
        return regex.sub(r"(?<!\\\\)<([^>]*)>", "\x02\\1\x03", bare)

    by = {}
    for s, p, _, sl, _ in lus:
        by.setdefault(s, {})[p] = text(sl)
    found = {}
    for s, units in by.items():
        for rule_id, words, anchored in rules.paths():
            for start in [0] if anchored else sorted(units):
                places = [units.get(start + k) for k in range(len(words))]
                if all(t is not None and any(regex.search(x, t) for _, x in w.patterns) for t, w in zip(places, words, strict=True)):
                    key = (s, start + len(words) - 1, rule_id)
                    new = ([op_text(w) for w in words], len(words), start)
                    found[key] = min(found.get(key, new), new)
    return {(s, start, end, r) for (s, end, r), (_, _, start) in found.items()}


def random_rule(rng, depth=0):
    """A body of words, alternations of several words, and repetitions within each other."""
    out = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.random()
        if depth < 3 and kind < 0.25:
            out.append("<or>" + "".join(f'<seq n="q{rng.randint(0, 2)}"/>' if rng.random() < 0.3 else random_rule(rng, 3) for _ in range(rng.randint(2, 3))) + "</or>")
        elif depth < 2 and kind < 0.45:
            low = rng.randint(0, 1)
            out.append(f'<repeat from="{low}" upto="{low + rng.randint(0, 2)}">{random_rule(rng, depth + 1)}</repeat>')
        else:
            op = rng.choice(["", "", f'<select lemma="{rng.choice("uvw")}"/>', f'<remove lemma="{rng.choice("uvw")}"/>'])
            attrs = rng.choice(['lemma="{0}"', 'suffix="{0}"', 'contains="{0}"', 'tags="n.*"', 'lemma="{0}{0}" tags="n.?"', 'suffix="b{0}" tags="*"', 'lemma="*" tags="?"']).format(rng.choice("abc"))
            out.append(f"<match {attrs}>{op}</match>")
        if depth == 3:
            break
    return "".join(out)


def test_graphs_equal_paths_written_out(spark, monkeypatch):
    """Random rules of nested alternations and repetitions, over segments cut into small blocks."""
    rng = random.Random(12)
    lemmas = ["a", "b", "c", "aa", "bb", "Ab", "cab", "bc", "ba"]
    lus = [(s, p, " ", f"{rng.choice(lemmas)}{rng.choice(['<n>', '<v>', '<n><sg>', ''])}", [f"{x}<n>" for x in "uvw"[: rng.randint(1, 3)]]) for s in range(3) for p in range(24)]
    df = spark.createDataFrame(lus, "segment_id long, pos int, blank string, sl string, tls array<string>").repartition(3)
    seqs = "".join(f'<def-seq n="q{i}">{random_rule(rng, 3)}{random_rule(rng, 3)}</def-seq>' for i in range(3))
    rules = compile_rules(f"<lrx><def-seqs>{seqs}</def-seqs><rules>" + "".join(f'<rule weight="{1 + i * 0.13:.2f}">{"<begin/>" if i % 7 == 3 else ""}{random_rule(rng)}</rule>' for i in range(12)) + "</rules></lrx>")
    want = written_out(rules, lus)
    assert len(want) > 30 and any(not a[3] for a in rules.arcs)
    decisions = []
    for size in (matching.BLOCK, 9):
        monkeypatch.setattr(matching, "BLOCK", size)
        got = [(r.segment_id, r.start, r.end, r.rule_id) for r in matching.rule_matches(df, rules).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        decisions.append({(r.segment_id, r.pos): r.tls for r in apply_rules(df, rules).collect()})
    assert decisions[0] == decisions[1] and len(decisions[0]) == len(lus)
    units = df.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("pos", "blank", "sl", "tls"))).alias("lus"))
    streamed = units.select("segment_id", F.explode(apply_to_units(F.col("lus"), rules)).alias("u")).select("segment_id", "u.pos", "u.tls").collect()
    assert {(r.segment_id, r.pos): r.tls for r in streamed} == decisions[0]


def test_rows_go_with_the_words_of_a_rule():
    """Six alternations of three two-word branches are 729 paths, and 36 words."""
    branch = lambda x: f'<seq n="{x}"/>'
    seqs = "".join(f'<def-seq n="{x}"><match lemma="{x}"/><match lemma="{x}{x}"/></def-seq>' for x in "abc")
    xml = f'<lrx><def-seqs>{seqs}</def-seqs><rules><rule>{("<or>" + "".join(map(branch, "abc")) + "</or>") * 6}<match lemma="z"><select lemma="y"/></match></rule></rules></lrx>'
    rules = compile_rules(xml)
    assert len(rules.arcs) == 37 and len(rules.patterns) == 7 and len(rules.paths()) == 729
    many = compile_rules(xml.replace("<rules>", "<rules>" + "<rule>" + ("<or>" + "".join(map(branch, "abc")) + "</or>") * 12 + '<match lemma="z"><select lemma="y"/></match></rule>'))
    with pytest.raises(RuleError):
        many.paths()
    assert len(many.arcs) == 37 + 73


def test_fifty_thousand_patterns(spark):
    """Suffixes, parts and tags by an index: an LU meets the patterns that share its keys, not all."""
    words = "".join(f'<match suffix="{i:05d}x"/>' for i in range(25_000)) + "".join(f'<match contains="y{i:05d}"/>' for i in range(25_000))
    rules = compile_rules(f'<rules><rule><or>{words}</or><match lemma="a"><select lemma="q"/></match></rule></rules>')
    assert len(rules.patterns) == 50_001
    lus = [(0, i, " ", sl, ["p<n>", "q<n>"]) for i, sl in enumerate(["k00017X<n>", "a<n>", "zy24999z<n>", "a<n>", "k25000x<n>", "a<n>"])]
    df = spark.createDataFrame(lus, "segment_id long, pos int, blank string, sl string, tls array<string>")
    got = {r.pos: r.tls for r in apply_rules(df, rules).collect()}
    assert [got[i] for i in (1, 3, 5)] == [["q<n>"], ["q<n>"], ["p<n>", "q<n>"]]


def test_index_keys_cover_case_and_short_patterns(spark):
    """Every pattern meets every word that its regex matches: capitals, the Kelvin sign, final sigma, empty and one-letter parts."""
    import regex

    cases = ["", "k", "K", "σ", "ς", "as", "å", "ing", "NG", "ß", "éa", "i", "longer"]
    xml = "".join(f'<rule><match {kind}="{x}"><select lemma="u"/></match></rule>' for kind in ("suffix", "contains", "lemma") for x in cases)
    rules = compile_rules(f"<rules>{xml}</rules>")
    lemmas = ["", "k", "K", "\u212a", "ΟΔΟΣ", "οδος", "οδοσ", "Ås", "\u212bs", "SinginG", "ing", "NG", "ß", "ẞ", "ÉA", "İi", "a longer one", "i"]
    lus = [(i, 0, " ", f"{x}<n>", ["u<n>", "v<n>"]) for i, x in enumerate(lemmas)]
    df = spark.createDataFrame(lus, "segment_id long, pos int, blank string, sl string, tls array<string>")
    got = {(r.segment_id, r.rule_id) for r in matching.rule_matches(df, rules).collect()}
    patterns = {r: w[0].patterns[0][1] for r, w, _ in rules.paths()}
    assert got == {(i, r) for i, x in enumerate(lemmas) for r, p in patterns.items() if regex.search(p, f"{x}\x02n\x03")}


BROKEN = {
    "an element that is none": ("<rules>\n <rule><word/></rule></rules>", [(2, "rule"), (2, "word")]),
    "a child in the wrong place": ("<rules><match/></rules>", [(1, "rules")]),
    "two operations": ('<rules><rule><match lemma="a"><select/><remove/></match></rule></rules>', [(1, "match")]),
    "an attribute that is none": ('<rules>\n\n<rule wieght="2"/></rules>', [(3, "rule")]),
    "a missing name": ("<lrx><def-seqs><def-seq/></def-seqs></lrx>", [(1, "def-seq")]),
    "no definitions": ("<lrx>\n<def-seqs/></lrx>", [(2, "def-seqs")]),
    "a name defined twice": ('<lrx><def-seqs><def-seq n="a"/>\n<def-set n="a"/></def-seqs></lrx>', [(2, "def-set")]),
    "a name not defined": ('<rules><rule><seq n="x"/></rule></rules>', [(1, "seq")]),
    "text in a rule": ("<rules><rule>text</rule></rules>", [(1, "rule")]),
    "something in an empty element": ("<rules><rule><begin> </begin></rule></rules>", [(1, "begin")]),
    "a wrong value": ('<lrx glob="many"/>', [(1, "lrx")]),
    "no XML": ("<rules><rule></rules>", [(1, "rule")]),
}


def test_faults_have_their_place():
    for name, (xml, want) in BROKEN.items():
        assert sorted((f.line, f.element) for f in faults(xml)) == want, name
    for name, (xml, _, _) in CASES.items():
        assert faults(xml) == [] or name == "several removes", name
    assert str(faults('<rules><rule wieght="2"/></rules>')[0]) == "line 1, column 8, rule: unknown attribute wieght"
