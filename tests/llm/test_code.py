"""Functions with their documentation, and who wrote a file."""

import itertools
import random

import numpy as np
import pytest

from codeweft.functions.lexing import scan
from codeweft.llm import code_provenance as cp
from codeweft.llm.doc_pairs import COSTS, assign, doc_pairs, informative, links, pairs, words_left

FILES = "file_id bigint, repo_path string, file string, language string, content string, line_no string"


def found(content, language):
    text = content.replace("\r\n", "\n").removeprefix("﻿")
    return [(text.count("\n", 0, p.function.at) + 1, p.function.name) for p in pairs(content, language)]


def test_python_docstrings():
    src = '''﻿# A module
def plain(a: str = "x: y", b=lambda: {1: 2}) -> dict[str, int]:
    """Keeps only the rows that matter here."""

    def inner(x):
        # a remark before the docstring
        r\'\'\'Says what the nested one really does.\'\'\'
        note = """Not documentation of anything at all."""
        return x


# A comment above is not documentation in this language.
async def above():
    return """Neither is a returned string, however long."""

class A:
    """The class has its own words here."""
    @traced
    def method(
        self,
        mode: str = ")",
    ):
        "Single quotes with enough different words."

    def trivial(self):
        """TODO: write documentation for this one soon"""

    def tags_only(self, value):
        """:param value: the value that is used here
        :return: whatever comes out of it
        """

    def split_rows(self):
        """Split the rows. Rows split."""

    def formatted(self):
        f"""An f-string is {no} documentation of it."""

    def google(self, value):
        """
        Args:
            value: the window to use for this thing
        Returns:
            another long line of words here
        """
text = """
def fake():
    \'\'\'Inside of a string there is no code.\'\'\'
"""
'''
    assert found(src, "python") == [(2, "plain"), (5, "inner"), (19, "method")]
    assert found(src.replace("\n", "\r\n"), "python") == found(src, "python")
    assert found("def f(): 'One line with a real docstring'", "python") == [(1, "f")]


def test_go_comments_touch_the_declaration():
    src = '''package a

// Foo opens one table per depot.
//go:noinline
func Foo[T any](x string) (int, error) {
	s := `
// fake opens one table per depot here.
func fake() {}
`
	return 0, nil
}

// Apart from it by a blank line, so no documentation.

func Apart() {}

/* Block opens the very first
   table it sees. */
func (b *Box[T]) Block() {}

/** Starred comments count as well here too. */
//nolint:errcheck
func Starred() {}

x := 1 // a trailing remark with many words
func Trailing() {}

//go:noinline
//nolint:errcheck
func directive() {}

// NOTE: this one starts with a tag, so nothing is left
func tagged() {}
'''
    assert found(src, "go") == [(5, "Foo"), (19, "Block"), (23, "Starred")]


def test_java_blocks_and_annotations():
    src = '''package p;
/** The class is something else altogether, not this. */
public class A extends B {
    private int[] x = {1, 2};
    /** Opens one table per depot. */
    @Cached(ttl = 5, name = "a)b{")
    @Override

    public <T> Map<String, T> open(String a, @Nullable int b) throws IOException {
        if (a == null) { return run(a); }
        return new Runner() {
            /** Runs inside of an anonymous class body. */
            public void run() {}
        };
    }
    /* Opens one table per depot. */
    void block() {}
    /** Opens one table per depot. */
    // a remark in between breaks it
    void between() {}
    /** {@inheritDoc} */
    void inherited() {}
    /** Opens one table per depot. */
    abstract int later(int a);
    /** Is the value, not a method at all. */
    int field = call(1, 2);
    /** @param a the value to be used here */
    void tags(int a) {}
    String s = "/** Text in a string is text. */ void fake() {}";
}
'''
    assert found(src, "java") == [(9, "open"), (13, "run"), (24, "later")]


def test_script_functions():
    src = '''import { a } from 'b';
/** Opens one table per depot. */
export async function first<T>(x: { a: string }, y = () => { return 1; }): Promise<T> {
  /** Works inside another function body. */
  function nested() {}
  const re = /[/"'`]{2}/g;
  return nested();
}
/** Holds a number and nothing else here. */
export const value = 12;
/** Arrow functions have a name here too. */
export const arrow = async (a: string): Promise<void> => {
  go(`/** Text in a template string. */ function fake() {}`);
};
/** Assigned to the exports of this module. */
exports.given = async function (a) { return a; };
/** The class is something else altogether, not this. */
export class A {
  x = null;
  /** Opens one table per depot. */
  @Traced('a', { b: 1 })
  private static async method(a: string, b?: number): Promise<void> { if (a) { call(a); } }
  /** Opens one table per depot. */
  plain(a) { return super.plain(a); }
  // Opens one table per depot.
  line() {}
}
/** short */
const short = () => 1;
/** Expression bodies are functions as well here. */
const quick = (a) => a + 1;
'''
    assert found(src, "typescript") == [(3, "first"), (5, "nested"), (12, "arrow"), (16, "given"), (22, "method"), (24, "plain"), (31, "quick")]


def linked(src, language, **costs):
    return {p.function.name: p.plain.split("\n")[0] for p in links(src, language, {**COSTS, **costs})}


def test_names_tags_and_distance_choose_among_plausible_comments():
    # two comments above one function: the one that names it and its parameter wins over the nearer one
    src = "/** Remarks on the part below. */\n/* @param depot the depot that openTable reads */\nfunction openTable(depot) {}\n"
    assert linked(src, "javascript")["openTable"].startswith("@param") and linked(src, "javascript", names=0, tags=0, place=0)["openTable"].startswith("@param")
    far = "/* openTable(depot) is described here */\n\n\n\n/* Remarks on the part below. */\nfunction openTable(depot) {}\n"
    assert linked(far, "javascript")["openTable"].startswith("Remarks") and linked(far, "javascript", line=0)["openTable"].startswith("openTable")
    # one comment between two functions goes to the one it names; foreign code in between keeps it from the other
    both = "def first(): pass\n# second reads the depot\ndef second(): pass\ndef third(): pass\n"
    assert linked(both, "python") == {"second": "second reads the depot"}
    # links that are plausible but no documentation by the language's rules are not given out
    assert pairs(both, "python") == [] and [p.documents for p in links(both, "python")] == [False]


def test_same_name_twice_on_a_line(spark):
    src = "class A { /** Opens one table per depot. */ f(a) {} } class B { /** Opens one depot per table. */ f(b) {} }\n"
    rows = [(1, "r", "a.js", None, src, "x"), (1, "r", "a.js", None, src, "x")]
    got = doc_pairs(spark.createDataFrame(rows, FILES)).collect()
    assert sorted((r.line_no, r.col_no, r.func_name) for r in got) == [(1, src.index("f(a)") + 1, "f"), (1, src.index("f(b)") + 1, "f")]


def test_triviality():
    assert words_left("Collects the table.", "collectTable") == 2 + 1 - 1  # collects, the
    assert words_left("Finds which graph owns the snapshot.", "label") == 6
    assert informative("Args:\n    a: something\n\nDoes it.") == "Does it."
    assert words_left("{@inheritDoc}", "f") == 0 and words_left("", "f") == 0


def test_assignment_is_optimal():
    rnd = random.Random(0)
    for _ in range(60):
        n, m = rnd.randint(1, 4), rnd.randint(4, 6)
        costs = [[rnd.randint(-5, 20) for _ in range(m)] for _ in range(n)]
        got = assign(costs)
        assert len(set(got)) == n and sum(costs[i][j] for i, j in enumerate(got)) == min(sum(costs[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


@pytest.mark.parametrize("language", ["python", "go", "java", "typescript"])
def test_broken_and_long_texts_do_not_fail(language):
    for src in ('"unclosed', "/* unclosed", "}}}))) {{{ ((", "`", "'''", "func (", "def f(", "class A {" * 200, "/** x */" * 500, "a" * 100_000, "\x00\n" * 50):
        tokens, code = scan(src, language)
        assert len(code) == len(src) and all(t.start < t.end for t in tokens)
        pairs(src, language)


def test_doc_pairs_rows(spark):
    good = '/** Opens one table per depot. */\nfunction f() {}\n'
    rows = [(1, "r", "a.js", None, good, "x"), (1, "r", "a.js", None, good, "x"), (2, "r", "b.js", "javascript", None, "x"), (3, "r", "c.rb", "ruby", good, "x"), (4, "r", "noending", "javascript", good, "x"), (None, "r", "d.js", None, good, "x"), (5, "r", "e.js", None, "", "x")]
    got = doc_pairs(spark.createDataFrame(rows, FILES))
    assert sorted((r.file_id, r.line_no, r.func_name) for r in got.collect()) == [(1, 2, "f"), (4, 2, "f")]
    assert doc_pairs(spark.createDataFrame([], FILES)).count() == 0


HAND = "import {{ load }} from 'plinth/auth';\n\nexport function collect{0}Window(budget, partial{0}) {{\n  const report{0} = resolve{0}(budget, 82);\n  return report{0};\n}}\n\nexport class Local{0} {{\n  merge{0}(order) {{\n    return order.session;\n  }}\n}}\n"


def provenance_rows():
    words = ["Ledger", "Carrier", "Manifest", "Window", "Digest", "Signal", "Bucket", "Tariff", "Journal", "Schema"]
    hand = [(k, "r", f"src/{w.lower()}.js", "javascript", HAND.format(w), "x") for k, w in enumerate(words)]
    mini = ";".join(f"var {chr(97 + k % 26)}=function({chr(98 + k % 24)},z){{return {chr(98 + k % 24)}?z({k}):void 0}}" for k in range(60))
    other = {
        100: ("src/app.js", mini), 101: ("src/rows.js", "export const ROWS = [\n" + ",\n".join(f"  {k * 7919 % 1000}, {k * 104729 % 1000}" for k in range(200)) + "\n];\n"),
        102: ("src/made.js", "// Copyright us.\n\n// Code generated by protoloom v1.2.3. DO NOT EDIT.\n" + HAND.format("Ledger")), 103: ("vendor/lib/x.js", HAND.format("Carrier")), 104: ("lib/x_copy.js", "// Upstream: dray/glob@5.4.12\n" + HAND.format("Window")),
        105: ("web/a.pb.js", HAND.format("Digest")), 106: ("src/blob.js", "module.exports.KEY =\n" + " +\n".join(f'  "{"qXz9Kd0vPfT7" * 6}"' for _ in range(20)) + ";\n"),
    }
    decoys = {
        200: ("vendors/x.js", HAND.format("Signal")), 201: ("src/codegen.js", "// This file is written by hand, it is not generated.\n" + HAND.format("Bucket")), 202: ("generator/x.js", "// Emits the generated stubs; the output carries a do-not-edit line, this does not.\n" + HAND.format("Tariff")),
        203: ("src/banner.js", HAND.format("Journal") + "const banner = '// Code generated by x. DO NOT EDIT.';\n"), 204: ("src/route_bundle.js", HAND.format("Schema")), 205: ("empty.js", "  \n"),
    }
    return hand + [(k, "r", f, None, c, "x") for k, (f, c) in {**other, **decoys}.items()] + [(300, "r", None, "javascript", None, "x"), (None, "r", "a.js", None, "x", "x"), (100, "r", "src/app.js", None, mini, "x")], other, decoys


def test_provenance(spark):
    rows, other, decoys = provenance_rows()
    got = {r.file_id: r.kind for r in cp.code_provenance(spark.createDataFrame(rows, FILES)).collect()}
    assert {k: got[k] for k in other} == {100: "minified", 101: "data", 102: "generated", 103: "vendored", 104: "vendored", 105: "generated", 106: "data"}
    assert {got[k] for k in decoys} == {"hand"} and {got[k] for k in range(10)} == {"hand"}
    assert 300 not in got and len(got) == 10 + len(other) + len(decoys)
    assert cp.code_provenance(spark.createDataFrame([], FILES)).count() == 0


def test_recorded_origins(spark):
    rows, _, _ = provenance_rows()
    props = ['{"generated": true, "language": "js"}', '{"generated": false}', '{"generated_by": "stubsmith"}', '{"generated_by": null}', '{"generator": {"tool": "sqlknit", "rev": 2}}', '{"origin": "generated"}', '{"origin": "manual"}', '{"vendored": true}', "null", "no json"]
    nodes = [("r", f"n{k}", rows[k][2], p, 1, "x") for k, p in enumerate(props)]
    nodes += [("r", "m3", rows[3][2], '{"generated_by": "old"}', 0, "x"), ("other", "n1", rows[1][2], props[0], 9, "x"), ("r", "n0", None, props[0], None, "x"), (None, "n1", rows[1][2], props[0], 9, "x"), ("r", "n9", rows[9][2], None, None, "x")]
    table = spark.createDataFrame(nodes, "repo_path string, id string, file string, properties string, updated_at bigint, content string")
    got = {r.file_id: (r.kind, r.reason) for r in cp.code_provenance(spark.createDataFrame(rows, FILES), table).collect()}
    assert {k: v[0] for k, v in got.items() if v[1] == "recorded"} == {0: "generated", 2: "generated", 4: "generated", 5: "generated", 7: "vendored"}
    assert got[100][0] == "minified" and got[1] == got[3] == got[6] == got[9] == ("hand", "")
    assert cp.recorded_origins(table.limit(0)).count() == 0


def test_foreign_style_and_templates(spark):
    words = ["Ledger", "Carrier", "Manifest", "Window", "Digest", "Signal", "Bucket", "Tariff", "Journal", "Schema"]
    rows = [(k, "r", f"src/{w.lower()}.js", None, HAND.format(w), "x") for k, w in enumerate(words)]
    rows.append((50, "r", "src/odd.js", None, "".join(f"function merge_the_{w.lower()}(other_one) {{ return other_one.next_{w.lower()}; }}\n" for w in words), "x"))
    rows.append((51, "r", "src/rows.js", None, "collectLedgerWindow(budget, partialLedger); resolveLedger(budget);\n" * 60, "x"))
    got = {r.file_id: (r.kind, r.reason) for r in cp.code_provenance(spark.createDataFrame(rows, FILES)).collect()}
    assert got.pop(50) == ("vendored", "foreign style") and got.pop(51) == ("generated", "template-like names") and set(got.values()) == {("hand", "")}


def test_of_differing_rows_of_one_id_always_the_same_stands(spark):
    rows = [(1, "r", "a.js", None, HAND.format(w), "x") for w in ("Ledger", "Order")] + [(1, "r", "vendor/a.js", None, HAND.format("Order"), "x")]
    seen = {tuple(cp.code_provenance(spark.createDataFrame(p, FILES)).first()) for p in (rows, rows[::-1])}
    assert len(seen) == 1


@pytest.mark.parametrize(("head", "kind"), [
    (["// Code generated by x; the output is checked in. DO NOT EDIT."], "generated"), (["// protoc-gen-go v1.28.1"], "generated"), (["// left-pad v1.3.0", "// https://example.invalid/left-pad"], "vendored"),
    (["// Copied verbatim from a/b 1.2, see its LICENSE."], "vendored"), (["// not generated by anything"], ""), (["// Emits the generated stubs."], ""), (["// Copyright us."], ""), ([], ""),
])
def test_what_heads_state(head, kind):
    assert cp.stated(head) == kind


def test_name_model_tells_mangled_names():
    def counts(names):
        return np.unique(np.concatenate([cp.grams(n) for n in names]), return_counts=True)

    n = np.zeros(cp.GRAMS)
    ids, c = counts(["collectWindow", "resolveLedger", "mergeOrder", "ledgerWindow"] * 20)
    n[ids] = c
    model = cp.NameModel(n)
    assert model.cost(*counts(["qxz", "vkj", "zq"])) > model.cost(*counts(["mergeWindow", "collectLedger"])) + 1
    assert model.cost(np.empty(0, int), np.empty(0, int)) == 0.0 and cp.NameModel(np.zeros(cp.GRAMS)).mean == 0.0
    assert max(cp.grams("ß$_Z9")) < cp.GRAMS
