import glob
import sys
from pathlib import Path

import pytest

from codeloom.sources.facts import File, complexity, function_name, qualified_name
from codeloom.sources.tree import SourceError, build


def kinds(text):
    return [n.type for n in build(text)[0].walk() if n.named]


def test_statement_shapes():
    assert kinds("if a:\n    b\nelif c:\n    d\nelse:\n    e\n") == (
        "module if_statement identifier block expression_statement identifier elif_clause identifier block expression_statement identifier else_clause block expression_statement identifier".split()
    )
    assert kinds("a = b = c\n") == "module expression_statement assignment identifier assignment identifier identifier".split()
    assert kinds("x += 1") == "module expression_statement augmented_assignment identifier integer".split()
    assert kinds("with open(f) as g: pass") == "module with_statement with_clause with_item as_pattern call identifier argument_list identifier as_pattern_target identifier block pass_statement".split()
    assert kinds("@d\ndef f(): pass") == "module decorated_definition decorator identifier function_definition identifier parameters block pass_statement".split()


def test_brackets_comments_and_strings():
    assert kinds("x = (f())") == "module expression_statement assignment identifier parenthesized_expression call identifier argument_list".split()
    assert "parenthesized_expression" not in kinds("f(a)(b)[c](d)")
    assert kinds("f(a, # note\n b)").count("comment") == 1
    assert kinds("'a' \"b\"") == "module expression_statement concatenated_string string string".split()
    assert kinds('f"{x!r:>{w}} y"')[2:5] == ["string", "interpolation", "identifier"]
    assert kinds("sum(i for i in x)")[2:5] == ["call", "identifier", "generator_expression"]
    assert kinds("(1, 2); a, b = 1, 2").count("tuple") == 1


def test_fields_spans_and_ids():
    root, source = build("def é(a, *b, c=1, **d) -> int:\n    return ü(a)\n")
    f = root.kids[0]
    assert [f.get(x).text for x in ("name", "parameters", "return_type", "body")] == ["é", "(a, *b, c=1, **d)", "int", "return ü(a)"]
    call = next(n for n in root.walk() if n.type == "call")
    assert source.point(call.start) == (1, 11) and source.point(call.end) == (1, 16)
    every = list(root.walk())
    assert [n.id for n in every] == list(range(len(every)))
    assert root.last == len(every) - 1
    for n in every:
        assert n.last == max(x.id for x in n.walk())


@pytest.mark.parametrize("path", sorted(glob.glob(f"{Path(sys.modules['glob'].__file__).parent}/[a-d]*.py"))[:25])
def test_children_nest_in_order_in_real_code(path):
    for n in build(Path(path).read_text(encoding="utf-8"))[0].walk():
        at = n.start
        for k in n.kids:
            assert at <= k.start <= k.end <= n.end
            at = k.end


@pytest.mark.parametrize("text", ["def f(:\n", "x = (", "  x\n y", "print 'a'", "\x00", "'" + "a"])
def test_what_has_no_tree_raises_with_a_place(text):
    with pytest.raises(SourceError) as e:
        build(text)
    assert e.value.kind and e.value.row >= 0


def test_long_chains_and_odd_texts():
    assert "binary_operator" in kinds(" + ".join(["a"] * 3000))
    assert kinds("") == ["module"]
    assert kinds("\ufeffx") == kinds("x")
    assert kinds("# only a comment") == ["module", "comment"]
    assert len(kinds("x = 1\r\ny = 2\r")) == 9


def test_names_of_calls():
    names = lambda t: next((function_name(n), qualified_name(n)) for n in build(t)[0].walk() if n.type == "call")
    assert names("a.b.c()") == ("c", "a.b.c")
    assert names("f()") == ("f", "f")
    assert names("'x'.join(y)") == ("join", "join")
    assert names("a().b.c()") == ("c", "a().b.c")
    assert names("f(1)(2)") == ("f(1)", "f(1)")


def test_facts_of_a_file():
    f = File("import os, sys as s\nfrom a.b import c as d, e\ndef g(x):\n    y = os.getenv('k', default=x)\n    for z in y:\n        return z\n")
    imports = f.imports()
    assert [(i["module"], i["names"]) for i in imports] == [("os", ["os"]), ("a.b", ["a.b", "c", "e"])]
    call = f.calls()[0]
    assert (call["fn"], call["qn"], call["kw"], call["caller"], call["top_level"]) == ("getenv", "os.getenv", {"default": "x"}, "g", False)
    assert [(s["op"], s["target"]) for s in f.stmts()] == [("assign", "y"), ("return", None)]
    assert f.stats()["functions"] == 1 and f.stats()["total_lines"] == 6
    assert complexity("if a and b or c: return else") == 1 + 1 + 1 + 0  # 4 + 2 + 2 + 1 + 1 quarters
