"""Python source text to a concrete syntax tree, on the standard library alone.

``ast`` gives the structure and byte columns; ``tokenize`` gives what ``ast``
drops: brackets around expressions, comments, keywords and punctuation, the
parts of a concatenated string. Node kinds and field names follow the public
tree grammar of Python that editors use (``call``, ``function_definition``,
``if_statement`` with ``condition`` and ``consequence``, ...).

Where Python's own grammar refuses a text, ``rescue`` stands harmless lines of
the same length in for those it refuses, one after another, and calls what they
become ``ERROR`` nodes: one bad line does not hide the others. A text of too
many such lines has no tree; ``build`` raises ``SourceError`` with the place at
the first. Columns count bytes, rows from 0.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import sys
import tokenize
import warnings
from collections.abc import Iterator
from operator import attrgetter

DEPTH = 20_000
_OPENERS, _CLOSERS = "([{", ")]}"
_VALUE_ENDS = {")", "]", "}"}
_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_SIMPLE = {
    ast.Pass: "pass_statement", ast.Break: "break_statement", ast.Continue: "continue_statement",
    ast.Return: "return_statement", ast.Raise: "raise_statement", ast.Assert: "assert_statement", ast.Delete: "delete_statement",
    ast.Global: "global_statement", ast.Nonlocal: "nonlocal_statement",
}
_ENDS = re.compile(rb"\r\n|\r|\n")
_START = attrgetter("start")
_LISTS = {ast.List: "list", ast.Set: "set"}
_COMPREHENSIONS = {ast.ListComp: "list_comprehension", ast.SetComp: "set_comprehension", ast.GeneratorExp: "generator_expression", ast.DictComp: "dictionary_comprehension"}


class SourceError(ValueError):
    """The text has no tree; carries kind, message and a 0-based place."""

    def __init__(self, kind: str, message: str, row: int = 0, column: int = 0) -> None:
        super().__init__(message)
        self.kind, self.row, self.column = kind, row, column


class Node:
    """A node: its kind, its span in bytes, the field of its parent that holds it, its children in source order."""

    __slots__ = ("type", "start", "end", "field", "named", "kids", "id", "last", "src")

    def __init__(self, kind: str, start: int, end: int, src: bytes, kids: list[Node] | None = None, named: bool = True) -> None:
        self.type, self.start, self.end, self.src = kind, start, end, src
        self.field, self.named, self.kids = "", named, kids if kids is not None else []
        self.id = self.last = 0

    @property
    def text(self) -> str:
        return self.src[self.start : self.end].decode("utf-8", "replace")

    def get(self, field: str) -> Node | None:
        for k in self.kids:
            if k.field == field:
                return k
        return None

    def own(self) -> list[Node]:
        return [k for k in self.kids if k.named]

    def walk(self) -> Iterator[Node]:
        """This node and all below it, parents first, in source order; no recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))


class Source:
    """A text with its line starts, and its tokens as (kind, text, begin, end) in bytes."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.data = text.encode("utf-8", "surrogatepass")
        d = self.data
        self.begins = [0, *(m.end() for m in _ENDS.finditer(d))]
        self.tokens: list[tuple[int, str, int, int]] = []
        #: Where all is ASCII a column counts bytes as it stands.
        self._lines = None if d.isascii() else [d[a:b].decode("utf-8", "replace") for a, b in zip(self.begins, [*self.begins[1:], len(d)], strict=True)]
        #: All nodes of the tree, parents first.
        self.every: list[Node] = []

    def at(self, row: int, column: int) -> int:
        """Byte offset of a 1-based row and a byte column, as ast has them."""
        return self.begins[row - 1] + column

    def point(self, offset: int) -> tuple[int, int]:
        row = bisect.bisect_right(self.begins, offset) - 1
        return row, offset - self.begins[row]

    def _byte(self, row: int, column: int) -> int:
        if row > len(self.begins):
            return len(self.data)
        if self._lines is None:
            return self.begins[row - 1] + column
        line = self._lines[row - 1]
        return self.begins[row - 1] + (column if line.isascii() else len(line[:column].encode("utf-8", "surrogatepass")))

    def tokenise(self) -> None:
        skip = (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING)
        byte = self._byte
        for kind, text, start, end, _ in tokenize.generate_tokens(io.StringIO(self.text).readline):
            if kind not in skip:
                self.tokens.append((kind, text, byte(*start), byte(*end)))
        self.starts = [t[2] for t in self.tokens]
        self.partner: dict[int, int] = {}
        self.grouping: set[int] = set()
        stack: list[int] = []
        before = None
        self.solid = [i for i, t in enumerate(self.tokens) if t[0] != tokenize.COMMENT]
        self.rank = {i: k for k, i in enumerate(self.solid)}
        for i in self.solid:
            kind, text = self.tokens[i][:2]
            if kind == tokenize.OP and text in _OPENERS:
                stack.append(i)
                if text == "(":
                    call = before is not None and (before[1] in _VALUE_ENDS or (before[0] == tokenize.NAME and before[1] not in _WORDS) or before[0] in (tokenize.STRING, getattr(tokenize, "FSTRING_END", -1)))
                    if not call:
                        self.grouping.add(i)
            elif kind == tokenize.OP and text in _CLOSERS and stack:
                j = stack.pop()
                self.partner[j], self.partner[i] = i, j
            before = self.tokens[i]

    def before(self, offset: int) -> int | None:
        """Index of the last solid token that begins before offset."""
        i = bisect.bisect_left(self.starts, offset) - 1
        while i >= 0 and i not in self.rank:
            i -= 1
        return i if i >= 0 else None

    def after(self, offset: int) -> int | None:
        """Index of the first solid token that begins at or after offset."""
        i = bisect.bisect_left(self.starts, offset)
        while i < len(self.tokens) and i not in self.rank:
            i += 1
        return i if i < len(self.tokens) else None

    def find(self, offset: int, text: str) -> int:
        """Index of the first token ``text`` at or after offset."""
        i = self.after(offset)
        while i is not None and i < len(self.tokens):
            if self.tokens[i][1] == text and i in self.rank:
                return i
            i += 1
        raise SourceError("internal", f"no {text!r} after {offset}")


class Builder:
    def __init__(self, source: Source) -> None:
        self.s, self.src = source, source.data

    # -- spans --
    def span(self, n: ast.AST) -> tuple[int, int]:
        begins = self.s.begins
        return begins[n.lineno - 1] + n.col_offset, begins[n.end_lineno - 1] + n.end_col_offset

    def node(self, kind: str, start: int, end: int, *kids: Node | None) -> Node:
        return Node(kind, start, end, self.src, [k for k in kids if k is not None])

    def leaf(self, kind: str, token: int) -> Node:
        return Node(kind, self.s.tokens[token][2], self.s.tokens[token][3], self.src)

    @staticmethod
    def as_(field: str, n: Node) -> Node:
        n.field = field
        return n

    def wrapped(self, n: Node) -> Node:
        """n inside a parenthesized_expression for each pair of brackets that only group."""
        while self.s.grouping:
            i, j = self.s.before(n.start), self.s.after(n.end)
            if i is None or j is None or i not in self.s.grouping or self.s.partner.get(i) != j:
                return n
            n = self.node("parenthesized_expression", self.s.tokens[i][2], self.s.tokens[j][3], n)
        return n

    # -- expressions --
    def expr(self, e: ast.expr) -> Node:
        n = self.bare(e)
        return n if isinstance(e, ast.GeneratorExp) else self.wrapped(n)

    def strings(self, a: int, b: int, values: list[ast.expr]) -> Node:
        """A string, or a concatenated_string of its parts; interpolated expressions stand in their part."""
        parts: list[Node] = []
        i = self.s.after(a)
        deep, begin = 0, a
        starts, ends = getattr(tokenize, "FSTRING_START", -1), getattr(tokenize, "FSTRING_END", -2)
        while i is not None and i < len(self.s.tokens) and self.s.tokens[i][2] < b:
            kind, _, x, y = self.s.tokens[i]
            if kind == starts:
                begin, deep = (x, deep + 1) if deep == 0 else (begin, deep + 1)
            elif kind == ends:
                deep -= 1
                if deep == 0:
                    parts.append(self.node("string", begin, y))
            elif kind == tokenize.STRING and deep == 0:
                parts.append(self.node("string", x, y))
            i += 1
        for v in values:
            if isinstance(v, ast.FormattedValue):
                x, y = self.span(v)
                if x < a or y > b:
                    continue
                for p in parts:
                    if p.start <= x and y <= p.end:
                        p.kids.append(self.node("interpolation", x, y, self.as_("expression", self.expr(v.value))))
                        break
        if len(parts) == 1 and parts[0].start == a and parts[0].end == b:
            return parts[0]
        return self.node("concatenated_string", a, b, *parts) if len(parts) > 1 else self.node("string", a, b, *(parts[0].kids if parts else []))

    def arguments(self, call: ast.Call | ast.ClassDef, start: int, end: int, values: list[ast.expr]) -> Node:
        kids = [*(self.expr(v) for v in values), *(self.keyword(k) for k in call.keywords)]
        return self.node("argument_list", start, end, *sorted(kids, key=lambda k: k.start))

    def keyword(self, k: ast.keyword) -> Node:
        a, b = self.span(k)
        value = self.as_("value", self.expr(k.value))
        if k.arg is None:
            return self.node("dictionary_splat", a, max(b, value.end), value)
        return self.node("keyword_argument", a, max(b, value.end), self.as_("name", self.node("identifier", a, a + len(k.arg.encode()))), value)

    def chain(self, kind: str, values: list[Node]) -> Node:
        left = values[0]
        for right in values[1:]:
            left = self.node(kind, left.start, right.end, self.as_("left", left), self.as_("right", right))
        return left

    def bare(self, e: ast.expr) -> Node:  # noqa: C901, PLR0911, PLR0912
        a, b = self.span(e)
        field, expr = self.as_, self.expr
        match e:
            case ast.Name():
                return self.node("identifier", a, b)
            case ast.Attribute():
                name = self.node("identifier", b - len(e.attr.encode()), b)
                return self.node("attribute", a, b, field("object", expr(e.value)), field("attribute", name))
            case ast.Call():
                function = expr(e.func)
                opening = self.s.find(function.end, "(")
                start = self.s.tokens[opening][2]
                if len(e.args) == 1 and not e.keywords and isinstance(e.args[0], ast.GeneratorExp) and self.span(e.args[0])[0] == start:
                    return self.node("call", a, b, field("function", function), field("arguments", self.bare(e.args[0])))
                return self.node("call", a, b, field("function", function), field("arguments", self.arguments(e, start, b, e.args)))
            case ast.Constant():
                if isinstance(e.value, (str, bytes)):
                    return self.strings(a, b, [])
                kinds = {bool: str(e.value).lower(), type(None): "none", int: "integer", float: "float", complex: "float", type(...): "ellipsis"}
                return self.node(kinds[type(e.value)], a, b)
            case ast.JoinedStr():
                return self.strings(a, b, e.values)
            case ast.BinOp():
                # A long chain leans left; unrolled, so that its length costs no stack.
                chain = [e]
                while isinstance(chain[-1].left, ast.BinOp) and self.span(chain[-1].left)[0] == a:
                    inner = chain[-1].left
                    p, q = self.s.before(a), self.s.after(self.span(inner)[1])
                    if p in self.s.grouping and self.s.partner.get(p) == q:
                        break
                    chain.append(inner)
                left = expr(chain[-1].left)
                for op in reversed(chain):
                    right = expr(op.right)
                    left = self.node("binary_operator", left.start, right.end, field("left", left), field("right", right))
                    if op is not e:
                        left = self.wrapped(left)
                return left
            case ast.BoolOp():
                return self.chain("boolean_operator", [expr(v) for v in e.values])
            case ast.Compare():
                return self.node("comparison_operator", a, b, *(expr(v) for v in (e.left, *e.comparators)))
            case ast.UnaryOp():
                return self.node("not_operator" if isinstance(e.op, ast.Not) else "unary_operator", a, b, field("argument", expr(e.operand)))
            case ast.Subscript():
                value = field("value", expr(e.value))
                inner = e.slice.elts if isinstance(e.slice, ast.Tuple) and not self.parenthesised(e.slice) else [e.slice]
                return self.node("subscript", a, b, value, *(field("subscript", expr(x)) for x in inner))
            case ast.Slice():
                return self.node("slice", a, b, *(expr(x) for x in (e.lower, e.upper, e.step) if x is not None))
            case ast.Tuple():
                return self.node("tuple" if self.parenthesised(e) else "expression_list", a, b, *(expr(x) for x in e.elts))
            case ast.List() | ast.Set():
                return self.node(_LISTS[type(e)], a, b, *(expr(x) for x in e.elts))
            case ast.Dict():
                pairs = []
                for k, v in zip(e.keys, e.values, strict=True):
                    value = field("value", expr(v))
                    if k is None:
                        pairs.append(self.node("dictionary_splat", self.s.tokens[self.s.before(value.start)][2], value.end, value))
                    else:
                        key = field("key", expr(k))
                        pairs.append(self.node("pair", key.start, value.end, key, value))
                return self.node("dictionary", a, b, *pairs)
            case ast.ListComp() | ast.SetComp() | ast.GeneratorExp() | ast.DictComp():
                if isinstance(e, ast.DictComp):
                    key, value = field("key", expr(e.key)), field("value", expr(e.value))
                    body = self.node("pair", key.start, value.end, key, value)
                else:
                    body = expr(e.elt)
                return self.node(_COMPREHENSIONS[type(e)], a, b, field("body", body), *self.clauses(body.end, e.generators))
            case ast.IfExp():
                return self.node("conditional_expression", a, b, *(expr(x) for x in (e.body, e.test, e.orelse)))
            case ast.Lambda():
                parameters = self.parameters(e.args, "lambda_parameters", None)
                return self.node("lambda", a, b, field("parameters", parameters) if parameters else None, field("body", expr(e.body)))
            case ast.Await():
                return self.node("await", a, b, expr(e.value))
            case ast.Yield() | ast.YieldFrom():
                return self.node("yield", a, b, expr(e.value) if e.value is not None else None)
            case ast.Starred():
                return self.node("list_splat", a, b, expr(e.value))
            case ast.NamedExpr():
                return self.node("named_expression", a, b, field("name", expr(e.target)), field("value", expr(e.value)))
        return self.node("expression", a, b, *(expr(x) for x in ast.iter_child_nodes(e) if isinstance(x, ast.expr)))

    def parenthesised(self, e: ast.Tuple) -> bool:
        a, b = self.span(e)
        i = self.s.after(a)
        return i is not None and self.s.tokens[i][1] == "(" and self.s.tokens[i][2] == a and (j := self.s.partner.get(i)) is not None and self.s.tokens[j][3] == b

    def clauses(self, at: int, generators: list[ast.comprehension]) -> Iterator[Node]:
        for g in generators:
            left, right = self.as_("left", self.target(g.target)), self.as_("right", self.expr(g.iter))
            start = self.s.tokens[self.s.find(at, "async" if g.is_async else "for")][2]
            yield self.node("for_in_clause", start, right.end, left, right)
            at = right.end
            for test in g.ifs:
                condition = self.expr(test)
                yield self.node("if_clause", self.s.tokens[self.s.find(at, "if")][2], condition.end, condition)
                at = condition.end

    def target(self, e: ast.expr) -> Node:
        n = self.expr(e)
        kinds = {"tuple": "tuple_pattern", "expression_list": "pattern_list", "list": "list_pattern", "list_splat": "list_splat_pattern"}
        n.type = kinds.get(n.type, n.type)
        return n

    def parameters(self, p: ast.arguments, kind: str, span: tuple[int, int] | None) -> Node | None:
        kids: list[Node] = []
        plain = [*p.posonlyargs, *p.args]
        defaults = [None] * (len(plain) - len(p.defaults)) + list(p.defaults)

        def one(arg: ast.arg, default: ast.expr | None, stars: str = "") -> Node:
            a, b = self.span(arg)
            name = self.node("identifier", a, a + len(arg.arg.encode()))
            if stars:
                start = self.s.tokens[self.s.before(a)][2]
                name = self.node("list_splat_pattern" if stars == "*" else "dictionary_splat_pattern", start, name.end, name)
            kind_ = self.node("type", *(x := self.expr(arg.annotation)).__class__ and (x.start, x.end), x) if arg.annotation is not None else None
            value = self.as_("value", self.expr(default)) if default is not None else None
            if kind_ is not None and value is not None:
                return self.node("typed_default_parameter", name.start, value.end, self.as_("name", name), self.as_("type", kind_), value)
            if kind_ is not None:
                return self.node("typed_parameter", name.start, kind_.end, name, self.as_("type", kind_))
            if value is not None:
                return self.node("default_parameter", name.start, value.end, self.as_("name", name), value)
            return name

        kids += [one(a, d) for a, d in zip(plain, defaults, strict=True)]
        if p.vararg:
            kids.append(one(p.vararg, None, "*"))
        kids += [one(a, d) for a, d in zip(p.kwonlyargs, p.kw_defaults, strict=True)]
        if p.kwarg:
            kids.append(one(p.kwarg, None, "**"))
        if span is None:
            return self.node(kind, kids[0].start, kids[-1].end, *kids) if kids else None
        return self.node(kind, *span, *kids)

    # -- statements --
    def block(self, body: list[ast.stmt]) -> Node:
        kids = [self.stmt(x) for x in body]
        return self.node("block", kids[0].start, kids[-1].end, *kids)

    def clause(self, kind: str, word: str, after: int, body: list[ast.stmt], field: str = "body") -> Node:
        block = self.block(body)
        start = self.s.find(after, word)
        return self.node(kind, self.s.tokens[start][2], block.end, self.as_(field, block) if field else block)

    def alternatives(self, after: int, orelse: list[ast.stmt]) -> list[Node]:
        """else_clause and elif_clause nodes of an if, as siblings."""
        out: list[Node] = []
        while orelse:
            first = self.span(orelse[0])[0]
            if len(orelse) == 1 and isinstance(orelse[0], ast.If) and self.src[first : first + 4] == b"elif":
                inner = orelse[0]
                block = self.block(inner.body)
                out.append(self.as_("alternative", self.node("elif_clause", first, block.end, self.as_("condition", self.expr(inner.test)), self.as_("consequence", block))))
                after, orelse = block.end, inner.orelse
            else:
                out.append(self.as_("alternative", self.clause("else_clause", "else", after, orelse)))
                break
        return out

    def named(self, word: str, after: int, name: str) -> Node:
        """The name that stands after a keyword."""
        i = self.s.find(after, word) + 1
        while i not in self.s.rank:
            i += 1
        return self.as_("name", self.leaf("identifier", i))

    def definition(self, d: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) -> Node:
        start = self.span(d)[0]
        field = self.as_
        body = field("body", self.block(d.body))
        if isinstance(d, ast.ClassDef):
            name = self.named("class", start, d.name)
            opening = self.s.after(name.end)
            bases = None
            if (d.bases or d.keywords) and self.s.tokens[opening][1] == "(":
                bases = field("superclasses", self.arguments(d, self.s.tokens[opening][2], self.s.tokens[self.s.partner[opening]][3], d.bases))
            out = self.node("class_definition", start, body.end, name, bases, body)
        else:
            name = self.named("def", start, d.name)
            opening = self.s.find(name.end, "(")
            span = self.s.tokens[opening][2], self.s.tokens[self.s.partner[opening]][3]
            returns = None
            if d.returns is not None:
                x = self.expr(d.returns)
                returns = field("return_type", self.node("type", x.start, x.end, x))
            out = self.node("function_definition", start, body.end, name, field("parameters", self.parameters(d.args, "parameters", span)), returns, body)
        if not d.decorator_list:
            return out
        marks = []
        for e in d.decorator_list:
            x = self.expr(e)
            marks.append(self.node("decorator", self.s.tokens[self.s.before(x.start)][2], x.end, x))
        return self.node("decorated_definition", marks[0].start, out.end, *marks, field("definition", out))

    def dotted(self, name: str, start: int) -> Node:
        """A dotted name that begins at start; white space within is possible."""
        end = start
        for i, part in enumerate(name.split(".")):
            t = self.s.after(end)
            if i:
                t = self.s.after(self.s.tokens[t][3])
            end = self.s.tokens[t][3]
            if part == "*":
                break
        kids, at = [], start
        for part in name.split("."):
            t = self.s.after(at)
            if self.s.tokens[t][1] == ".":
                t = self.s.after(self.s.tokens[t][3])
            kids.append(self.node("identifier", self.s.tokens[t][2], self.s.tokens[t][3]))
            at = self.s.tokens[t][3]
        return self.node("dotted_name", start, end, *kids)

    def alias(self, x: ast.alias) -> Node:
        a, b = self.span(x)
        if x.name == "*":
            return self.node("wildcard_import", a, b)
        name = self.dotted(x.name, a)
        if x.asname is None:
            return self.as_("name", name)
        last = self.node("identifier", b - len(x.asname.encode()), b)
        return self.as_("name", self.node("aliased_import", a, b, self.as_("name", name), self.as_("alias", last)))

    def assignment(self, s: ast.Assign) -> Node:
        n = self.expr(s.value)
        for t in reversed(s.targets):
            left = self.as_("left", self.target(t))
            n = self.node("assignment", left.start, n.end, left, self.as_("right", n))
        return n

    def stmt(self, s: ast.stmt) -> Node:  # noqa: C901, PLR0911, PLR0912, PLR0915
        a, b = self.span(s)
        field, expr = self.as_, self.expr
        match s:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                return self.definition(s)
            case ast.Expr():
                x = expr(s.value)
                return self.node("expression_statement", x.start, x.end, x)
            case ast.Assign():
                x = self.assignment(s)
                return self.node("expression_statement", x.start, x.end, x)
            case ast.AnnAssign():
                left, kind = field("left", self.target(s.target)), expr(s.annotation)
                right = field("right", expr(s.value)) if s.value is not None else None
                kind = field("type", self.node("type", kind.start, kind.end, kind))
                x = self.node("assignment", left.start, (right or kind).end, left, kind, right)
                return self.node("expression_statement", x.start, x.end, x)
            case ast.AugAssign():
                left, right = field("left", self.target(s.target)), field("right", expr(s.value))
                x = self.node("augmented_assignment", left.start, right.end, left, right)
                return self.node("expression_statement", x.start, x.end, x)
            case ast.If():
                block = field("consequence", self.block(s.body))
                return self.node("if_statement", a, b, field("condition", expr(s.test)), block, *self.alternatives(block.end, s.orelse))
            case ast.For() | ast.AsyncFor():
                block = field("body", self.block(s.body))
                rest = field("alternative", self.clause("else_clause", "else", block.end, s.orelse)) if s.orelse else None
                return self.node("for_statement", a, b, field("left", self.target(s.target)), field("right", expr(s.iter)), block, rest)
            case ast.While():
                block = field("body", self.block(s.body))
                rest = field("alternative", self.clause("else_clause", "else", block.end, s.orelse)) if s.orelse else None
                return self.node("while_statement", a, b, field("condition", expr(s.test)), block, rest)
            case ast.With() | ast.AsyncWith():
                items = []
                for i in s.items:
                    x = expr(i.context_expr)
                    if i.optional_vars is not None:
                        t = self.target(i.optional_vars)
                        x = self.node("as_pattern", x.start, t.end, x, field("alias", self.node("as_pattern_target", t.start, t.end, t)))
                    items.append(self.node("with_item", x.start, x.end, field("value", x)))
                block = field("body", self.block(s.body))
                return self.node("with_statement", a, b, self.node("with_clause", items[0].start, items[-1].end, *items), block)
            case ast.Try() | ast.TryStar():
                block = field("body", self.block(s.body))
                kids, at = [block], block.end
                for h in s.handlers:
                    x, y = self.span(h)
                    inner = self.block(h.body)
                    caught = None
                    if h.type is not None:
                        caught = expr(h.type)
                        if h.name:
                            t = self.s.find(caught.end, h.name)
                            alias = self.leaf("identifier", t)
                            caught = self.node("as_pattern", caught.start, alias.end, caught, field("alias", self.node("as_pattern_target", alias.start, alias.end, alias)))
                        caught = field("value", caught)
                    kids.append(self.node("except_group_clause" if isinstance(s, ast.TryStar) else "except_clause", x, y, caught, inner))
                    at = y
                if s.orelse:
                    kids.append(self.clause("else_clause", "else", at, s.orelse))
                    at = kids[-1].end
                if s.finalbody:
                    kids.append(self.clause("finally_clause", "finally", at, s.finalbody, ""))
                return self.node("try_statement", a, b, *kids)
            case ast.Import():
                return self.node("import_statement", a, b, *(self.alias(x) for x in s.names))
            case ast.ImportFrom():
                first = self.s.after(self.s.tokens[self.s.after(a)][3])
                start = self.s.tokens[first][2]
                if s.level:
                    stop = self.s.tokens[self.s.before(self.s.tokens[self.s.find(a, "import")][2])][3]
                    module = self.node("relative_import", start, stop)
                else:
                    module = self.dotted(s.module, start)
                kind = "future_import_statement" if s.module == "__future__" else "import_from_statement"
                return self.node(kind, a, b, field("module_name", module), *(self.alias(x) for x in s.names))
            case ast.Match():
                cases = []
                for c in s.cases:
                    block = field("consequence", self.block(c.body))
                    x = self.s.at(c.pattern.lineno, c.pattern.col_offset)
                    y = self.s.at(c.pattern.end_lineno, c.pattern.end_col_offset)
                    word = self.s.tokens[self.s.before(x)]
                    guard = expr(c.guard) if c.guard is not None else None
                    guard = field("guard", self.node("if_clause", self.s.tokens[self.s.before(guard.start)][2], guard.end, guard)) if guard else None
                    cases.append(self.node("case_clause", min(word[2], x), block.end, self.node("case_pattern", x, y), guard, block))
                return self.node("match_statement", a, b, field("subject", expr(s.subject)), field("body", self.node("block", cases[0].start, cases[-1].end, *cases)))
            case ast.Return() | ast.Raise() | ast.Assert() | ast.Delete() | ast.Pass() | ast.Break() | ast.Continue():
                kids = [expr(x) for x in ast.iter_child_nodes(s) if isinstance(x, ast.expr)]
                return self.node(_SIMPLE[type(s)], a, b, *kids)
            case ast.Global() | ast.Nonlocal():
                names, at = [], a
                for name in s.names:
                    i = self.s.find(at + 1, name)
                    names.append(self.leaf("identifier", i))
                    at = names[-1].end
                return self.node(_SIMPLE[type(s)], a, b, *names)
        return self.node("type_alias_statement", a, b, *(expr(x) for x in ast.iter_child_nodes(s) if isinstance(x, ast.expr)))

    def module(self, tree: ast.Module) -> Node:
        kids = [self.stmt(x) for x in tree.body]
        tokens = self.s.tokens
        start = min([k.start for k in kids[:1]] + [t[2] for t in tokens[:1]], default=len(self.src))
        return self.node("module", start, len(self.src), *kids)


def flat(root: Node) -> list[Node]:
    """What ``walk`` gives, as a list."""
    out, stack = [], [root]
    push, pop, more = out.append, stack.pop, stack.extend
    while stack:
        n = pop()
        push(n)
        if n.kids:
            more(n.kids[::-1])
    return out


def insert_tokens(root: Node, source: Source) -> None:
    """Put keywords, punctuation and comments into the deepest node around them, and children in source order."""
    owner: dict[int, tuple[Node, list[Node]]] = {}
    stack: list[Node] = []
    order = flat(root)
    starts = [n.start for n in order]
    if starts != sorted(starts):
        rank = {id(n): k for k, n in enumerate(order)}
        order.sort(key=lambda n: (n.start, -n.end, rank[id(n)]))
    i, n_nodes, data, comment = 0, len(order), source.data, tokenize.COMMENT
    inside = {getattr(tokenize, "FSTRING_START", -1), getattr(tokenize, "FSTRING_MIDDLE", -1), getattr(tokenize, "FSTRING_END", -1)}
    for kind, text, a, b in source.tokens:
        while i < n_nodes and (n := order[i]).start <= a:
            while stack and stack[-1].end <= n.start:
                stack.pop()
            stack.append(n)
            i += 1
        while stack and stack[-1].end < b:
            stack.pop()
        if not stack or kind in inside:
            continue
        top = stack[-1]
        if (top.start == a and top.end == b and top.named and not top.kids and kind != comment) or top.type == "string":
            continue
        new = Node("comment", a, b, data) if kind == comment else Node(text, a, b, data, None, False)
        if (more := owner.get(id(top))) is None:
            owner[id(top)] = top, [new]
        else:
            more[1].append(new)
    for n, more in owner.values():
        n.kids.extend(more)
        if len(n.kids) > 1:
            n.kids.sort(key=_START)


def _parsed(text: str) -> tuple[ast.Module, str]:
    text = text.removeprefix("\ufeff")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text), text


def _guarded(run, text: str):  # noqa: ANN001, ANN202
    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(limit, DEPTH))
        return run(text)
    except SyntaxError as e:
        raise SourceError("syntax", e.msg or "invalid syntax", max(0, (e.lineno or 1) - 1), max(0, (e.offset or 1) - 1)) from None
    except tokenize.TokenError as e:
        raise SourceError("token", str(e)) from None
    except (RecursionError, MemoryError, ValueError) as e:
        if isinstance(e, SourceError):
            raise
        raise SourceError("depth" if isinstance(e, RecursionError) else "text", str(e) or type(e).__name__) from None
    finally:
        sys.setrecursionlimit(limit)


def check(text: str) -> None:
    """SourceError if the text has no tree; a fraction of the cost of ``build``."""
    _guarded(_parsed, text)


def build(text: str) -> tuple[Node, Source]:
    """The tree of a text, ids in parents-first order, ``last`` the greatest id below. SourceError where there is none."""

    def run(text: str) -> tuple[Node, Source]:
        tree, text = _parsed(text)
        source = Source(text)
        source.tokenise()
        root = Builder(source).module(tree)
        insert_tokens(root, source)
        source.every = number(root)
        return root, source

    return _guarded(run, text)


#: Lines that are stood in for before a text counts as no Python at all.
MENDS = 40
_LINES = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")


def _stand_in(line: str, word: str) -> str:
    """A line of as many bytes, its indent and then a word that does nothing; blank where it has no room."""
    body = line.rstrip("\r\n")
    indent = body[: len(body) - len(body.lstrip(" \t\f"))]
    size = len(body[len(indent) :].encode("utf-8", "surrogatepass"))
    word = word if size >= len(word) else ""
    return indent + word + " " * (size - len(word)) + line[len(body) :]


def mend(text: str) -> tuple[str, list[SourceError], set[int]]:
    """The text with lines stood in for until it has a tree, the errors met, and the rows changed. The first SourceError if that doesn't come about.

    A line gives way to ``pass``, the head of a block to another head; where
    that helps nothing, and where the indent is at fault, it is blanked.
    """
    lines, errors, tries = _LINES.findall(text), [], {}
    whole = list(lines)
    while True:
        try:
            check("".join(lines))
            return "".join(lines), errors, set(tries)
        except SourceError as e:
            errors.append(e)
            row, what = min(e.row, len(lines) - 1), str(e)
            headless = re.match(r"expected an indented block after .* on line (\d+)", what)
            if headless:
                row = int(headless.group(1)) - 1
            elif what.startswith("expected 'except'"):
                row = max((i for i in range(row) if re.match(r"\s*try\s*:", lines[i])), default=row)
            while row > 0 and tries.get(row, 0) > 1:
                row -= 1
            if e.kind != "syntax" or len(errors) > MENDS or tries.get(row, 0) > 1:
                raise errors[0] from None
            tries[row] = tries.get(row, 0) + 1
            head = whole[row].split("#", 1)[0].rstrip().endswith(":")
            if tries[row] > 1 or ("indent" in what and not headless):
                lines[row], tries[row] = _stand_in(whole[row], ""), 2
            else:
                lines[row] = _stand_in(whole[row], "if 1:" if head and not headless else "pass")


def rescue(text: str) -> tuple[Node, Source, list[SourceError]]:
    """The tree of a text as far as it has one, and the errors in it. SourceError if it has none."""
    try:
        return (*build(text), [])
    except SourceError as e:
        if e.kind != "syntax":
            raise
    text = text.removeprefix("\ufeff")
    mended, errors, rows = mend(text)
    root, source = build(mended)
    source.text, source.data = text, text.encode("utf-8", "surrogatepass")
    for n in root.walk():
        n.src = source.data
        if n.type in ("pass_statement", "if_statement") and source.point(n.start)[0] in rows:
            n.type, n.kids = "ERROR", [k for k in n.kids if k.type == "block"]
            row = source.point(n.start)[0]
            line = source.data[source.begins[row] : [*source.begins, len(source.data)][row + 1]].rstrip()
            n.end = max(n.end, source.begins[row] + len(line))
    source.every = number(root)
    return root, source, errors


def number(root: Node) -> list[Node]:
    every = flat(root)
    for i, n in enumerate(every):
        n.id = i
    for n in reversed(every):
        n.last = n.kids[-1].last if n.kids else n.id
    return every
