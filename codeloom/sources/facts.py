"""One narrow pass from files to facts: every file becomes one row of nested arrays.

``facts(files, parts)`` parses each file once inside an Arrow batch (files of
the same text that come near each other together) and emits only the parts
asked for; nothing is shuffled. ``explode_part`` turns a part
into a table. A file that has no tree gives empty parts and a row in
``errors``; it never fails the task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from time import perf_counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.sources.tree import Node, Source, SourceError, check, mend, rescue

PLACE = "sl:int,sc:int,el:int,ec:int,sb:int,eb:int"
CALL = "id:int,func_id:int,caller:string,top_level:boolean,main_block:boolean,conditional:boolean,fn:string,qn:string,text:string"
ARG = "struct<pos:int,type:string,text:string,name:string,value:string,idents:array<string>>"
RHS = "struct<type:string,text:string,base:string,fn:string,qn:string,module:string,first_arg:string,idents:array<string>,args:array<array<string>>>"
PARTS = {
    "nodes": f"array<struct<id:int,parent:int,ord:int,last:int,depth:int,field:string,type:string,named:boolean,text:string,snippet:string,fn:string,qn:string,kw:map<string,string>,names:array<string>,{PLACE}>>",
    "calls": f"array<struct<{CALL},args:array<{ARG}>,kw:map<string,string>,{PLACE}>>",
    "imports": f"array<struct<id:int,kind:string,module:string,names:array<string>,aliases:array<struct<name:string,alias:string>>,text:string,{PLACE}>>",
    "functions": f"array<struct<id:int,last:int,name:string,params:array<string>,body_id:int,body_last:int,{PLACE}>>",
    "symbols": "array<struct<ord:int,name:string,qualified_name:string,node_type:string,start_line:int,start_column:int,end_line:int,end_column:int,parameters:array<string>,is_async:boolean,is_generator:boolean,docstring:string,decorators:array<string>,complexity:int>>",
    "scope": "struct<aliases:map<string,string>,names:array<string>,imports:map<string,string>,modules:array<string>,total_scopes:int,max_level:int,functions_per_scope:map<string,int>>",
    "modules": "struct<aliases:map<string,string>,names:map<string,string>>",
    "accesses": "array<struct<id:int,type:string,text:string>>",
    "stmts": f"array<struct<func_id:int,func:string,seq:int,op:string,nested:boolean,line:int,call_line:int,target:string,rhs:{RHS}>>",
    "strings": f"array<struct<id:int,text:string,{PLACE}>>",
    "lines": "array<string>",
    "stats": "struct<total_lines:int,non_empty_lines:int,functions:int,calls:int,imports:int,size_bytes:int>",
    "parse_ms": "double",
    "errors": "array<struct<stage:string,message:string,line:int,column:int>>",
}
WEIGHTS = {"if": 4, "elif": 4, "for": 4, "while": 4, "and": 2, "or": 2} | dict.fromkeys("else try except finally with break continue return yield raise assert".split(), 1)
_KEYWORD = re.compile(r"\b(" + "|".join(WEIGHTS) + r")\b", re.IGNORECASE)
#: Beyond this many enclosing definitions a symbol is listed under its full chain and its module name only (all chains are 2 ** depth); the file then has an error row that says so.
NESTING = 14


def complexity(text: str) -> int:
    """1 and the weighted number of control-flow words anywhere in a text, strings and comments included."""
    return max(1, int(1 + sum(WEIGHTS[w.lower()] for w in _KEYWORD.findall(text) if w.lower() in WEIGHTS) / 4))


def function_name(call: Node) -> str:
    f = call.get("function")
    if f is None:
        return ""
    if f.type == "attribute":
        a = f.get("attribute")
        return a.text if a is not None else ""
    return f.text


def _dotted(n: Node) -> str:
    """Text of a chain of attributes, whatever stands at its base."""
    tail = []
    while n.type == "attribute" and (o := n.get("object")) is not None and (a := n.get("attribute")) is not None:
        tail.append(a.text)
        n = o
    return ".".join([n.text, *reversed(tail)])


def qualified_name(call: Node) -> str:
    f = call.get("function")
    if f is not None and f.type == "attribute":
        o = f.get("object")
        if o is not None and o.type in ("identifier", "attribute"):
            return _dotted(f)
    return function_name(call)


def call_arguments(call: Node) -> list[Node]:
    a = call.get("arguments")
    return a.own() if a is not None else []


def keywords(call: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for a in call_arguments(call):
        if a.type == "keyword_argument":
            out.setdefault(a.get("name").text, a.get("value").text)
    return out


def identifiers(n: Node) -> list[str]:
    return [x.text for x in n.walk() if x.type == "identifier"]


def variable(n: Node) -> str | None:
    """The variable an assignment's left side stands for; None for patterns."""
    while n.type == "subscript" and n.get("value") is not None:
        n = n.get("value")
    return n.text if n.type in ("identifier", "attribute") else None


def import_module(n: Node) -> str:
    m = n.get("name") if n.type == "import_statement" else n.get("module_name")
    return m.text if m is not None else ""


def import_names(n: Node) -> list[str]:
    """Of a plain import the first name alone; of a from-import all dotted names, its module's among them."""
    if n.type == "import_statement":
        m = n.get("name")
        return [m.text] if m is not None else []
    out = []
    for k in n.own():
        if k.type == "dotted_name":
            out.append(k.text)
        elif k.type == "aliased_import":
            out.append(k.get("name").text)
    return out


IMPORTS = ("import_statement", "import_from_statement")


def _conditional(n: Node, k: Node) -> bool:
    """Whether a child of a node is not always run: a branch, a loop's body, a handler, the right side of and/or."""
    if n.type == "if_statement":
        return k.field != "condition"
    if n.type in ("for_statement", "while_statement"):
        return k.field in ("body", "alternative")
    if n.type == "conditional_expression":
        return k is not [x for x in n.kids if x.named][1]
    if n.type == "boolean_operator":
        return k.field == "right"
    return n.type in ("except_clause", "except_group_clause", "case_clause")


class Scope:
    def __init__(self, name: str, parent: Scope | None, kind: str) -> None:
        self.name, self.parent, self.kind = name, parent, kind
        self.level = parent.level + 1 if parent else 0
        self.symbols: dict[str, str] = {}
        self.aliases: dict[str, str] = {}

    def qualify(self, name: str) -> str:
        if self.parent is None:
            return name
        above = self.parent.qualify("")
        return f"{above}.{self.name}.{name}" if above else f"{self.name}.{name}"

    def clean(self, name: str) -> str:
        parts, s = [name], self
        while s.parent is not None:
            parts.append(s.name)
            s = s.parent
        return ".".join(reversed(parts))

    def resolve(self, name: str) -> str | None:
        s: Scope | None = self
        while s is not None:
            if name in s.aliases:
                return s.aliases[name]
            if name in s.symbols:
                return s.symbols[name]
            s = s.parent
        return None


class Symbols:
    """The symbol table of a file.

    Compatible mode lists every definition under each chain of enclosing
    definitions that a walk which visits bodies twice meets (so a method ``m``
    of ``C`` is both ``C.m`` and ``m``); strict mode lists it once.
    """

    def __init__(self, root: Node, source: Source, strict: bool) -> None:
        self.source, self.strict = source, strict
        self.table: dict[str, dict] = {}
        self.imports: dict[str, str] = {}
        self.modules: list[str] = []
        for n in root.walk():
            if n.type in IMPORTS:
                self._import(n)
        self.top = Scope("<module>", None, "module")
        self.scopes = [self.top]
        self.visit(root, self.top)

    def _import(self, n: Node) -> None:
        module = import_module(n)
        if module not in self.modules:
            self.modules.append(module)
        if not self.strict:
            for name in import_names(n):
                self.imports[name] = f"{module}.{name}" if module else name
            return
        for k in n.kids:
            if k.field != "name":
                continue
            name = k.get("name").text if k.type == "aliased_import" else k.text
            alias = k.get("alias").text if k.type == "aliased_import" else name
            self.imports[alias] = name if n.type == "import_statement" else f"{module}.{name}"

    def visit(self, root: Node, scope: Scope) -> None:
        """Children in order; a definition's inside comes first in its own scope, then (compatible mode) in this one."""
        stack: list[tuple[Node, Scope, int]] = [(root, scope, 0)]
        while stack:
            n, s, depth = stack.pop()
            inner: list[tuple[Node, Scope, int]] = []
            if n.type in ("function_definition", "class_definition") and n.get("name") is not None:
                own = self._define(n, s)
                depth += 1
                body = n.get("body")
                if body is not None:
                    inner = [(body, own, depth)]
            elif n.type == "assignment":
                self._alias(n, s)
            again: list[tuple[Node, Scope, int]] = []
            if not inner or not (self.strict or (depth > NESTING and s.parent is not None)):
                again = [(k, s, depth) for k in n.kids if k.kids]
            stack.extend(reversed([*inner, *again]))

    def _in_class(self, scope: Scope) -> bool:
        if self.strict:
            return scope.kind == "class"
        s: Scope | None = scope
        while s is not None:
            if s.parent is not None and s.name[:1].isupper() and not any(o.name == s.name and o.level < s.level for o in self.scopes):
                return True
            s = s.parent
        return False

    def _define(self, n: Node, scope: Scope) -> Scope:
        name = n.get("name").text
        if n.type == "class_definition":
            own = Scope(name, scope, "class")
            self.scopes.append(own)
            return own
        full = scope.clean(name) if self.strict else scope.qualify(name)
        text, parameters = n.text, n.get("parameters")
        (a, b), (c, d) = self.source.point(n.start), self.source.point(n.end)
        self.table[full] = {
            "ord": self.table[full]["ord"] if full in self.table else len(self.table),
            "name": name, "qualified_name": full, "node_type": "method" if self._in_class(scope) else "function",
            "start_line": a + 1, "start_column": b + 1, "end_line": c + 1, "end_column": d + 1,
            "parameters": [p.text for p in parameters.own()] if parameters is not None else [],
            "is_async": "async" in text[:20], "is_generator": "yield" in text,
            "docstring": self._docstring(n), "decorators": self._decorators(n), "complexity": complexity(text),
        }
        scope.symbols[name] = full
        own = Scope(name, scope, "function")
        self.scopes.append(own)
        return own

    def _docstring(self, n: Node) -> str | None:
        """Compatible mode looks for a bare string in the block, where the grammar puts none."""
        body = n.get("body")
        if not self.strict or body is None or not body.own():
            return None
        first = next((k for k in body.own() if k.type != "comment"), None)
        if first is None or first.type != "expression_statement" or not first.kids or first.kids[0].type != "string":
            return None
        text = first.kids[0].text.strip("'\"")
        return text[:200] + "..." if len(text) > 200 else text

    def _decorators(self, n: Node) -> list[str]:
        """Compatible mode looks inside the definition, where the grammar puts none."""
        return list(self.marks.get(id(n), [])) if self.strict else []

    marks: dict[int, list[str]] = {}

    def _alias(self, n: Node, scope: Scope) -> None:
        left, right = n.get("left"), n.get("right")
        if left is None or right is None or left.type != "identifier":
            return
        if right.type == "identifier":
            known = scope.resolve(right.text)
            if known:
                scope.aliases[left.text] = known
        elif right.type == "attribute":
            o, a = right.get("object").text, right.get("attribute").text
            base = self.imports.get(o) or (o if o in self.modules else scope.resolve(o)) or o
            scope.aliases[left.text] = f"{base}.{a}"


class File:
    """Everything the parts need of one parsed file."""

    def __init__(self, text: str, strict: bool = False) -> None:
        self.root, self.source, self.errors = rescue(text)
        self.strict = strict
        self.all = self.source.every
        self.split = self.source.text.splitlines()

    def place(self, n: Node) -> dict:
        (a, b), (c, d) = self.source.point(n.start), self.source.point(n.end)
        return {"sl": a, "sc": b, "el": c, "ec": d, "sb": n.start, "eb": n.end}

    def snippet(self, n: Node, context: int = 2) -> str:
        a, b = self.source.point(n.start)[0], self.source.point(n.end)[0]
        return "\n".join(self.split[max(0, a - context) : min(len(self.split), b + context + 1)])

    def nodes(self, kinds: frozenset[str] | None, want: frozenset[str]) -> list[dict]:
        # By id: a node's number is its place among all.
        above: list[Node | None] = [None] * len(self.all)
        depth = [0] * len(self.all)
        out = []
        for n in self.all:
            d = depth[n.id]
            for k in n.kids:
                depth[k.id], above[k.id] = d + 1, n
            if kinds is not None and n.type not in kinds:
                continue
            up = above[n.id]
            row = {"id": n.id, "parent": up.id if up else None, "last": n.last, "depth": d, "field": n.field or None, "type": n.type, "named": n.named, **self.place(n)}
            row["ord"] = up.kids.index(n) if up and "ord" in want else None
            row["text"] = n.text if "text" in want else None
            row["snippet"] = self.snippet(n) if "snippet" in want else None
            if n.type == "call":
                row |= {"fn": function_name(n), "qn": qualified_name(n), "kw": keywords(n)}
            elif n.type in IMPORTS:
                row["names"] = [import_module(n), *import_names(n)]
            out.append(row)
        return out

    def callers(self) -> dict[int, tuple[int | None, str | None, bool, bool, bool]]:
        """Of each call: the id of its function, the caller's bare name, whether it stands outside all functions, in a main block, and under a condition of its function."""
        out: dict[int, tuple[int | None, str | None, bool, bool, bool]] = {}
        stack: list[tuple[Node, int | None, str | None, bool, bool, bool, bool]] = [(self.root, None, None, True, False, True, False)]
        while stack:
            n, func, caller, top, main, open_, under = stack.pop()
            if n.type == "call":
                out[n.id] = func, caller if open_ else None, top and open_, main, under
            if n.type == "function_definition":
                body, name = n.get("body"), n.get("name").text
                stack.extend((k, n.id, name, False, main, True, False) if k is body else (k, func, None, top, main, False, under) for k in n.kids)
            elif n.type == "if_statement" and not main and (c := n.get("condition")) is not None and "__name__" in c.text and "__main__" in c.text:
                stack.extend((k, func, caller, top, k.field == "consequence", open_, under or k.field != "condition") for k in n.kids)
            else:
                stack.extend((k, func, caller, top, main, open_, under or _conditional(n, k)) for k in n.kids)
        return out

    def too_deep(self) -> bool:
        """Whether definitions are nested deeper than all their chains are listed."""
        stack = [(self.root, 0)]
        while stack:
            n, depth = stack.pop()
            depth += n.type in ("function_definition", "class_definition")
            if depth > NESTING:
                return True
            stack.extend((k, depth) for k in n.kids if k.kids)
        return False

    def calls(self) -> list[dict]:
        around = self.callers()
        out = []
        for n in self.all:
            if n.type != "call":
                continue
            func, caller, top, main, under = around[n.id]
            args = []
            for i, a in enumerate(call_arguments(n)):
                key = a.type == "keyword_argument"
                args.append({"pos": i, "type": a.type, "text": a.text, "name": a.get("name").text if key else None, "value": a.get("value").text if key else None, "idents": identifiers(a)})
            out.append({"id": n.id, "func_id": func, "caller": caller, "top_level": top, "main_block": main, "conditional": under, "fn": function_name(n), "qn": qualified_name(n), "text": n.text, "args": args, "kw": keywords(n), **self.place(n)})
        return out

    def imports(self) -> list[dict]:
        out = []
        for kind in IMPORTS:
            for n in self.all:
                if n.type != kind:
                    continue
                aliases = [{"name": k.get("name").text, "alias": k.get("alias").text} if k.type == "aliased_import" else {"name": k.text, "alias": None} for k in n.kids if k.field == "name"]
                out.append({"id": n.id, "kind": "import" if kind == IMPORTS[0] else "from", "module": import_module(n), "names": import_names(n), "aliases": aliases, "text": n.text, **self.place(n)})
        return out

    def functions(self) -> list[dict]:
        out = []
        for n in self.all:
            if n.type == "function_definition":
                body, p = n.get("body"), n.get("parameters")
                out.append({"id": n.id, "last": n.last, "name": n.get("name").text, "params": [x.text for x in p.own()], "body_id": body.id, "body_last": body.last, **self.place(n)})
        return out

    def symbols(self) -> Symbols:
        if not hasattr(self, "_symbols"):
            if self.strict:
                Symbols.marks = {id(n.get("definition")): [k.text.lstrip("@") for k in n.kids if k.type == "decorator"] for n in self.all if n.type == "decorated_definition"}
            self._symbols = Symbols(self.root, self.source, self.strict)
        return self._symbols

    def scope(self) -> dict:
        s = self.symbols()
        return {
            "aliases": s.top.aliases, "names": list(s.top.symbols), "imports": s.imports, "modules": s.modules,
            "total_scopes": len(s.scopes), "max_level": max(x.level for x in s.scopes), "functions_per_scope": {x.name: len(x.symbols) for x in s.scopes},
        }

    def modules(self) -> dict:
        """alias -> module of plain imports; name -> module of from-imports, the module's own name among them."""
        aliases: dict[str, str] = {}
        names: dict[str, str] = {}
        for n in self.all:
            if n.type == "import_statement":
                for k in n.kids:
                    if k.type == "dotted_name":
                        aliases[k.text] = k.text
                    elif k.type == "aliased_import":
                        aliases[k.get("alias").text] = k.get("name").text
            elif n.type == "import_from_statement":
                module = import_module(n)
                for k in n.kids:
                    if k.type == "dotted_name" and not (self.strict and k.field == "module_name"):
                        names[k.text] = module
                    elif k.type == "aliased_import":
                        names[k.get("alias").text] = module
        return {"aliases": aliases, "names": names}

    def accesses(self) -> list[dict]:
        """Attributes by their text, subscripts by the text of what is subscripted."""
        out = []
        for n in self.all:
            if n.type == "attribute":
                out.append({"id": n.id, "type": n.type, "text": n.text})
            elif n.type == "subscript" and n.get("value") is not None:
                out.append({"id": n.id, "type": n.type, "text": n.get("value").text})
        return out

    def strings(self) -> list[dict]:
        return [{"id": n.id, "text": n.text, **self.place(n)} for n in self.all if n.type == "string"]

    def stats(self) -> dict:
        count = {"function_definition": 0, "call": 0}
        imports = 0
        for n in self.all:
            if n.type in count:
                count[n.type] += 1
            imports += n.type in IMPORTS
        return {"total_lines": len(self.split), "non_empty_lines": sum(1 for x in self.split if x.strip()), "functions": count["function_definition"], "calls": count["call"], "imports": imports, "size_bytes": len(self.source.data)}

    def stmts(self) -> list[dict]:
        modules = self.modules()
        out: list[dict] = []
        for n in self.all:
            if n.type == "function_definition" and n.get("body") is not None:
                name = n.get("name").text
                for seq, (op, nested, target, rhs, line) in enumerate(self._walk(n.get("body"))):
                    call_line = self.source.point(rhs.start)[0] + 1 if rhs is not None else None
                    out.append({"func_id": n.id, "func": name, "seq": seq, "op": op, "nested": nested, "line": line, "call_line": call_line, "target": target, "rhs": self._rhs(rhs, modules) if rhs is not None else None})
        return out

    def _rhs(self, n: Node, modules: dict) -> dict:
        base = n.get("value") if n.type == "subscript" else None
        out = {"type": n.type, "text": n.text, "base": base.text if base is not None else None, "idents": identifiers(n)}
        if n.type == "call":
            qn, args = qualified_name(n), call_arguments(n)
            head = qn.split(".", 1)[0]
            out |= {"fn": function_name(n), "qn": qn, "module": modules["aliases"].get(head) if "." in qn else modules["names"].get(qn), "first_arg": args[0].text if args else None, "args": [identifiers(a) for a in args]}
        return out

    def _walk(self, block: Node) -> Iterator[tuple[str, bool, str | None, Node | None, int]]:
        """(operation, whether under a condition, target, expression, line) of the statements data can flow through, in order.

        Compatible mode skips what follows the first alternative of an if, and
        the handlers and finally clause of a try.
        """
        stack = [(k, False) for k in reversed(block.kids)]

        def enter(blocks: list[Node | None], nested: bool) -> None:
            stack.extend((k, nested) for b in reversed(blocks) if b is not None for k in reversed(b.kids))

        while stack:
            n, nested = stack.pop()
            kind = n.type
            if kind == "expression_statement" and n.kids:
                n = n.kids[0]
                kind = n.type
                if kind == "call":
                    yield "call", nested, None, n, self.source.point(n.start)[0] + 1
            if kind in ("assignment", "augmented_assignment"):
                left, right = n.get("left"), n.get("right")
                if left is not None and right is not None and (target := variable(left)):
                    yield ("assign" if kind == "assignment" else "augment"), nested, target, right, self.source.point(n.start)[0] + 1
            elif kind == "return_statement":
                if len(n.kids) > 1:
                    yield "return", nested, None, n.kids[1], self.source.point(n.start)[0] + 1
            elif kind == "if_statement":
                blocks = [n.get("consequence")]
                others = [k for k in n.kids if k.field == "alternative"]
                for k in others if self.strict else others[:1]:
                    blocks.append(k.get("body") or k.get("consequence"))
                enter(blocks, True)
            elif kind in ("for_statement", "while_statement"):
                blocks = [n.get("body")]
                if self.strict and n.get("alternative") is not None:
                    blocks.append(n.get("alternative").get("body"))
                enter(blocks, True)
            elif kind == "with_statement":
                for item in (i for c in n.kids if c.type == "with_clause" for i in c.kids if i.type == "with_item"):
                    for value in item.kids:
                        value = value.kids[0] if value.type == "as_pattern" and value.kids else value
                        if value.type == "call":
                            yield "call", nested, None, value, self.source.point(value.start)[0] + 1
                enter([n.get("body")], nested)
            elif kind == "try_statement":
                blocks = [n.get("body")]
                for k in n.kids:
                    if k.type == "else_clause":
                        blocks.append(k.get("body"))
                    elif self.strict and k.type in ("except_clause", "except_group_clause", "finally_clause"):
                        blocks.extend(x for x in k.kids if x.type == "block")
                enter(blocks, True)

    def part(self, name: str, kinds: frozenset[str] | None, want: frozenset[str], deep: bool = False) -> object:
        if name == "nodes":
            return self.nodes(kinds, want)
        if name == "symbols":
            return sorted(self.symbols().table.values(), key=lambda r: r["ord"])
        if name == "lines":
            return self.split
        if name == "errors":
            nested = [{"stage": "symbols", "message": f"definitions nested more than {NESTING} deep", "line": 1, "column": 1}] if deep and not self.strict and self.too_deep() else []
            return [*_partial(self.errors), *nested]
        return getattr(self, name)()


def _partial(errors: list[SourceError]) -> list[dict]:
    """Rows of the errors of a file that has a tree but for some lines."""
    return [{"stage": "partial", "message": str(e), "line": e.row + 1, "column": e.column + 1} for e in errors]


def opened(code: object, strict: bool) -> File:
    """A parsed file. SourceError or UnicodeDecodeError if there is no tree."""
    if code is None:
        raise SourceError("read", "no text")
    return File(code.decode("utf-8") if isinstance(code, bytes) else code, strict)


def _inputs(files: DataFrame) -> DataFrame:
    code = F.col("code") if isinstance(files.schema["code"].dataType, (T.BinaryType, T.StringType)) else F.col("code").cast("string")
    return files.select(F.col("path").cast("string").alias("path"), code.alias("code"))


#: A worker keeps what it made of so many characters of text, or so many texts; files of the same text share it. So many characters of files leave it at a time.
CHARS, TEXTS = 1 << 18, 1024


def each(batches: Iterator[pa.RecordBatch], make: Callable[[object], tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(path, *make(code)) of batches of (path, code); make is called once for all files of one text that come near each other."""
    kinds = [f.type for f in arrow][1:]
    at: dict[object, int] = {}
    made: list[pa.Array] = []
    new: list[tuple] = []
    size = 0

    def ready(paths: pa.Array, places: list[int]) -> pa.RecordBatch:
        nonlocal made
        if new:
            columns = [column(list(c), k) for c, k in zip(zip(*new, strict=True), kinds, strict=True)]
            made = [pa.concat_arrays(x) for x in zip(made, columns, strict=True)] if made else columns
            new.clear()
        whole = len(places) == len(at) and places == list(range(len(places)))
        return pa.RecordBatch.from_arrays([paths, *(made if whole else [c.take(pa.array(places)) for c in made])], schema=arrow)

    for batch in batches:
        paths, lo, heft, places = batch.column(0), 0, 0, []
        for i, code in enumerate(batch.column(1)):
            code = code.as_py()
            n = len(code) if code is not None else 0
            k = at.get(code)
            if k is None:
                if at and (size + n > CHARS or len(at) >= TEXTS):
                    if places:
                        yield ready(paths.slice(lo, i - lo), places)
                    lo, heft, places, size = i, 0, [], 0
                    at, made = {}, []
                    new.clear()
                k = at[code] = len(at)
                new.append(make(code))
                size += n
            places.append(k)
            heft += n
            if heft >= CHARS or len(places) >= TEXTS:
                yield ready(paths.slice(lo, i + 1 - lo), places)
                lo, heft, places = i + 1, 0, []
        if places:
            yield ready(paths.slice(lo), places)


def per_file(files: DataFrame, run: Callable[[File | None], tuple], schema: str, strict: bool = False) -> DataFrame:
    """A row (path, ``schema``) for each of files (path, code), made from its parsed file (None if it has no tree); no shuffle."""
    kind = T.StructType.fromDDL("path string, " + schema)
    arrow = to_arrow_schema(kind)

    def make(code: object) -> tuple:
        try:
            file = opened(code, strict)
        except (SourceError, UnicodeDecodeError):
            file = None
        return run(file)

    return _inputs(files).mapInArrow(lambda batches: each(batches, make, arrow), kind)


def facts(files: DataFrame, parts: Iterable[str], strict: bool = False, kinds: Iterable[str] | None = None, want: Iterable[str] = ("text", "snippet")) -> DataFrame:
    """(path, *parts) of files (path, code): one row a file, no shuffle; a text that files near each other share is parsed once.

    kinds: the node kinds that ``nodes`` holds (all if None); want: its costly
    columns, of text, snippet and ord. code may be a string or bytes; a null
    code is an error row, an empty one an empty module.
    """
    parts = list(parts)
    schema = T.StructType.fromDDL("path string, " + ", ".join(f"{p} {PARTS[p]}" for p in parts))
    arrow = to_arrow_schema(schema)
    bare, deep = set(parts) <= {"errors"}, bool({"symbols", "scope"} & set(parts))
    kinds_, want_ = None if kinds is None else frozenset(kinds), frozenset(want)

    def make(code: object) -> tuple:
        error = file = None
        partial: list[dict] = []
        began = perf_counter()
        try:
            if bare and code is not None:
                text = code.decode("utf-8") if isinstance(code, bytes) else code
                try:
                    check(text)
                except SourceError as e:
                    if e.kind != "syntax":
                        raise
                    partial = _partial(mend(text.removeprefix("\ufeff"))[1])
            else:
                file = opened(code, strict)
        except (SourceError, UnicodeDecodeError) as e:
            at = (e.row, e.column, e.kind) if isinstance(e, SourceError) else (0, 0, "decode")
            error = {"stage": at[2], "message": str(e), "line": at[0] + 1, "column": at[1] + 1}
        took = (perf_counter() - began) * 1000
        out = []
        for name in parts:
            if name == "parse_ms":
                out.append(took)
            elif file is not None:
                out.append(file.part(name, kinds_, want_, deep))
            elif name == "errors":
                out.append([error] if error else partial)
            else:
                out.append([] if PARTS[name].startswith("array") else None)
        return tuple(out)

    return _inputs(files).mapInArrow(lambda batches: each(batches, make, arrow), schema)


def column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists and dicts (of structs and maps), made field by field."""
    if pa.types.is_struct(kind):
        fields = [column([None if v is None else v.get(f.name) for v in values], f.type) for f in kind]
        gone = [v is None for v in values]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array(gone) if any(gone) else None)
    if pa.types.is_map(kind) or pa.types.is_list(kind):
        offsets: list[int | None] = []
        n = 0
        for v in values:
            offsets.append(None if v is None else n)
            n += len(v or ())
        starts = pa.array([*offsets, n], pa.int32())
        if pa.types.is_map(kind):
            return pa.MapArray.from_arrays(starts, column([k for v in values for k in v or ()], kind.key_type), column([x for v in values if v for x in v.values()], kind.item_type), type=kind)
        return pa.ListArray.from_arrays(starts, column([x for v in values for x in v or ()], kind.value_type), type=kind)
    return pa.array(values, kind)


def explode_part(made: DataFrame, part: str, *keep: str) -> DataFrame:
    """A row for each element of an array part, its fields as columns beside path (and ``keep``)."""
    return made.select("path", *keep, F.explode(part).alias("__x")).select("path", *keep, "__x.*")
