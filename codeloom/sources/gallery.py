"""Source files made from rows of ``events``, each one of a topic's texts: what flat made files don't show.

A file's text is chosen by its event's number; ``$T`` stands for the event's
type, and up to four lines of comment come first, so that names and places
depend on the row. What must be found in each text is worked out by hand beside
the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import table
from codeloom.sources.corpus import spread

#: Lines of comment before a text: the event's number modulo this.
SHIFTS = 5
NOTE = "# a note"

RULES_YAML = """
- {id: G.ASSIGN, title: t, severity: low, message: m, patterns: [{kind: assignment, name: secret}]}
- {id: G.IMPORT, title: t, severity: low, message: m, patterns: [{kind: import, name: os}]}
- {id: G.STRING.NAME, title: t, severity: medium, message: m, patterns: [{kind: string_literal, name: naïve}]}
- {id: G.STRING.REGEX, title: t, severity: medium, message: m, patterns: [{kind: string_literal, regex: '\\w{4}é'}]}
- {id: G.REGEX, title: t, severity: high, message: m, patterns: [{kind: regex, regex: '(?i)^TOK_É\\w+$'}]}
- {id: G.CALL.NAME, title: t, severity: high, message: m, patterns: [{kind: call, callee: {name: run}}]}
- {id: G.CALL.QUALIFIED, title: t, severity: high, message: m, patterns: [{kind: call, callee: {qualified_name: a.b.run}}]}
- {id: G.CALL.MODULE, title: t, severity: high, message: m, patterns: [{kind: call, callee: {module: a.b}}]}
- {id: G.CALL.EQUALS, title: t, severity: high, message: m, patterns: [{kind: call, callee: {name: run, args: [{name: mode, equals: safe}]}}]}
- {id: G.CALL.NUMBER, title: t, severity: high, message: m, patterns: [{kind: call, callee: {name: run, args: [{name: n, equals: 3}]}}]}
- {id: G.CALL.BOOL, title: t, severity: high, message: m, patterns: [{kind: call, callee: {module: a, args: [{name: flag, equals: true}]}}]}
- {id: G.CALL.CONTAINS, title: t, severity: high, message: m, patterns: [{kind: call, callee: {anyOf: [run], args: [{name: mode, contains: as}]}}]}
- {id: G.CALL.REGEX, title: t, severity: high, message: m, patterns: [{kind: call, callee: {name: run, args: [{name: mode, regex: '^.s'}]}}]}
- {id: G.CALL.PRESENT, title: t, severity: high, message: m, patterns: [{kind: call, callee: {name: run, args: [{name: n, present: true}]}}]}
- {id: G.CALL.ABSENT, title: t, severity: high, message: m, patterns: [{kind: call, callee: {name: run, args: [{name: n, present: false}]}}]}
- {id: G.TWICE, title: t, severity: critical, message: m, patterns: [{kind: call, name: stop}, {kind: call, callee: {anyOf: [a.b.stop]}}]}
- {id: G.BAD, title: t, severity: low, message: m, patterns: [{kind: regex, regex: '(a)?(?(1)b|c)'}]}
"""

RULES = [
    '''import requests as rq
import yaml, pickle
from os import path as p, system

def fetch_$T(url, data):
    rq.get(url, verify=False)
    requests.post(url, verify=True)
    requests.get(url, verify=False)
    yaml.load(data)
    yaml.load(data, Loader=Safe)
    pickle.loads(data)
    eval("1")
    cursor.execute("select")
    API_KEY = "x"
''',
    '''import os
from os import sep
tok_étoile = 1
secret = "naïve idée"
other = 'plain'
secret += "caféé"
run("x", mode="safe", n=3)
a.b.run(mode='fast', flag=True)
a.b.stop(flag=" x ")
''',
]

SYMBOLS = [
    '''class Outer:
    limit = 1

    @property
    def size(self):
        """Docs."""
        if self.x and self.y:
            return 1
        return 2

    async def load(self, n=3, *rest):
        for i in rest:
            yield i

def top_$T(a, b=2):
    def inner(c):
        while c:
            c -= 1
        return c
    return inner(a)
''',
    '''import os
class A:
    class B:
        def m(self):
            def inner():
                pass
            return inner
''',
    '''def broken(:
    pass

def after_$T():
    x = 1
''',
]

CALLS = [
    '''import os
import json as js
from math import sqrt as root, floor

def helper_$T(x):
    return floor(x)

def main():
    helper_$T(1)
    alias = helper_$T
    alias(2)
    if x:
        os.getcwd()
        helper_$T(3)
    y = root(4) or helper_$T(5)
    print(js.dumps(y))
    nowhere(6)
    obj.helper_$T(7)
    obj.alias(8)
    main()

helper_$T(0)
if __name__ == "__main__":
    main()
''',
]

GRAPHS = [
    '''def a():
    b()
    c()

def b():
    d()

def c():
    d()

def d():
    e()
    b()

def e():
    pass

def lone():
    lone()
''',
    '''def run():
    step_$T()
    step_$T()

def step_$T():
    pass

def unused():
    pass
''',
]

FLOWS = [
    '''import os, sys
import html
from flask import request

def web_$T():
    a = request.args
    b = html.escape(a)
    os.system(b)

def grown():
    q = sys.argv[1]
    q += "x"
    os.system(q)
    return q

def loops():
    for i in [1]:
        k = os.environ["K"]
        os.popen(k)
    while i:
        os.popen(k)
''',
    '''import os
import sqlite3 as sq

def tried():
    try:
        z = input()
    except OSError:
        os.system(z)
    else:
        os.system(z)
    finally:
        os.system(z)

def chosen():
    z = input()
    if z:
        os.system(z)
    elif y:
        os.popen(z)
    else:
        os.remove(z)

def opened(cur, s):
    name = input()
    with open(name) as f:
        text = f.read()
    with sq.connect(name) as c, socket.socket() as sock:
        cur.execute("select ?", name)
        cur.execute("select %s")
        cur.execute("select 1")
    n = int(name)
    name = "clean"
    os.system(name)
''',
]
TOPICS = {"rules": RULES, "symbols": SYMBOLS, "calls": CALLS, "graphs": GRAPHS, "flows": FLOWS}


def files(spark: SparkSession, sf_dir: str, topic: str) -> DataFrame:
    """files(path, code): one for each event, path its number."""
    texts = F.array(*[F.lit(t) for t in TOPICS[topic]])
    e = spread(table(spark, sf_dir, "events").filter("event_id IS NOT NULL").select("event_id", "event_type"), "event_id")
    text = F.element_at(texts, (F.pmod("event_id", F.lit(len(TOPICS[topic]))) + 1).cast("int"))
    code = F.concat(F.repeat(F.lit(NOTE + "\n"), F.pmod("event_id", F.lit(SHIFTS)).cast("int")), F.replace(text, F.lit("$T"), F.col("event_type")))
    return e.select(F.col("event_id").cast("string").alias("path"), code.alias("code"))


def _value(v: object, kind: str) -> str:
    if v is None:
        return "NULL"
    if kind in ("text", "plain"):
        return "'" + str(v).replace("'", "''") + "'"
    return str(v).lower() if isinstance(v, bool) else str(v)


def expected(topic: str, columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL of the rows that the files of a topic must give, from ``events`` alone.

    rows: the number of the text, then a value for each column. Kinds of
    columns: text (with ``$T``), line (counted in the text as it stands; line0:
    0 if there is none), int, bool, double.
    """
    cast = {"text": "VARCHAR", "line": "BIGINT", "line0": "BIGINT", "int": "BIGINT", "bool": "BOOLEAN", "double": "DOUBLE"}
    # NULLs get their types from a first row that no file asks for.
    first = "(-1, " + ", ".join(f"NULL::{cast[k]}" for k in columns.values()) + ")"
    values = ", ".join([first, *("(" + ", ".join([str(r[0]), *(_value(v, k) for v, k in zip(r[1:], columns.values(), strict=True))]) + ")" for r in rows)])
    show = {"text": "replace({c}, '$T', t) AS {c}", "line": "{c} + n AS {c}", "line0": "coalesce({c} + n, 0) AS {c}"}
    shown = ", ".join(show.get(k, "{c}").format(c=c) for c, k in columns.items())
    return f"""WITH want(k, {", ".join(columns)}) AS (VALUES {values}),
made AS (SELECT event_id::VARCHAR AS path, event_type AS t, event_id % {len(TOPICS[topic])} AS k, event_id % {SHIFTS} AS n FROM events WHERE event_id IS NOT NULL)
SELECT path, {shown} FROM made JOIN want USING (k)"""
