"""What keeps time and memory in proportion to the input: counted or read off plans, not timed."""

import pyarrow as pa

from codeloom.operators import analytics, callgraph, taint
from codeloom.plans import exports, queries
from codeloom.sources.facts import CHARS, TEXTS, File, each, facts
from codeloom.sources.files import from_strings
from codeloom.sources.tree import Node, Source

CALLING = "def main():\n    a()\n    os.getcwd()\n\ndef a():\n    a()\n\ndef lone():\n    pass\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_join_of_a_graph_is_sent_to_the_driver(spark):
    g = callgraph.graph(from_strings(spark, CALLING))
    reached = analytics.reach(g.symbols, g.edges, analytics.default_entries(g.symbols, g.edges, g.entry_points))
    made = [f(g, reached) for f in (exports.dot, exports.graph_json, exports.graphml, exports.cytoscape)]
    made += [analytics.statistics(g, reached), analytics.critical(g.symbols, g.edges), analytics.impact(g.symbols, g.edges), analytics.reach_tree(g.symbols, g.edges, reached), analytics.dead_code(g.symbols, reached)]
    for df in made:
        assert "Join" in plan(df) and "Broadcast" not in plan(df)
        assert df.count()


def batches(rows, at_once):
    return iter([pa.RecordBatch.from_arrays([pa.array([f"p{i}" for i in range(lo, min(lo + at_once, len(rows)))]), pa.array(rows[lo : lo + at_once], pa.string())], names=["path", "code"]) for lo in range(0, len(rows), at_once)])


SCHEMA = pa.schema([("path", pa.string()), ("n", pa.int32()), ("x", pa.list_(pa.struct([("t", pa.string()), ("m", pa.map_(pa.string(), pa.string()))])))])


def test_a_text_that_many_files_share_is_parsed_once():
    calls = []

    def make(code):
        calls.append(code)
        return len(code or ""), None if code is None else [{"t": code, "m": {code: "v"}}, {}]

    rows = [None if i % 7 == 3 else f"text {i % 7}" for i in range(5000)]
    out = list(each(batches(rows, 1000), make, SCHEMA))
    assert sorted(calls, key=str) == sorted(set(rows), key=str)
    got = [r for b in out for r in b.to_pylist()]
    assert got == [{"path": f"p{i}", "n": len(c or ""), "x": None if c is None else [{"t": c, "m": [(c, "v")]}, {"t": None, "m": None}]} for i, c in enumerate(rows)]


def test_what_a_worker_keeps_of_texts_is_bounded():
    rows = ["a" * (CHARS // 4) + str(i) for i in range(20)] + ["b"] * 3000 + [str(i) for i in range(3000)]
    calls = []
    out = list(each(batches(rows, 2000), lambda c: (len(calls.append(c) or c), []), SCHEMA))
    assert [r["n"] for b in out for r in b.to_pylist()] == list(map(len, rows)) and len(calls) == len(set(rows))
    assert max(sum(b.column(1).to_pylist()) for b in out) < 2 * CHARS and max(b.num_rows for b in out) <= TEXTS


def test_files_of_one_text_have_their_own_paths(spark):
    code = "import os\ndef f():\n    a = input()\n    os.system(a)\n"
    paths = ["a", "b", "c", "d"]
    files = from_strings(spark, list(zip(paths, [code, code, code, "x = 1\n"])))
    found = taint.analyse(files)
    assert sorted(r["source_location"] for r in taint.taint_paths(found).collect()) == sorted(f"{p}:3" for p in paths[:3])
    assert sorted((r["path"], len(r["calls"])) for r in facts(files, ["calls"]).collect()) == sorted(zip(paths, [2, 2, 2, 0]))


def test_graphs_that_are_alike_are_walked_once():
    calls = []

    def run(g):
        calls.append(g.names)
        return [(n, len(g.next.get(n, ()))) for n in g.names if n != "z"]

    kinds = [(["a", "b"], ["a", "a"], ["b", "b"]), (["a", "b"], None, None), (["z"], ["z"], ["z"]), (["a", "b"], ["b"], ["a"])]
    rows = [kinds[i % 4] for i in range(6000)]
    columns = [pa.array([f"p{i}" for i in range(6000)]), *(pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in range(3))]
    arrow = pa.schema([("path", pa.string()), ("name", pa.string()), ("n", pa.int32())])
    out = list(analytics.each_graph([pa.RecordBatch.from_arrays(columns, names=["path", "s", "a", "b"])], run, arrow))
    want = {0: [("a", 2), ("b", 0)], 1: [("a", 0), ("b", 0)], 2: [], 3: [("a", 0), ("b", 1)]}
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(f"p{i}", *x) for i in range(6000) for x in want[i % 4]]
    assert len(calls) == 4 and len(out) < 10


def test_a_parse_walks_its_tree_no_more_than_it_must(monkeypatch):
    walks = []
    walk = Node.walk
    monkeypatch.setattr(Node, "walk", lambda self: (walks.append(self.type), walk(self))[1])
    for code in ("import os\r\nx = (1 + 2) # é\r\ndef f(a, *b):\n    return a\n", "x = 1\n", ""):
        file = File(code)
        assert not walks
        assert file.all == list(walk(file.root)) and [n.id for n in file.all] == list(range(len(file.all)))
    assert Source("x = 1\n")._lines is None and Source("é\r\n\rx\n").begins == [0, 4, 5, 7]


def test_a_document_is_read_back_in_one_pass(spark, sf):
    assert "get_json_object" not in plan(queries.scan_documents(spark, sf))
