"""Call graphs as DOT, JSON, GraphML and Cytoscape documents: a row (path, document) for each graph.

Every line of a document is made by an expression; a graph's lines come
together in one aggregation by path.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.analytics import reachable
from codeloom.operators.callgraph import Graph
from codeloom.runtime import apart

XML = '<?xml version="1.0" encoding="UTF-8"?>'
SPACE = "http://graphml.graphdrawing.org/xmlns"
LAYOUTS = {"hierarchical": "rankdir=TB;", "force": "layout=fdp;", "circular": "layout=circo;", "tree": "layout=dot;"}
STYLE = [
    {"selector": "node", "style": {"label": "data(name)", "color": "white", "background-color": "#666", "font-size": "10px", "text-halign": "center", "text-valign": "center", "height": "mapData(complexity, 1, 20, 20, 60)", "width": "mapData(complexity, 1, 20, 20, 60)"}},
    {"selector": "node[entry_point = true]", "style": {"border-color": "#008000", "border-width": "2px", "background-color": "#90EE90"}},
    {"selector": "node[reachable = false]", "style": {"opacity": "0.5", "background-color": "#999"}},
    {"selector": "edge", "style": {"width": "mapData(confidence, 0, 1, 1, 3)", "curve-style": "bezier", "line-color": "#ccc", "target-arrow-color": "#ccc", "target-arrow-shape": "triangle"}},
    {"selector": 'edge[call_type = "recursive"]', "style": {"target-arrow-color": "#ff0000", "line-color": "#ff0000"}},
]


@dataclass(frozen=True)
class Options:
    include_external: bool = True
    include_unresolved: bool = False
    only_reachable: bool = False
    layout: str = "hierarchical"
    parameters: bool = False
    decorators: bool = False
    docstring: bool = False
    line_numbers: bool = True
    call_expression: bool = False
    clustering: bool = False


def _nodes(g: Graph, reached: DataFrame, o: Options) -> DataFrame:
    r = reachable(reached).select("path", F.col("name").alias("qualified_name"), F.lit(True).alias("is_reachable"))
    e = g.entry_points.select("path", F.col("name").alias("qualified_name"), F.lit(True).alias("is_entry_point"))
    n = g.symbols.join(apart(r), ["path", "qualified_name"], "left").join(apart(e), ["path", "qualified_name"], "left").na.fill(False, ["is_reachable", "is_entry_point"])
    return n.filter("is_reachable") if o.only_reachable else n


def _outside(g: Graph, o: Options) -> DataFrame:
    x = g.external_calls()
    if not o.include_external:
        return x.filter(F.lit(False))
    return x if o.include_unresolved else x.filter(~F.col("callee").startswith("<builtin>"))


def _edges(g: Graph, n: DataFrame, external: bool) -> DataFrame:
    """Edges whose caller is shown, and whose callee is shown or (with ``external``) is no symbol."""
    names = n.select("path", F.col("qualified_name").alias("__q")).distinct()
    e = g.edges.join(apart(names.withColumnRenamed("__q", "caller")), ["path", "caller"], "left_semi")
    inside = e.join(apart(names.withColumnRenamed("__q", "callee")), ["path", "callee"], "left_semi")
    return inside.unionByName(e.filter(~F.col("internal"))) if external else inside


def _lines(df: DataFrame, part: int, line: Column) -> DataFrame:
    return df.select("path", F.lit(part).alias("part"), F.col("ord").cast("long").alias("ord"), line.alias("line"))


def _together(paths: DataFrame, parts: list[DataFrame], head: str, between: dict[int, str], tail: str) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    grouped = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))).alias("x"))
    pick = lambda k: F.array_join(F.transform(F.filter(F.coalesce("x", F.expr("filter(x, y -> false)")), lambda y: y["part"] == k), lambda y: y["line"]), "")
    pieces: list[Column] = [F.lit(head)]
    for k in range(len(parts)):
        pieces += [F.lit(between.get(k, "")), F.coalesce(pick(k), F.lit(""))]
    return paths.join(apart(grouped), "path", "left").select("path", F.concat(*pieces, F.lit(tail)).alias("document"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _attributes(*pairs: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *pairs), F.lit("]"))


def dot(g: Graph, reached: DataFrame, o: Options = Options()) -> DataFrame:
    n = _nodes(g, reached, o)
    label = F.col("name")
    if o.parameters:
        label = F.concat(label, F.lit("("), F.array_join(F.slice("parameters", 1, 3), ", "), F.when(F.size("parameters") > 3, "...").otherwise(""), F.lit(")"))
    node = _attributes(
        F.when(F.col("node_type") == "method", "shape=ellipse").otherwise("shape=box"), F.when(F.col("is_reachable"), "color=blue").otherwise("color=gray"),
        F.when(F.col("is_entry_point"), 'style="bold,filled", fillcolor=lightgreen'), F.when(F.col("complexity") > 10, "penwidth=3"), F.concat(F.lit("label="), _quoted(label)),
    )
    edge_text = F.concat_ws(
        ", ", F.when(F.col("call_type") == "recursive", "color=red, style=bold").when(F.col("call_type") == "indirect", "style=dashed"), F.when(F.col("confidence") < 0.7, "color=orange"),
        F.when(F.col("is_conditional"), "style=dotted"), F.concat(F.lit('label="'), F.col("line"), F.lit('"')) if o.line_numbers else F.lit(None).cast("string"),
    )
    edge = F.when(edge_text == "", "").otherwise(F.concat(F.lit("["), edge_text, F.lit("]")))
    indent = F.lit("    ")
    parts = [
        _lines(n, 0, F.concat(indent, _quoted(F.col("qualified_name")), F.lit(" "), node, F.lit(";\n"))),
        _lines(_outside(g, o).withColumn("ord", F.lit(0)), 1, F.concat(indent, _quoted(F.col("callee")), F.lit(" [shape=ellipse, style=dashed, color=gray];\n"))),
        _lines(_edges(g, n, o.include_external), 2, F.concat(indent, _quoted(F.col("caller")), F.lit(" -> "), _quoted(F.col("callee")), F.lit(" "), edge, F.lit(";\n"))),
    ]
    tail = "}\n"
    if o.clustering:
        box = n.groupBy("path").agg(F.count("*").alias("c"), F.array_sort(F.collect_list(_quoted(F.col("qualified_name")))).alias("q")).filter("c > 1").withColumn("ord", F.lit(0))
        stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
        parts.append(_lines(box, 3, F.concat(F.lit("    subgraph cluster_0 {\n        style=rounded; color=lightgray; label="), _quoted(stem), F.lit(";\n        "), F.array_join("q", "; "), F.lit(";\n    }\n"))))
    head = "digraph CallGraph {\n    node [style=rounded, shape=box];\n    edge [arrowhead=open];\n    " + LAYOUTS[o.layout] + "\n"
    return _together(g.scopes.select("path"), parts, head, {}, tail)


def _json_nodes(n: DataFrame, o: Options) -> Column:
    fields = [F.col("qualified_name").alias("id"), "name", F.col("node_type").alias("type"), F.col("path").alias("file"), F.col("start_line").alias("line"), "complexity", "is_reachable", "is_entry_point"]
    return F.struct(*fields, *[c for c, on in (("parameters", o.parameters), ("decorators", o.decorators), ("docstring", o.docstring)) if on])


def graph_json(g: Graph, reached: DataFrame, o: Options = Options()) -> DataFrame:
    n = _nodes(g, reached, o)
    nodes = n.select("path", "is_reachable", F.col("ord").cast("long").alias("ord"), F.to_json(_json_nodes(n, o)).alias("d"))
    out = F.struct(F.col("callee").alias("id"), F.substring_index("callee", ".", -1).alias("name"), F.lit("external").alias("type"), F.col("calls").alias("call_count"), F.lit(False).alias("is_reachable"), F.lit(False).alias("is_entry_point"))
    nodes = nodes.unionByName(_outside(g, o).select("path", F.lit(False).alias("is_reachable"), F.lit(1 << 40).alias("ord"), F.to_json(out).alias("d")))
    fields = [F.col("caller").alias("source"), F.col("callee").alias("target"), "call_type", "line", "confidence", "is_conditional"]
    edges = _edges(g, n, o.include_external).select("path", F.col("ord").cast("long").alias("ord"), F.to_json(F.struct(*fields, *(["call_expression"] if o.call_expression else []))).alias("d"))
    together = lambda df, name, *more: df.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "d")))["d"].alias(name), *more)
    entries = g.entry_points.groupBy("path").agg(F.count("*").alias("entries"))
    rows = g.scopes.select("path").join(apart(together(nodes, "n", F.count_if("is_reachable").alias("reached"))), "path", "left").join(apart(together(edges, "e")), "path", "left").join(apart(entries), "path", "left")
    listed = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c, ",\n"), F.lit("")), F.lit("]"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    stats = F.to_json(F.struct(zero(F.size("n")).alias("total_nodes"), zero(F.size("e")).alias("total_edges"), zero(F.col("entries")).alias("entry_points"), zero(F.col("reached")).alias("reachable_functions")))
    return rows.select("path", F.concat(F.lit('{"metadata": '), F.to_json(F.struct(F.lit("codeloom").alias("tool"), F.col("path").alias("file_path"))), F.lit(', "statistics": '), stats, F.lit(', "nodes": '), listed("n"), F.lit(', "edges": '), listed("e"), F.lit("}")).alias("document"))


def graphml(g: Graph, reached: DataFrame, o: Options = Options()) -> DataFrame:
    n = _nodes(g, reached, o)
    data = lambda **kv: F.concat(*[x for k, v in kv.items() for x in (F.lit(f'<data key="{k}">'), v.cast("string"), F.lit("</data>"))])
    yes = lambda c: F.when(F.col(c), "True").otherwise("False")
    node = F.concat(F.lit('<node id="'), _xml(F.col("qualified_name")), F.lit('">'), data(name=_xml(F.col("name")), type=F.col("node_type"), complexity=F.col("complexity"), reachable=yes("is_reachable"), entry_point=yes("is_entry_point")), F.lit("</node>\n"))
    e = _edges(g, n, False)
    from pyspark.sql import Window

    e = e.withColumn("i", F.row_number().over(Window.partitionBy("path").orderBy("ord")) - 1)
    edge = F.concat(F.lit('<edge id="e'), F.col("i"), F.lit('" source="'), _xml(F.col("caller")), F.lit('" target="'), _xml(F.col("callee")), F.lit('">'), data(call_type=F.col("call_type"), confidence=F.col("confidence"), conditional=yes("is_conditional")), F.lit("</edge>\n"))
    keys = [("node", k, t) for k, t in (("name", "string"), ("type", "string"), ("complexity", "int"), ("reachable", "boolean"), ("entry_point", "boolean"))]
    keys += [("edge", k, t) for k, t in (("call_type", "string"), ("confidence", "double"), ("conditional", "boolean"))]
    head = XML + "\n" + f'<graphml xmlns="{SPACE}" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="{SPACE} {SPACE}/1.0/graphml.xsd">\n'
    head += "".join(f'<key for="{w}" id="{k}" attr.type="{t}" attr.name="{k}"/>\n' for w, k, t in keys) + '<graph edgedefault="directed" id="CallGraph">\n'
    return _together(g.scopes.select("path"), [_lines(n, 0, node), _lines(e, 1, edge)], head, {}, "</graph>\n</graphml>\n")


def cytoscape(g: Graph, reached: DataFrame, o: Options = Options()) -> DataFrame:
    n = _nodes(g, reached, o)
    node = F.struct(F.lit("nodes").alias("group"), F.struct(F.col("qualified_name").alias("id"), "name", F.col("node_type").alias("type"), "complexity", F.col("is_reachable").alias("reachable"), F.col("is_entry_point").alias("entry_point")).alias("data"))
    edge = F.struct(F.lit("edges").alias("group"), F.struct(F.concat("caller", F.lit("-"), "callee").alias("id"), F.col("caller").alias("source"), F.col("callee").alias("target"), "call_type", "confidence", F.col("is_conditional").alias("conditional")).alias("data"))
    rows = _lines(n, 0, F.to_json(node)).unionByName(_lines(_edges(g, n, False), 1, F.to_json(edge)))
    grouped = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "line")))["line"].alias("x"))
    tail = '], "layout": ' + json.dumps({"directed": True, "name": "dagre", "spacingFactor": 1.5}) + ', "style": ' + json.dumps(STYLE) + "}"
    metadata = F.to_json(F.struct(F.lit("codeloom").alias("tool"), F.col("path").alias("file_path")))
    return g.scopes.select("path").join(apart(grouped), "path", "left").select("path", F.concat(F.lit('{"metadata": '), metadata, F.lit(', "elements": ['), F.coalesce(F.array_join("x", ",\n"), F.lit("")), F.lit(tail)).alias("document"))
