"""Python source made from rows of tables, so that whole tables can be analysed as code.

From ``events`` comes a file for each user: imports, one function, and a
statement for each event in order. Everything is built by expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import table

HEADER = "import os\nimport hashlib\nimport shlex\nimport subprocess\nfrom html import escape as esc\n\ndef handle(b, c):\n"
#: Lines before the first statement.
HEADER_LINES = 7
PLAIN = {"error": "x = input()", "purchase": "os.system(x)", "signup": "hashlib.md5(b)", "view": "subprocess.run(c, shell=True)", "click": "y = 1"}
CLEANING = PLAIN | {"signup": "z = shlex.quote(x)"}
CALLING = {"error": "error()", "purchase": "purchase()", "signup": "signup()", "view": "view()", "click": "click()"}


def statement(of: dict[str, str]):  # noqa: ANN201
    out = F.lit("pass")
    for kind, code in of.items():
        out = F.when(F.col("event_type") == kind, code).otherwise(out)
    return out


ROWS_A_TASK = 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df shuffled by key into a number of partitions that grows with its rows: parsing costs far more than bytes tell, so they must not be joined to a few. The grouping that follows needs no other shuffle."""
    n = df.count()  # of a table's file, the number its footer holds
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(2 * cores, n // 50), -(-n // ROWS_A_TASK)), key)


def event_files(spark: SparkSession, sf_dir: str, of: dict[str, str] = PLAIN) -> DataFrame:
    """files(path, code): path is user_id."""
    e = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("user_id", "ts", "event_id", F.concat(F.lit("    "), statement(of)).alias("line"))
    lines = spread(e, "user_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "line"))).alias("x"))
    return lines.select(F.col("user_id").cast("string").alias("path"), F.concat(F.lit(HEADER), F.array_join("x.line", "\n"), F.lit("\n")).alias("code"))


def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, code) with a function for each kind of event of a user, which calls the kinds that ever come next; path is user_id."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spread(table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("user_id", "ts", "event_id", "event_type"), "user_id").withColumn("next", F.lead("event_type").over(w))
    f = e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_set("next")).alias("nexts"))
    body = F.when(F.size("nexts") == 0, F.array(F.lit("    pass"))).otherwise(F.transform("nexts", lambda n: F.concat(F.lit("    "), n, F.lit("()"))))
    f = f.select("user_id", "event_type", F.concat(F.lit("def "), F.col("event_type"), F.lit("():\n"), F.array_join(body, "\n"), F.lit("\n")).alias("d"))
    g = f.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "d"))).alias("x"))
    return g.select(F.col("user_id").cast("string").alias("path"), F.concat(F.lit("import os\n"), F.array_join("x.d", "\n")).alias("code"))


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of nations that supply nations: an edge for each line item, from its supplier's nation to its customer's."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    a = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("caller"))
    b = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("callee"))
    e = li.join(orders, li["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    e = e.join(a, "s_nationkey").join(b, "c_nationkey")
    edges = e.select(F.lit("trade").alias("path"), "caller", "callee", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    symbols = nation.select(F.lit("trade").alias("path"), F.col("n_name").alias("qualified_name"), F.col("n_nationkey").alias("ord"))
    return symbols, edges
