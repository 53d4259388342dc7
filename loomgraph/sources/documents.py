"""Graph documents: JSON out and in, DOT out, validation, and merging a document into a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.compound import MAX_DEPTH, ancestors

NODE = "struct<kind:string,id:bigint,label:string,parent:bigint,collapsed:boolean>"
EDGE = "struct<kind:string,src:bigint,dst:bigint,weight:double>"


def to_json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): one JSON object for each node and each edge, so a document of any size is written and read in parallel."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "label", "parent", "collapsed")).alias("line"))
    e = edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "src", "dst", "weight")).alias("line"))
    return n.union(e)


def from_json_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of such lines; a malformed line raises an error when it is read."""
    strict = {"mode": "FAILFAST"}
    kind = F.get_json_object("line", "$.kind")
    n = lines.where(kind == "node").select(F.from_json("line", NODE, strict).alias("r")).select("r.*").drop("kind")
    e = lines.where(kind == "edge").select(F.from_json("line", EDGE, strict).alias("r")).select("r.*").drop("kind")
    return n.withColumn("collapsed", F.coalesce("collapsed", F.lit(False))), e.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def quoted(text) -> F.Column:
    """A name in double quotes, with backslashes and quotes escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def to_dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the statements of a DOT digraph; part 0 opens, 3 closes, order within a part does not matter."""
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "digraph {"), (3, "}")], "part int, line string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  n"), F.col("id").cast("string"), F.lit(" [label="), quoted(F.col("label")), F.lit("];")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  n"), F.col("src").cast("string"), F.lit(" -> n"), F.col("dst").cast("string"), F.lit(' [weight="'), F.col("weight").cast("string"), F.lit('"];')).alias("line"))
    return ends.unionByName(n).unionByName(e)


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, id): repeated ids (1), edges from or to no node (2), unknown parents (3), parents in a circle or too deep (4), weights that are no finite number (5)."""
    ids = nodes.select("id")
    repeated = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(1).alias("check"), "id")
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(ids, "id", "left_anti").select(F.lit(2).alias("check"), "id")
    orphans = nodes.where("parent IS NOT NULL").select("id", F.col("parent").alias("p")).join(ids.withColumnRenamed("id", "p"), "p", "left_anti").select(F.lit(3).alias("check"), "id")
    deep = ancestors(nodes, MAX_DEPTH + 1).where((F.col("id") == F.col("ancestor")) | (F.col("depth") > MAX_DEPTH)).select(F.lit(4).alias("check"), "id").distinct()
    weights = edges.where("weight IS NULL OR isnan(weight) OR abs(weight) = double('infinity')").select(F.lit(5).alias("check"), F.col("src").alias("id")).distinct()
    return repeated.union(ends).union(orphans).union(deep).union(weights)


def merge(nodes: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """(id, label, parent, collapsed, change): added, updated (every node of the document that was there), and kept or, when replacing, removed."""
    a, b = nodes.select("id", "label", "parent", "collapsed"), new.select("id", *(F.col(c).alias(f"new_{c}") for c in ("label", "parent", "collapsed")), F.lit(True).alias("here"))
    old = a.withColumn("there", F.lit(True))
    rows = old.join(b, "id", "full_outer")
    change = F.when(F.col("there").isNull(), "added").when(F.col("here"), "updated").otherwise("removed" if replace else "kept")
    pick = lambda c: F.when(F.col("here"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("id", pick("label"), pick("parent"), pick("collapsed"), change.alias("change"))


def grid_graph(spark: SparkSession, side: int) -> tuple[DataFrame, DataFrame]:
    """A lattice of side * side nodes, each linked to its right and lower neighbour."""
    nodes = spark.range(side * side).select("id")
    right = nodes.where(F.col("id") % side < side - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = nodes.where(F.col("id") < side * (side - 1)).select(F.col("id").alias("src"), (F.col("id") + side).alias("dst"))
    return nodes, right.union(down).withColumn("weight", F.lit(1.0))


def chain_graph(spark: SparkSession, n: int, span: int = 8) -> tuple[DataFrame, DataFrame]:
    """A chain of n nodes, with a cross link of `span` steps from every span-th node."""
    nodes = spark.range(n).select("id")
    steps = nodes.where(F.col("id") < n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    cross = nodes.where((F.col("id") % span == 0) & (F.col("id") + span < n)).select(F.col("id").alias("src"), (F.col("id") + span).alias("dst"))
    return nodes, steps.union(cross).withColumn("weight", F.lit(1.0))


#: A statement of a DOT graph: names or quoted strings with arrows between them, and attributes in brackets.
DOT_NAME = r'(?:"(?:[^"\\]|\\.)*"|[A-Za-z_0-9.]+)'
DOT_ATTRIBUTE = r'([A-Za-z_]+)\s*=\s*("(?:[^"\\]|\\.)*"|[^\s,;\]]+)'


def unquoted(name) -> F.Column:
    """A name without its quotes and escapes."""
    inner = F.regexp_replace(F.regexp_replace(name, r'^"|"$', ""), r"\\(.)", "$1")
    return F.when(name.startswith('"'), inner).otherwise(name)


def from_dot_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, label) and edges (src, dst, weight) of DOT text, one statement to a line.

    A chain a -> b -> c is an edge for each arrow. Ends that no statement declares are nodes as well; labels default to
    names and weights to 1. Opening and closing lines, comments and defaults for all nodes or edges are passed over.
    """
    text = F.trim(F.regexp_replace("line", r"//.*$|^\s*#.*$", ""))
    skipped = text.rlike(r"^(strict\s+)?(di)?graph\b|^(node|edge)\s*\[|^[{}]?$|^[A-Za-z_]+\s*=")
    rows = lines.select(text.alias("line")).where(~skipped)
    head = F.regexp_replace("line", r"\[[^\[]*\]\s*;?\s*$|;\s*$", "")
    found = F.regexp_extract_all("line", F.lit(DOT_ATTRIBUTE), F.lit(1)), F.regexp_extract_all("line", F.lit(DOT_ATTRIBUTE), F.lit(2))
    parsed = rows.select(F.transform(F.regexp_extract_all(head, F.lit(f"({DOT_NAME})"), F.lit(1)), unquoted).alias("names"), F.map_from_arrays(found[0], F.transform(found[1], unquoted)).alias("attrs"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("names") - 1), lambda k: F.struct(F.get("names", k - 1).alias("src"), F.get("names", k).alias("dst")))
    edges = parsed.where(F.size("names") > 1).select(F.explode(pairs).alias("p"), "attrs").select("p.src", "p.dst", F.coalesce(F.try_element_at("attrs", F.lit("weight")).cast("double"), F.lit(1.0)).alias("weight"))
    declared = parsed.where(F.size("names") == 1).select(F.get("names", 0).alias("name"), F.try_element_at("attrs", F.lit("label")).alias("label"))
    ends = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct().withColumn("label", F.lit(None).cast("string"))
    nodes = declared.union(ends).groupBy("name").agg(F.coalesce(F.max("label"), F.col("name")).alias("label"))
    return nodes, edges
