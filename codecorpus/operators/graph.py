"""Dependencies between files and on packages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.rows import unnest
from codecorpus.operators.rank import top_k
from codecorpus.session import stored

MAX_CYCLE_NODES = 9
CYCLES_PER_REPO = 10
#: Edges up to which Spark may choose to broadcast tables of edges and nodes.
EDGES_TO_BROADCAST = 50_000


def _shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` to be joined by a shuffle, whatever their stored size.

    Keys shrink to a small part when stored, so Spark takes large tables for small ones, and every
    broadcast passes through the driver; a search in rounds has dozens of them.
    """
    return rows.hint("merge")


def _joinable(edges: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How tables of a graph are joined: left to Spark, or by a shuffle if it has many edges."""
    many = edges.limit(EDGES_TO_BROADCAST + 1).count() > EDGES_TO_BROADCAST
    return _shuffled if many else lambda rows: rows


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Internal imports → edges (repo, source, pos, target, names).

    Every import yields its candidate paths in order of preference; one hash join on (repo, path)
    keeps those that exist, and the first of them per import wins.
    """
    module = F.col("module")
    dotted = F.replace(module, F.lit("."), F.lit("/"))
    bare = F.regexp_replace(module, r"^[./]+", "")
    candidates = F.array(
        F.concat(dotted, F.lit(".py")),
        F.concat(dotted, F.lit("/__init__.py")),
        *[
            F.concat(bare, F.lit(end))
            for end in (".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")
        ],
        F.concat(F.element_at(F.split(module, "/"), -1), F.lit(".go")),
    )
    tried = imports.where(~F.col("is_external") & (module != ""))
    tried = unnest(
        tried, ["repo", F.col("path").alias("source"), "pos", "names"], candidates, "target", "choice"
    )
    known = files.select("repo", F.col("path").alias("target"))
    return (
        tried.join(_shuffled(known), ["repo", "target"])
        .groupBy("repo", "source", "pos")
        .agg(
            F.min_by("target", "choice").alias("target"),
            F.any_value("names").alias("names"),
        )
    )


def import_fan_in(edges: DataFrame, k: int = 10) -> DataFrame:
    """Most imported files."""
    counted = edges.groupBy("repo", "target").agg(F.count(F.lit(1)).alias("importers"))
    return top_k(counted, k, F.col("importers").desc(), "target")


def import_packages(imports: DataFrame) -> DataFrame:
    """Top-level names of external imports: repo, package."""
    top = F.split_part(F.split_part("module", F.lit("/"), F.lit(1)), F.lit("."), F.lit(1))
    return imports.where("is_external").select("repo", top.alias("package")).distinct()


def union_dependencies(imports: DataFrame, manifest_deps: DataFrame) -> DataFrame:
    """Distinct external packages per repository, from imports and from manifests."""
    declared = manifest_deps.select("repo", "package")
    return import_packages(imports).unionByName(declared).distinct()


def package_usage(dependencies: DataFrame) -> DataFrame:
    """Number of repositories per package."""
    return dependencies.groupBy("package").agg(F.count(F.lit(1)).alias("repos"))


def _core(edges: DataFrame, by: Callable) -> DataFrame:
    """Edges without nodes that nothing enters or leaves; such nodes lie on no cycle.

    Rounds go on until no edge is removed, so an acyclic graph ends without any edge and opens no
    path.  Each round is stored.
    """
    before, left = -1, edges.count()
    while left and left != before:
        sources = edges.select("repo", F.col("source").alias("target")).distinct()
        edges = edges.join(by(sources), ["repo", "target"], "left_semi")
        targets = edges.select("repo", F.col("target").alias("source")).distinct()
        edges = stored(edges.join(by(targets), ["repo", "source"], "left_semi"))
        before, left = left, edges.count()
    return edges


def _reached(labels: DataFrame, edges: DataFrame, by: Callable) -> DataFrame:
    """Per node the largest label of the nodes it can be reached from, its own included.

    Labels move along the edges, one step per stored round, until none changes.
    """
    while True:
        pushed = edges.join(by(labels.withColumnRenamed("node", "source")), ["repo", "source"]).select(
            "repo", F.col("target").alias("node"), "label", F.lit(None).cast("string").alias("own")
        )
        rows = labels.select("repo", "node", "label", F.col("label").alias("own"))
        labels = stored(
            rows.unionByName(pushed)
            .groupBy("repo", "node")
            .agg(F.max("label").alias("label"), (F.max("label") > F.max("own")).alias("moved"))
        )
        if labels.where("moved").isEmpty():
            return labels.drop("moved")
        labels = labels.drop("moved")


def _reaching(roots: DataFrame, edges: DataFrame, by: Callable) -> DataFrame:
    """Nodes from which the root of their label can be reached; edges join nodes of one label.

    Steps go backwards from the nodes found last.
    """
    found = last = stored(roots)
    while True:
        step = edges.join(by(last.withColumnRenamed("node", "target")), ["repo", "target", "label"])
        step = step.select("repo", F.col("source").alias("node"), "label").distinct()
        last = stored(step.join(by(found), ["repo", "node", "label"], "left_anti"))
        if last.isEmpty():
            return found
        found = stored(found.unionByName(last))


def import_components(edges: DataFrame) -> DataFrame:
    """Files that import each other in a circle, of any length: (repo, component, path, nodes).

    These are the strongly connected components of at least two files; ``component`` is the
    smallest path of one.  Nodes that nothing enters or leaves go first.  Then every node takes the
    largest path it can be reached from; nodes with the same label that also reach the node of that
    name are its component.  What is left of each label goes round again.
    """
    spark = edges.sparkSession
    found = spark.createDataFrame([], "repo string, node string, label string")
    left = edges.where("source <> target").select("repo", "source", "target").distinct()
    left = stored(left)
    by = _joinable(left)
    left = _core(left, by)
    while not left.isEmpty():
        ends = F.explode(F.array("source", "target")).alias("node")
        nodes = left.select("repo", ends).distinct()
        labels = _reached(stored(nodes.withColumn("label", F.col("node"))), left, by)
        of_source = labels.select("repo", F.col("node").alias("source"), "label")
        of_target = labels.select("repo", F.col("node").alias("target"), "label")
        inner = left.join(by(of_source), ["repo", "source"])
        inner = inner.join(by(of_target), ["repo", "target", "label"])
        inner = stored(inner)
        members = _reaching(labels.where("node = label"), inner, by)
        found = found.unionByName(members)
        taken = members.select("repo", "node")
        from_taken = by(taken.withColumnRenamed("node", "source"))
        to_taken = by(taken.withColumnRenamed("node", "target"))
        rest = inner.join(from_taken, ["repo", "source"], "left_anti")
        rest = rest.join(to_taken, ["repo", "target"], "left_anti")
        left = _core(stored(rest.drop("label")), by)
    sizes = found.groupBy("repo", "label").agg(
        F.count(F.lit(1)).alias("nodes"), F.min("node").alias("component")
    )
    return (
        found.join(by(sizes.where("nodes > 1")), ["repo", "label"])
        .select("repo", "component", F.col("node").alias("path"), "nodes")
    )


def _distances(steps: DataFrame, most: int, by: Callable) -> DataFrame:
    """(repo, start, node, distance): fewest edges from a node back to a smaller one, up to ``most``.

    Only paths over nodes that are not smaller than the start count.  Breadth first, backwards, one
    stored round per distance; the table holds each pair at most once.
    """
    back = steps.where(F.col("source") > F.col("target"))
    found = last = stored(
        back.select("repo", F.col("target").alias("start"), F.col("source").alias("node"), F.lit(1).alias("distance"))
    )
    for distance in range(2, most + 1):
        step = last.select("repo", "start", F.col("node").alias("target")).join(by(steps), ["repo", "target"])
        step = step.where(F.col("source") > F.col("start"))
        step = step.select("repo", "start", F.col("source").alias("node")).distinct()
        last = stored(
            step.join(by(found), ["repo", "start", "node"], "left_anti").withColumn(
                "distance", F.lit(distance)
            )
        )
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def circular_deps(
    edges: DataFrame,
    max_nodes: int = MAX_CYCLE_NODES,
    k: int | None = CYCLES_PER_REPO,
    components: DataFrame | None = None,
) -> DataFrame:
    """The first ``k`` import cycles per repository (all if None): (repo, rank, nodes, cycle).

    All simple cycles with at most ``max_nodes`` files count, shorter ones first, then by path; a
    cycle starts and ends with its smallest path.  Cycles of any length show in
    ``import_components``; paths only use edges inside one component.

    Paths grow by one edge per round from their smallest node.  A path is only continued to a node
    whose distance back to the start still fits, so a graph without short cycles opens no path.  A
    repository that has ``k`` cycles after a round leaves the search: every cycle still to come is
    longer, so its first ``k`` are settled.
    """
    graph = stored(edges.select("repo", "source", "target").distinct())
    by = _joinable(graph)
    loop = F.col("source") == F.col("target")
    found = graph.where(loop).select("repo", F.array("source", "target").alias("cycle"))
    components = stored(import_components(graph) if components is None else components)
    of_source = components.select("repo", F.col("path").alias("source"), "component")
    of_target = components.select("repo", F.col("path").alias("target"), "component")
    steps = stored(
        graph.where(~loop)
        .join(by(of_source), ["repo", "source"])
        .join(by(of_target), ["repo", "target", "component"])
        .select("repo", "source", "target")
    )
    back = stored(_distances(steps, max_nodes - 1, by))
    ahead = back.select("repo", "start", F.col("node").alias("target"), "distance")
    open_paths = (
        steps.where(F.col("target") > F.col("source"))
        .withColumn("start", F.col("source"))
        .join(by(ahead.where(F.col("distance") + 1 <= max_nodes)), ["repo", "start", "target"])
        .select("repo", "start", F.array("source", "target").alias("nodes"), "distance")
    )
    for length in range(2, max_nodes + 1):
        # Open paths hold `length` nodes; those one edge from their start close now.
        open_paths = stored(open_paths)
        closed = open_paths.where("distance = 1")
        found = found.unionByName(
            closed.select("repo", F.array_append("nodes", F.col("start")).alias("cycle"))
        )
        if length == max_nodes:
            break
        going = open_paths
        if k is not None:
            settled = found.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
            going = going.join(settled.select("repo"), "repo", "left_anti")
        open_paths = (
            going.select("repo", "start", "nodes", F.element_at("nodes", -1).alias("source"))
            .join(by(steps), ["repo", "source"])
            .where(~F.array_contains(F.col("nodes"), F.col("target")))
            .join(
                by(ahead.where(F.col("distance") + length <= max_nodes)),
                ["repo", "start", "target"],
            )
            .select("repo", "start", F.array_append("nodes", F.col("target")).alias("nodes"), "distance")
        )
        if going.isEmpty():
            break
    nodes = (F.size("cycle") - 1).alias("nodes")
    ranked = top_k(found.select("repo", "cycle", nodes), k, F.col("nodes"), F.col("cycle"))
    return ranked.select("repo", "rank", "nodes", "cycle")
