"""Cycles and components of imports against brute force."""

import random

from codecorpus.operators import graph


def components_of(links):
    """Sets of nodes that reach each other, by walking from every node."""
    nodes = {n for link in links for n in link}

    def reach(start):
        seen, todo = set(), [start]
        while todo:
            for s, t in links:
                if s == todo[-1] and t not in seen and s != t:
                    seen.add(t)
                    todo.insert(0, t)
            todo.pop()
        return seen

    reached = {n: reach(n) for n in nodes}
    same = {n: frozenset(m for m in reached[n] if n in reached[m]) for n in nodes}
    return {group for group in same.values() if len(group) > 1}


def found_components(spark, repos):
    rows = [(repo, s, t) for repo, links in repos.items() for s, t in links]
    edges = spark.createDataFrame(rows, "repo string, source string, target string")
    groups = {}
    for r in graph.import_components(edges).collect():
        group = groups.setdefault((r.repo, r.component), [set(), r.nodes])
        group[0].add(r.path)
    assert all(len(paths) == n and min(paths) == key[1] for key, (paths, n) in groups.items())
    return {(repo, frozenset(paths)) for (repo, _), (paths, _) in groups.items()}


def test_components_against_brute_force(spark):
    rng = random.Random(1)
    repos = {
        f"r{k}": [(f"n{rng.randrange(12):02}", f"n{rng.randrange(12):02}") for _ in range(18)]
        for k in range(6)
    }
    repos["chain"] = [("a", "b"), ("b", "c"), ("c", "c")]
    repos["ring"] = [(f"x{k:02}", f"x{(k + 1) % 15:02}") for k in range(15)]
    repos["two"] = [("a", "z"), ("z", "a"), ("z", "m"), ("m", "b"), ("b", "m"), ("q", "a")]
    expected = {(repo, group) for repo, links in repos.items() for group in components_of(links)}
    assert found_components(spark, repos) == expected
    assert ("ring", frozenset(f"x{k:02}" for k in range(15))) in expected


def layered(layers, width):
    """Layers joined completely and closed by one way back: no cycle is shorter than the layers."""
    links = [
        (f"l{a:02}_{i}", f"l{a + 1:02}_{j}")
        for a in range(layers - 1)
        for i in range(width)
        for j in range(width)
    ]
    return [*links, (f"l{layers - 1:02}_0", "l00_0")]


def test_graph_without_short_cycles_opens_no_path(spark, monkeypatch):
    rows = [("r", s, t) for s, t in layered(10, 4)]
    edges = spark.createDataFrame(rows, "repo string, source string, target string")
    sizes = []
    kept = graph.stored

    def counting(df):
        result = kept(df)
        if "nodes" in result.columns and "distance" in result.columns:
            sizes.append(result.count())
        return result

    monkeypatch.setattr(graph, "stored", counting)
    assert graph.circular_deps(edges).collect() == []
    assert sizes and max(sizes) == 0
    # The component is reported although none of its cycles is listed.  Nodes beside the way back
    # in the first and last layer lie on no cycle.
    assert {r.nodes for r in graph.import_components(edges).collect()} == {34}


def test_cycles_up_to_the_asked_length(spark):
    rows = [("r", s, t) for s, t in layered(5, 2)]
    edges = spark.createDataFrame(rows, "repo string, source string, target string")
    got = graph.circular_deps(edges, max_nodes=5, k=None).collect()
    assert len(got) == 2**3 and {r.nodes for r in got} == {5}
    assert graph.circular_deps(edges, max_nodes=4).collect() == []


def test_no_edges(spark):
    edges = spark.createDataFrame([], "repo string, source string, target string")
    assert graph.import_components(edges).collect() == []
    assert graph.circular_deps(edges).collect() == []


def test_many_edges_are_joined_by_shuffles(spark, monkeypatch):
    """Keys shrink when stored; a broadcast chosen by stored size would send them to the driver."""
    imports = spark.createDataFrame(
        [("a", "x.py", 0, "y", ["f"], False)],
        "repo string, path string, pos int, module string, names array<string>, is_external boolean",
    )
    files = spark.createDataFrame([("a", "y.py")], "repo string, path string")
    edges = graph.resolve_imports(imports, files)
    assert [(r.source, r.target) for r in edges.collect()] == [("x.py", "y.py")]
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "EDGES_TO_BROADCAST", 1)
    few = spark.createDataFrame([("a", "x"), ("a", "y")], "repo string, node string")
    links = spark.createDataFrame([("a", "x", "y"), ("a", "y", "x")], "repo string, source string, target string")
    by = graph._joinable(links)
    joined = links.join(by(few.withColumnRenamed("node", "source")), ["repo", "source"])
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert [(r.nodes, r.cycle) for r in graph.circular_deps(links).collect()] == [(2, ["x", "y", "x"])]
