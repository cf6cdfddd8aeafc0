"""Audit of an edge table as a directed graph: cycles, pruning, order, degrees.

Finding one cycle at a time is inherently sequential; each fold's graph, cut to max_edges when it was inferred, is one
group of a grouped function, and folds run side by side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.sources.staging import stage

MOST_CYCLES = 100


class Graph:
    """Rows of edges in order; parallel edges count as one until their last row goes."""

    def __init__(self, edges: list[tuple[int, int]]):
        self.out: dict[int, dict[int, int]] = {}
        self.nodes: dict[int, None] = {}
        for a, b in edges:
            self.nodes.setdefault(a)
            self.nodes.setdefault(b)
            row = self.out.setdefault(a, {})
            row[b] = row.get(b, 0) + 1

    def remove(self, a: int, b: int) -> None:
        row = self.out[a]
        row[b] -= 1
        if not row[b]:
            del row[b]

    def cycle(self) -> list[tuple[int, int]]:
        """The first cycle of a depth-first walk over nodes and edges in order of first appearance, else nothing."""
        finished: set[int] = set()
        for start in self.nodes:
            if start in finished:
                continue
            path, place, ahead = [start], {start: 0}, [iter(list(self.out.get(start, ())))]
            while path:
                to = next(ahead[-1], None)
                if to is None:
                    finished.add(path[-1])
                    del place[path.pop()]
                    ahead.pop()
                elif to in place:
                    ring = [*path[place[to] :], to]
                    return list(zip(ring, ring[1:]))
                elif to not in finished:
                    place[to] = len(path)
                    path.append(to)
                    ahead.append(iter(list(self.out.get(to, ()))))
        return []

    def order(self) -> list[int]:
        """Nodes with every edge pointing forward; an error on a cycle."""
        need = dict.fromkeys(self.nodes, 0)
        for row in self.out.values():
            for b in row:
                need[b] += 1
        ready, out = [n for n in self.nodes if not need[n]], []
        while ready:
            n = ready.pop(0)
            out.append(n)
            for b in self.out.get(n, ()):
                need[b] -= 1
                if not need[b]:
                    ready.append(b)
        if len(out) < len(self.nodes):
            raise ValueError("the graph has a cycle")
        return out


def representative_cycles(edges: list[tuple[int, int]], most: int = MOST_CYCLES) -> list[list[int]]:
    """Node lists of cycles found one after another, each broken at its first edge; greedy, so no graph invariant."""
    graph, found = Graph(edges), []
    while len(found) < most and (ring := graph.cycle()):
        found.append([a for a, _ in ring])
        a, b = ring[0]
        while b in graph.out[a]:
            graph.remove(a, b)
    return found


def pruned(edges: list[tuple[int, int]], weights: list[float]) -> list[int]:
    """Rows removed, in order, to leave no cycle: of each cycle found the edge of least weight, the first of equals."""
    graph, removed = Graph(edges), []
    rows: dict[tuple[int, int], list[int]] = {}
    for i, edge in enumerate(edges):
        rows.setdefault(edge, []).append(i)
    while ring := graph.cycle():
        at = min((i for edge in ring for i in rows[edge]), key=lambda i: (weights[i], i))
        rows[edges[at]].remove(at)
        graph.remove(*edges[at])
        removed.append(at)
    return removed


def _sorted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, int]], list[float]]:
    pdf = pdf.sort_values(["src_kc", "dst_kc"], kind="stable").reset_index(drop=True)
    return pdf, list(zip(pdf["src_kc"].tolist(), pdf["dst_kc"].tolist())), pdf["weight"].fillna(1.0).tolist()


def prune_log(edges: DataFrame) -> DataFrame:
    """Edges removed from each fold's graph: fold, src_kc, dst_kc, weight, step, reason."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, pairs, weights = _sorted(pdf)
        out = pdf.iloc[pruned(pairs, weights)][["fold", "src_kc", "dst_kc", "weight"]]
        return out.assign(step=range(len(out)), reason="cycle_prune_lowest_confidence")

    return edges.select("fold", "src_kc", "dst_kc", "weight").groupBy("fold").applyInPandas(run, "fold int, src_kc long, dst_kc long, weight double, step long, reason string")


def prune(edges: DataFrame) -> DataFrame:
    """The edges that pruning keeps."""
    return edges.join(prune_log(edges).select("fold", "src_kc", "dst_kc"), ["fold", "src_kc", "dst_kc"], "left_anti")


def audit(edges: DataFrame) -> DataFrame:
    """One row a fold: sizes, roots, leaves, representative cycles before and after pruning, and whether an order exists."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, pairs, weights = _sorted(pdf)
        gone = set(pruned(pairs, weights))
        left = [e for i, e in enumerate(pairs) if i not in gone]
        sources, targets = {a for a, _ in left}, {b for _, b in left}
        try:
            sound = bool(Graph(left).order() or not left)
        except ValueError:
            sound = False
        row = (pdf["fold"].iloc[0], len(sources | targets), len(pairs), len(gone), len(set(left)), len(sources - targets), len(targets - sources), len(representative_cycles(pairs)), len(representative_cycles(left)), sound)
        return pd.DataFrame([row], columns=["fold", "n_nodes", "n_edges_raw", "n_edges_pruned", "n_edges", "n_roots", "n_leaves", "n_cycles_before", "n_cycles_after", "topo_sort_passed"])

    longs = ", ".join(f"{c} long" for c in ("n_nodes", "n_edges_raw", "n_edges_pruned", "n_edges", "n_roots", "n_leaves", "n_cycles_before", "n_cycles_after"))
    return edges.select("fold", "src_kc", "dst_kc", "weight").groupBy("fold").applyInPandas(run, f"fold int, {longs}, topo_sort_passed boolean")


def layers(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kc_id, layer): a topological order of all keys' graphs at once; an edge's end has a higher layer than its start.

    Each round takes the nodes that no edge left points to, numbers them, and drops their edges; a graph as deep as n
    takes n rounds, whatever its width. An error where edges are left and no node is free, which is a cycle.
    """
    left = stage(edges.select(*keys, "src_kc", "dst_kc").distinct(), "edges-left")
    nodes = stage(left.select(*keys, F.explode(F.array("src_kc", "dst_kc")).alias("kc_id")).distinct(), "nodes-left")
    done, layer = None, 0
    while not nodes.isEmpty():
        free = nodes.join(left.select(*keys, F.col("dst_kc").alias("kc_id")).distinct(), [*keys, "kc_id"], "left_anti")
        free = stage(free.withColumn("layer", F.lit(layer)), "layer")
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done = free if done is None else done.union(free)
        nodes = stage(nodes.join(free, [*keys, "kc_id"], "left_anti"), "nodes-left")
        left = stage(left.join(free.select(*keys, F.col("kc_id").alias("src_kc")), [*keys, "src_kc"], "left_anti"), "edges-left")
        layer += 1
    return nodes.withColumn("layer", F.lit(0)) if done is None else done


def degrees(edges: DataFrame) -> DataFrame:
    """fold, n_nodes, n_edges, n_roots (nothing points there), n_leaves (points nowhere)."""
    ends = edges.select("fold", F.col("src_kc").alias("kc"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("fold", F.col("dst_kc"), F.lit(0), F.lit(1)))
    nodes = ends.groupBy("fold", "kc").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    n = edges.groupBy("fold").agg(F.count_distinct("src_kc", "dst_kc").alias("n_edges"))
    return nodes.groupBy("fold").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("i") == 0).alias("n_roots"), F.count_if(F.col("o") == 0).alias("n_leaves")).join(n, "fold").select("fold", "n_nodes", "n_edges", "n_roots", "n_leaves")
