"""Filter graphs: orders feeding filters feeding tables, as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import publish
from .layers import attr_filter


def compile_graph(graph: str | dict, source: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """The DataFrame that reaches each table of an exported filter graph, by table name.

    ``source`` gives the features of an order. Several edges into a node are a
    union. A filter without a field lets all rows pass.
    """
    spec = json.loads(graph) if isinstance(graph, str) else graph
    nodes = spec["drawflow"]["Home"]["data"]

    def inputs(node_id: str) -> list[str]:
        ports = nodes[node_id].get("inputs") or {}
        return [str(edge["node"]) for port in ports.values() for edge in port["connections"]]

    def rows(node_id: str, above: tuple[str, ...] = ()) -> DataFrame:
        if node_id in above:
            raise ValueError("the graph has a cycle")
        node = nodes[node_id]
        if node["name"] == "OrderNode":
            return source(node["data"]["orderId"])
        feeding = [rows(other, (*above, node_id)) for other in inputs(node_id)]
        if not feeding:
            raise ValueError(f"node {node_id} has no input")
        df = feeding[0]
        for other in feeding[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
        rule = node["data"]
        if node["name"] == "FilterNode" and rule.get("field"):
            df = attr_filter(df, rule["field"], rule["operator"], rule["value"])
        return df

    return {
        node["data"].get("connectionName") or node_id: rows(node_id)
        for node_id, node in nodes.items()
        if node["name"] == "DatabaseNode"
    }


def orders_in(layer: DataFrame, order_column: str = "_source_order") -> Callable[[str], DataFrame]:
    """The source of a graph over one layer: the features that came with an order; an order without any gives none."""
    return lambda order_id: layer.filter(F.col(order_column) == order_id)


def run_graph(
    graph: str | dict, source: Callable[[str], DataFrame], database: str, source_srid: int, order_by: list[str], **options
) -> dict[str, DataFrame]:
    """Publish what reaches each table of a graph as a layer of that name; gives count, extent and bbox of each.

    ``order_by`` numbers the features; ``options`` are those of :func:`publish.publish_layer`.
    """
    outputs = compile_graph(graph, source)
    kept = {name: df.drop("fid", "srid", "cell", "_load", "xmin", "ymin", "xmax", "ymax", "_source_order", "_loaded_at") for name, df in outputs.items()}
    return {name: publish.publish_layer(df, name, database, source_srid, order_by, **options) for name, df in kept.items()}
