"""Pipelines of named stages over pixel grids, checked for what they take and give.

A node's output is a lazy DataFrame, so a changed source reaches everything connected to it.
A pipeline is text: a JSON list of nodes and of edges.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilter.operators import filters

#: Kinds of values on an edge.
NULL, IMAGE_RGB, IMAGE_RGBA, UINT = "null", "image_rgb", "image_rgba", "uint"
IMAGES = (IMAGE_RGB, IMAGE_RGBA)


def kind_of(df: DataFrame | None) -> str:
    if df is None:
        return NULL
    if {"r", "g", "b"} <= set(df.columns):
        return IMAGE_RGBA if "a" in df.columns else IMAGE_RGB
    return UINT


@dataclass(frozen=True)
class Operator:
    """What a node of this name takes, what it gives for that, and how."""

    takes: tuple[str, ...]
    gives: Callable[[str], str]
    run: Callable[[DataFrame], DataFrame]


def _paeth(df: DataFrame) -> DataFrame:
    return filters.paeth_residual(df, filters.channels_of(df))


OPERATORS = {
    "dummy": Operator((NULL,), lambda k: NULL, lambda df: df),
    "paeth": Operator(IMAGES, lambda k: k, _paeth),
    "strip_alpha": Operator(IMAGES, lambda k: IMAGE_RGB, filters.strip_alpha),
    "lzp": Operator(IMAGES, lambda k: UINT, filters.lzp_size),
}


@dataclass
class Graph:
    """Nodes by number; each has at most one input."""

    sources: dict[str, DataFrame] = field(default_factory=dict)
    nodes: dict[int, tuple[str, str | None]] = field(default_factory=dict)
    edges: dict[int, int] = field(default_factory=dict)

    def add(self, name: str, source: str | None = None) -> int:
        if name != "source" and name not in OPERATORS:
            raise ValueError(f"no operator {name}")
        n = max(self.nodes, default=-1) + 1
        self.nodes[n] = (name, source)
        return n

    def kind(self, node: int) -> str:
        name, source = self.nodes[node]
        if name == "source":
            return kind_of(self.sources.get(source))
        given = self.kind(self.edges[node]) if node in self.edges else NULL
        return OPERATORS[name].gives(given) if given != NULL else NULL

    def connect(self, a: int, b: int) -> None:
        """a's output becomes b's input; an error if b does not take it, or if b leads to a."""
        name, _ = self.nodes[b]
        if name == "source" or self.kind(a) not in OPERATORS[name].takes:
            raise TypeError(f"{name} does not take {self.kind(a)}")
        at = a
        while at in self.edges:
            at = self.edges[at]
            if at == b:
                raise ValueError("the graph would have a cycle")
        if a == b:
            raise ValueError("the graph would have a cycle")
        self.edges[b] = a

    def remove(self, node: int) -> None:
        """Without the node; what it fed has no input."""
        del self.nodes[node]
        self.edges = {b: a for b, a in self.edges.items() if node not in (a, b)}

    def output(self, node: int) -> DataFrame | None:
        name, source = self.nodes[node]
        if name == "source":
            return self.sources.get(source)
        given = self.output(self.edges[node]) if node in self.edges else None
        return None if given is None else given.transform(OPERATORS[name].run)

    def save(self) -> str:
        return json.dumps({"nodes": [[n, *v] for n, v in self.nodes.items()], "edges": [[a, b] for b, a in self.edges.items()]})

    @classmethod
    def load(cls, text: str, sources: dict[str, DataFrame]) -> Graph:
        spec = json.loads(text)
        return cls(sources, {n: (name, source) for n, name, source in spec["nodes"]}, {b: a for a, b in spec["edges"]})


def blank(spark, width: int, height: int, channels: str = "rgba", fill: dict[str, int] | None = None) -> DataFrame:
    """A new image of one colour, black unless said otherwise."""
    fill = {**filters.OUTSIDE, **(fill or {})}
    d = spark.range(width * height).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    return d.select("*", *[F.lit(fill[c]).cast("long").alias(c) for c in channels])


def put(image: DataFrame, edits: DataFrame, channels: str = "rgba") -> DataFrame:
    """The image with the pixels of ``edits`` set; both need the same channels."""
    if missing := [c for c in channels if c not in image.columns or c not in edits.columns]:
        raise TypeError(f"channels {missing} are not in both")
    new = edits.select("image_id", "x", "y", *[F.col(c).alias(f"new_{c}") for c in channels])
    return image.join(new, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *[F.coalesce(f"new_{c}", c).alias(c) for c in channels])
