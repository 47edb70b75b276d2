"""Pipeline descriptions: kernels joined by queues, with checks, adjacency and a DOT drawing (inventory DM1, DM10, L1, L2, A13, K2)."""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Program:
    kernels: dict[str, bool] = field(default_factory=dict)  # name: parallel
    starts: set[str] = field(default_factory=set)
    queues: dict[str, tuple[str, str, bool]] = field(default_factory=dict)  # name: producer, consumer, feedback

    def kernel(self, name: str, parallel: bool = False, start: bool = False) -> Program:
        self.kernels[name] = parallel
        if start:
            self.starts.add(name)
        return self

    def queue(self, name: str, producer: str, consumer: str, feedback: bool = False) -> Program:
        self.queues[name] = producer, consumer, feedback
        return self

    def verify(self) -> None:
        """ValueError for queues with unknown ends, kernels without queues, or no start."""
        ends = {k for p, c, _ in self.queues.values() for k in (p, c)}
        for wrong, what in ((ends - self.kernels.keys(), "unknown kernels"), (self.kernels.keys() - ends, "kernels without a queue")):
            if wrong:
                raise ValueError(f"{what}: {', '.join(sorted(wrong))}")
        if not self.starts:
            raise ValueError("no start kernel")

    def start_list(self) -> list[str]:
        return sorted(self.starts)

    def edges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(q, *v) for q, v in self.queues.items()], "queue string, producer string, consumer string, is_feedback boolean")

    def dot(self) -> str:
        lines = ["digraph program {"]
        lines += [f'  "{k}" [shape={"box3d" if parallel else "box"}{", style=rounded" if k in self.starts else ""}];' for k, parallel in self.kernels.items()]
        lines += [f'  "{p}" -> "{c}" [label="{q}"{", style=dashed" if fb else ""}];' for q, (p, c, fb) in self.queues.items()]
        return "\n".join([*lines, "}"])


def adjacency(edges: DataFrame, feedback: bool = True) -> DataFrame:
    """kernel, successors, predecessors (sorted arrays, empty at the graph's ends): forward and backward adjacency (DM10)."""
    used = edges if feedback else edges.where(~F.col("is_feedback"))
    ends = used.select(F.col("producer").alias("kernel"), F.col("consumer").alias("to"), F.lit(None).cast("string").alias("back"))
    ends = ends.unionByName(used.select(F.col("consumer").alias("kernel"), F.lit(None).cast("string").alias("to"), F.col("producer").alias("back")))
    return ends.groupBy("kernel").agg(F.sort_array(F.collect_set("to")).alias("successors"), F.sort_array(F.collect_set("back")).alias("predecessors"))


def neighbours(edges: DataFrame, feedback: bool = True) -> DataFrame:
    """kernel, successors (sorted array)."""
    used = edges if feedback else edges.where(~F.col("is_feedback"))
    return used.groupBy(F.col("producer").alias("kernel")).agg(F.sort_array(F.collect_set("consumer")).alias("successors"))


def resolve(path: str):
    """The callable at "module:name"; FileNotFoundError for the module, AttributeError for the name."""
    module, _, name = path.partition(":")
    try:
        found = importlib.import_module(module)
    except ImportError as e:
        raise FileNotFoundError(module) from e
    return getattr(found, name)
