"""Source registry and build driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from pitspark.sources.contracts import Contract, write_validated

Producer = Callable[[SparkSession], DataFrame]


@dataclass
class Registry:
    """Named producers of source tables with their contracts."""

    producers: dict[str, tuple[Contract, Producer]] = field(default_factory=dict)

    def source(self, name: str, contract: Contract):
        def wrap(fn: Producer) -> Producer:
            self.producers[name] = (contract, fn)
            return fn

        return wrap


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole table is there: the writer's commit marker counts, not the
    folder, which a broken write leaves half filled."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def build(
    spark: SparkSession, registry: Registry, root: str, names: Iterable[str] | None = None, *, refresh: bool = False
) -> Mapping[str, str]:
    """Write every source that is not there yet. Returns name -> built /
    skipped / failed: message; a failing source does not stop the others, and
    the caller sees which ones are missing."""
    state: dict[str, str] = {}
    for name in names or registry.producers:
        contract, fn = registry.producers[name]
        path = f"{root}/{name}"
        if not refresh and exists(spark, path):
            state[name] = "skipped"
            continue
        try:
            write_validated(fn(spark), contract, path, mode="overwrite" if refresh else "errorifexists")
            state[name] = "built"
        except (ValueError, PySparkException) as e:
            state[name] = f"failed: {str(e).splitlines()[0]}"
    return state
