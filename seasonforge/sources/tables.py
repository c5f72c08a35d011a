"""Reading and writing tables: a registry of datasets, drift-tolerant reads, caching, manifests, exports."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.quality import content_hash


@dataclass(frozen=True)
class Dataset:
    """One entry of the catalogue."""

    name: str
    required: bool = False
    seasonal: bool = True
    expected: tuple[str, ...] = ()
    earliest: int | None = None
    options: dict = field(default_factory=dict)

    def seasons(self, wanted: list[int]) -> list[int]:
        """Seasons of ``wanted`` that the dataset has."""
        return [s for s in wanted if self.earliest is None or s >= self.earliest]


class Catalogue:
    """Datasets by name, each with a loader; loaders can be added."""

    def __init__(self):
        self.entries: dict[str, tuple[Dataset, Callable[..., DataFrame]]] = {}

    def add(self, dataset: Dataset, loader: Callable[..., DataFrame]) -> None:
        self.entries[dataset.name] = (dataset, loader)

    def load(self, spark: SparkSession, name: str, seasons: list[int] | None = None, retries: int = 3, delay: float = 0.5) -> DataFrame | None:
        """The dataset, clamped to its seasons, with missing columns refused; None if optional and unavailable."""
        d, loader = self.entries[name]
        keep = d.seasons(seasons) if seasons is not None and d.seasonal else None
        if keep == []:
            return None
        for attempt in range(retries):
            try:
                out = loader(spark, **d.options)
                break
            except (OSError, ValueError):
                if attempt == retries - 1:
                    if d.required:
                        raise
                    return None
                time.sleep(delay * 2**attempt)
        if missing := [c for c in d.expected if c not in out.columns]:
            raise ValueError(f"{name} has no {', '.join(missing)}")
        return out.where(F.col("season").isin(keep)) if keep is not None and "season" in out.columns else out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; without a schema all columns are text."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r.option("inferSchema", False)).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document or array; what doesn't fit the schema is null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def write_table(rows: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = rows.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def as_documents(rows: DataFrame, keys: list[str], envelope: dict[str, str]) -> DataFrame:
    """One JSON text a row, under an envelope: ``key columns, json``."""
    body = F.struct(*[F.lit(v).alias(k) for k, v in envelope.items()], F.struct(*rows.columns).alias("data"))
    return rows.select(*keys, F.to_json(body).alias("json"))


def existing(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there."""
    return rows.select(*[c for c in wanted if c in rows.columns])


def first_available(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """New names from the first column that is there; a null text where none is."""
    pick = lambda options: next((F.col(c) for c in options if c in rows.columns), F.lit(None).cast("string"))
    return rows.select(*[pick(o).alias(n) for n, o in names.items()])


def with_missing(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in rows.columns})


def flattened(rows: DataFrame, sep: str = "_") -> DataFrame:
    """Nested columns as top-level ones, names joined."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return rows.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(sep.join(p)) for p in leaves(rows.schema, ())])


def coverage(rows: DataFrame, seasons: list[int]) -> DataFrame:
    """Rows, seasons present and missing, and a status."""
    have = F.sort_array(F.collect_set(F.col("season").cast("int")))
    d = rows.agg(F.count("*").alias("rows"), have.alias("present"))
    d = d.withColumn("missing", F.array_except(F.array(*[F.lit(s) for s in seasons]), "present"))
    return d.withColumn("status", F.when(F.col("rows") == 0, "unavailable").when(F.size("missing") > 0, "partial").otherwise("ok"))


def cache_key(name: str, most: int = 120) -> str:
    """File name for a cache entry; long ones end in a digest."""
    clean = re.sub(r"[^A-Za-z0-9._-]+", "-", name)
    return clean if len(clean) <= most else f"{clean[:100]}-{hashlib.sha256(clean.encode()).hexdigest()[:16]}"


def fresh(written: float, lifetime: float, now: float | None = None) -> bool:
    """Younger than its lifetime; a lifetime of 0 is never fresh."""
    return lifetime > 0 and (time.time() if now is None else now) - written < lifetime


def manifest(rows: DataFrame, name: str) -> str:
    """Name, schema, rows and content hash of a table, as JSON."""
    h = content_hash(rows).first()
    return json.dumps({"name": name, "schema": rows.schema.simpleString(), "rows": h["rows"], "xor": h["xor"], "sum": str(h["sum"])}, sort_keys=True)


class GeneratedPlayers(DataSource):
    """Deterministic example players: ``spark.read.format("example_players").option("players", 48).load()``."""

    @classmethod
    def name(cls) -> str:
        return "example_players"

    def schema(self) -> str:
        return "player_id string, name string, position string, points double"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PlayerReader(int(self.options.get("players", 48)))


class _PlayerReader(DataSourceReader):
    def __init__(self, players: int):
        self.players = players

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((a, min(a + 1000, self.players))) for a in range(0, self.players, 1000)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(*partition.value):
            unit = int(hashlib.sha256(f"player-{i}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
            yield f"example-{i:04d}", f"Player {i}", ("QB", "RB", "WR", "TE")[i % 4], round(300 * (1 - i / max(self.players, 1)) + 20 * unit, 2)
