"""Store configuration: JSON with comments, checked. It is read on the driver; it is no data."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

COMMENT_OR_STRING = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)


def strip_comments(text: str) -> str:
    """JSON without // and /* */ comments; what looks like one inside a string stays."""
    return COMMENT_OR_STRING.sub(lambda m: m[0] if m[0].startswith('"') else " ", text)


@dataclass
class StoreConfig:
    pool_bytes: int = 512 << 20
    index_bytes: int = 1 << 20
    nodes: int = 2
    partitions: int = 8
    max_key_bytes: int = 256
    max_value_bytes: int = 4096
    strict: bool = False
    cache_model: str = "none"
    hit_rate: int = 0
    costs: dict[str, int] = field(default_factory=dict)

    def validate(self) -> "StoreConfig":
        """Raises ValueError for what cannot be."""
        for name in ("pool_bytes", "index_bytes", "nodes", "partitions", "max_key_bytes", "max_value_bytes"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")
        if self.index_bytes > self.pool_bytes:
            raise ValueError("the index does not fit the pool")
        if self.partitions < self.nodes:
            raise ValueError("every node needs a partition")
        if self.cache_model not in ("none", "fixed_hit_rate", "per_thread_lru"):
            raise ValueError(f"no cache model {self.cache_model!r}")
        if not 0 <= self.hit_rate <= 10_000:
            raise ValueError("hit_rate is from 0 to 10000")
        if any(v < 0 for v in self.costs.values()):
            raise ValueError("costs cannot be negative")
        return self


def parse(text: str) -> StoreConfig:
    given = json.loads(strip_comments(text))
    unknown = set(given) - {f.name for f in fields(StoreConfig)}
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    return StoreConfig(**given).validate()


def load(spark: SparkSession, path: str) -> StoreConfig:
    """Reads the file through Spark, so any path Spark knows will do."""
    return parse(spark.read.text(path, wholetext=True).first()["value"])
