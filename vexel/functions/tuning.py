"""Closed-form estimates for approximate indexes: memory, build time and recommended parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


def _clamp(x, low, high):
    return max(low, min(high, x))


@dataclass(frozen=True)
class Graph:
    """Parameters of a layered neighbour graph."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50

    def memory_bytes(self, n: int, dim: int) -> int:
        return n * (2 * self.m * 4 + dim * 4 + 16)

    def for_recall(self, recall: float) -> Graph:
        return replace(self, ef_search=_clamp(int(recall * 200), 1, 500), ef_construction=_clamp(int(recall * 400), 10, 1000))

    def for_speed(self) -> Graph:
        return replace(self, ef_search=max(1, self.ef_search // 2), m=max(1, self.m // 2))


@dataclass(frozen=True)
class Inverted:
    """Parameters of an inverted file of clusters."""

    nlist: int = 100
    nprobe: int = 10

    def with_nlist(self, n: int) -> Inverted:
        return replace(self, nlist=_clamp(n, 1, 65_536))

    def with_nprobe(self, n: int) -> Inverted:
        return replace(self, nprobe=_clamp(n, 1, self.nlist))

    def for_recall(self, recall: float) -> Inverted:
        return replace(self, nprobe=_clamp(self.nlist * math.floor(10 * recall) // 10, 1, self.nlist))


@dataclass(frozen=True)
class Quantizer:
    """Parameters of product quantization."""

    m: int = 8
    nbits: int = 8

    def parameter_ratio(self) -> float:
        return 32 / self.nbits

    def index_ratio(self, dim: int) -> float:
        return dim * 4 / self.m


def build_seconds(algorithm: str, n: int, dim: int) -> float:
    """An estimate: linear work for all, and n log n for graphs."""
    base = n * dim / 1e6
    return base + (n * math.log2(max(n, 1)) / 1e7 if algorithm == "graph" else 0.0)


def recommend(n: int, dim: int) -> tuple[Graph, Inverted, Quantizer]:
    m = 8 if n < 10_000 else 16 if n < 1_000_000 else 32
    return Graph(m=m), Inverted(nlist=max(1, int(math.sqrt(n / 39.7)))), Quantizer(m=_clamp(dim // 16, 1, 64))


def graph_for_memory(mb: int) -> Graph:
    return Graph(m=_clamp(mb // 100, 1, 64))


def record_score(recall: float, latency_ms: float) -> float:
    """What runs of a tuner are ranked by."""
    return 0.7 * recall + 0.3 / (latency_ms + 1)
