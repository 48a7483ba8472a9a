"""Settings of the pipelines, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, replace


def optimal_bands(permutations: int, threshold: float) -> tuple[int, int]:
    """(bands, rows): of the divisors, the one whose threshold (1/b)**(1/r) is nearest; the least bands win ties."""
    best, pick = None, (1, permutations)
    for b in range(1, permutations + 1):
        if permutations % b == 0:
            r = permutations // b
            off = abs((1 / b) ** (1 / r) - threshold)
            if best is None or off < best:
                best, pick = off, (b, r)
    return pick


def _share(**named: float) -> None:
    for k, v in named.items():
        if not 0 <= v <= 1:
            raise ValueError(f"{k} has to be between 0 and 1, not {v}")


def _positive(**named: int) -> None:
    for k, v in named.items():
        if v <= 0:
            raise ValueError(f"{k} has to be positive, not {v}")


@dataclass(frozen=True)
class DedupConfig:
    threshold: float = 0.85
    permutations: int = 128
    ngram: int = 5
    verify: bool = True
    seed: int = 42

    def __post_init__(self):
        _share(threshold=self.threshold)
        _positive(permutations=self.permutations, ngram=self.ngram)

    @property
    def bands(self) -> tuple[int, int]:
        return optimal_bands(self.permutations, self.threshold)

    def with_threshold(self, threshold: float) -> DedupConfig:
        return replace(self, threshold=threshold)


@dataclass(frozen=True)
class SemanticConfig:
    threshold: float = 0.9
    batch_size: int = 64
    neighbours: int = 10
    ef_search: int = 100

    def __post_init__(self):
        _share(threshold=self.threshold)
        _positive(batch_size=self.batch_size, neighbours=self.neighbours)

    @classmethod
    def fast(cls) -> SemanticConfig:
        return cls(0.85, 128, 5, 50)

    @classmethod
    def precise(cls) -> SemanticConfig:
        return cls(0.95, 32, 20, 200)


@dataclass(frozen=True)
class HybridConfig:
    minhash_threshold: float = 0.7
    semantic_threshold: float = 0.9
    permutations: int = 128
    ngram: int = 5
    verify_with_semantic: bool = True

    def __post_init__(self):
        _share(minhash_threshold=self.minhash_threshold, semantic_threshold=self.semantic_threshold)
        _positive(permutations=self.permutations, ngram=self.ngram)

    @classmethod
    def fast(cls) -> HybridConfig:
        return cls(0.8, 0.85, 64)

    @classmethod
    def precise(cls) -> HybridConfig:
        return cls(0.5, 0.95, 256, 3)


@dataclass(frozen=True)
class StreamConfig:
    """Streaming always reads 5-grams and never verifies: a shared band is enough."""

    permutations: int = 128
    threshold: float = 0.85
    expected_items: int = 1_000_000
    fp_rate: float = 0.001
    seed: int = 42

    def __post_init__(self):
        _share(threshold=self.threshold, fp_rate=self.fp_rate)
        _positive(permutations=self.permutations, expected_items=self.expected_items)

    @property
    def dedup(self) -> DedupConfig:
        return DedupConfig(self.threshold, self.permutations, 5, False, self.seed)
