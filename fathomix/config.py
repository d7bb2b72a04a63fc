"""Parameters of an index."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IndexConfig:
    """``layers`` are the upper limits of the frequency bands; past the last one the top band is open."""

    segment_size: int = 500
    max_token_length: int = 254
    n_frequent: int = 100
    layers: tuple[int, ...] = (1, 10, 50, 100, 1000, 5000, 10000, 20000, 50000)
    top_words: int = 10_000
    window: int = 10
    rank_depth: int = 1000
    layer_threshold: float = 0.001
    exact_up_to: int = 1500
    max_doc_bytes: int = 5_242_880
