"""Thresholds and settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Matching
    partner_overlap: float = 0.3  # of the smaller footprint
    identical_iou: float = 0.95
    identical_hausdorff: float = 0.5
    deviating_iou: float = 0.3
    map_only_overlap: float = 0.1
    # Image check
    min_score: float = 0.70
    score_lead: float = 0.05  # by which the map outline may beat the official one
    offset_range: float = 1.5
    max_overhang: float = 0.9
    overhang_step: float = 0.3
    sample_step: float = 0.25
    edge_angle: float = 30.0
    edge_floor: float = 40.0
    edge_quantile: float = 0.8
    # Fitting
    snap: float = 0.5
    aligned_snap: float = 0.05
    mask_distance: float = 0.3
    max_clip_share: float = 0.30
    min_overlap: float = 0.05
    conflict_overlap: float = 0.1
    near_identical_hausdorff: float = 0.05
    slide: float = 2.0
    same_corner: float = 0.05
    corner_moved: float = 0.01
    # Addresses and order
    address_distance: float = 50.0
    strip: float = 50.0
    # Guards
    max_features: int = 20_000
    page_size: int = 1000
    cell: float = 32.0


DEFAULTS = Params()
