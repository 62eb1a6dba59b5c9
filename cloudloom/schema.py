"""Schemas, sensor constants and compression options."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the sensor and of the line finder.
THETA_RANGE, PHI_MAX, PHI_MIN, WIDTH, HEIGHT = 360.0, 2.5, -24.9, 2000, 64
BANDS = (0.0, 25.0, 50.0, 100.0)
DENSE_DEPTH, DENSE_SIZE, EPS_SCALE, CORE_DEGREE = 100.0, 300, 5.0, 78
MAX_DIS, GRID, PHI_FACTOR, DEPTH_FACTOR, DEPTH_DIFF, LEAST_LINE = 0.01, 0.01, 5.0, 0.001, 2.0, 6
CODECS = ("arithmetic", "deflate", "lzma", "bzip2")

POINTS = "frame_id long, point_id long, x float, y float, z float"


@dataclass(frozen=True)
class CompressOptions:
    """``resolution`` is twice the error bound; ``rate`` in 0..1 replaces density clustering by the nearest share."""

    resolution: float = 0.04
    rate: float = -1.0
    codec: str = "arithmetic"
    intra_only: bool = False
    compat: bool = False

    def __post_init__(self) -> None:
        names = {"entropy": "arithmetic", "bz2": "bzip2"}
        object.__setattr__(self, "codec", names.get(self.codec.lower(), self.codec.lower()))
        if self.codec not in CODECS or not self.resolution > 0:
            raise ValueError("an unknown codec, or a resolution of zero or less")

    @property
    def by_density(self) -> bool:
        return not 0 <= self.rate <= 1
