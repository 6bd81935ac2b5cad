"""Affine geotransforms and grid codecs: one convention for every format.

Cells are 0-based (row, col), row 0 in the north, with x = x0 + (col + 0.5) dx and
y = y0 + (row + 0.5) dy, where dy is negative.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass


@dataclass(frozen=True)
class GeoTransform:
    """Six numbers in the usual order of raster libraries."""

    x0: float
    dx: float
    x_rot: float
    y0: float
    y_rot: float
    dy: float

    @classmethod
    def of(cls, values: Sequence[float]) -> GeoTransform:
        if len(values) < 6:
            raise ValueError("a geotransform has six numbers")
        return cls(*(float(v) for v in values[:6]))

    def __iter__(self) -> Iterator[float]:
        return iter(astuple(self))

    def __len__(self) -> int:
        return 6

    def __getitem__(self, i: int) -> float:
        return astuple(self)[i]

    def extents(self, nrows: int, ncols: int) -> tuple[float, float, float, float]:
        """(xmin, xmax, ymin, ymax) of the raster's edges."""
        x1, y1 = self.x0 + ncols * self.dx, self.y0 + nrows * self.dy
        return min(self.x0, x1), max(self.x0, x1), min(self.y0, y1), max(self.y0, y1)

    def axes(self, nrows: int, ncols: int) -> tuple[list[float], list[float]]:
        """Ascending cell centres; row i of the raster is ys[-1 - i] where dy is negative."""
        xs = sorted(self.x0 + (c + 0.5) * self.dx for c in range(ncols))
        ys = sorted(self.y0 + (r + 0.5) * self.dy for r in range(nrows))
        return xs, ys
