"""Scalar expressions: labels, speeds, colours and coordinates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display labels of the domain's keys.
RETURNS = {"all": "All", "ground": "Ground"}
COVERS = {"field": "Field", "decid": "Deciduous", "conif": "Coniferous"}
MISSIONS = {"density": "Density-aware", "speed": "Speed-aware", "const2": "Const 2 m/s", "const8": "Const 8 m/s"}
KERNELS = {"G": "Gaussian", "E": "Epanechnikov", "NA": "——"}
KERNEL_AGNOSTIC = ("const2", "const8")


def clamp(c: Column, lo: Column | float, hi: Column | float) -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(wrap(lo), F.least(wrap(hi), c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def label(c: Column, names: dict[str, str]) -> Column:
    """The display label of a key; unknown keys pass through."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def return_label(c: Column) -> Column:
    return label(c, RETURNS)


def cover_label(c: Column) -> Column:
    return label(c, COVERS)


def mission_label(c: Column) -> Column:
    return label(c, MISSIONS)


def kernel_label(c: Column) -> Column:
    return label(c, KERNELS)


def is_kernel_agnostic(mission: Column) -> Column:
    return mission.isin(*KERNEL_AGNOSTIC)


def manuscript_mission_label(mission: Column, kernel: Column) -> Column:
    """The kernel decides first, then the constant-speed missions."""
    return (
        F.when(kernel == "E", F.lit("KDE-guided (Epanechnikov)"))
        .when(kernel == "G", F.lit("KDE-guided (Gaussian)"))
        .when(mission == "const2", F.lit("Const. 2 m/s"))
        .when(mission == "const8", F.lit("Const. 8 m/s"))
        .otherwise(mission)
    )


def speed_bounds_of(label_: Column) -> tuple[Column, Column]:
    """Plausible ground speeds of a mission by its label."""
    slow, fast = label_.contains("2 m/s"), label_.contains("8 m/s")
    low = F.when(slow, 1.0).when(fast, 6.0).otherwise(1.0)
    high = F.when(slow, 3.2).when(fast, 10.5).otherwise(9.5)
    return low, high


def ground_speed(ve: Column, vn: Column) -> Column:
    return F.sqrt(ve * ve + vn * vn)


def inverse_linear_speed(d: Column, dmin: Column, dmax: Column, vmin: float, vmax: float) -> Column:
    """Fast over sparse cells, slow over dense ones; a flat density gives the middle speed."""
    share = F.try_divide(d - dmin, dmax - dmin)
    v = F.lit(vmin) + (F.lit(1.0) - clamp(share, 0.0, 1.0)) * F.lit(vmax - vmin)
    return F.when(dmin == dmax, F.lit((vmin + vmax) / 2)).otherwise(clamp(v, vmin, vmax))


def quantise(v: Column, step: float) -> Column:
    """The nearest multiple of ``step`` (half to even); no step, no change."""
    return F.rint(v / F.lit(step)) * F.lit(step) if step > 0 else v


def row_col(x: Column, y: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Cell of a point, row 0 in the north; dy is negative."""
    return F.floor((y - F.lit(y0)) / F.lit(dy)).cast("int"), F.floor((x - F.lit(x0)) / F.lit(dx)).cast("int")


def cell_centre(row: Column, col: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    return F.lit(x0) + (col + F.lit(0.5)) * F.lit(dx), F.lit(y0) + (row + F.lit(0.5)) * F.lit(dy)


def pixel_axis(i: Column, n: int, lo: float, hi: float) -> Column:
    """Evenly spaced axis over n pixels, both ends included."""
    return F.lit(lo) + i * F.lit((hi - lo) / (n - 1) if n > 1 else 0.0)


# sRGB (D65) to CIELAB; the matrix and white point are fixed values of the colour spaces.
_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_WHITE = (0.95047, 1.0, 1.08883)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a, b of 8-bit sRGB channels."""
    linear = []
    for c in (r, g, b):
        s = c / F.lit(255.0)
        linear.append(F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4))))
    eps, kappa = 216 / 24389, 24389 / 27
    f = []
    for weights, white in zip(_XYZ, _WHITE, strict=True):
        t = sum((c * F.lit(w) for c, w in zip(linear, weights, strict=True)), F.lit(0.0)) / F.lit(white)
        f.append(F.when(t > eps, F.cbrt(t)).otherwise((t * kappa + 16) / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def is_grey(r: Column, g: Column, b: Column, tol: float = 1e-6) -> Column:
    return F.bool_and((F.abs(r - g) <= tol) & (F.abs(g - b) <= tol))


def nearest_index(v: Column, first: Column | float, step: Column | float, n: int) -> Column:
    """Index of the nearest point of a regular axis; a tie goes to the lower one."""
    wrap = lambda z: z if isinstance(z, Column) else F.lit(float(z))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((v - wrap(first)) / wrap(step) - F.lit(0.5)))).cast("int")


def transverse_mercator_inverse(x: Column, y: Column, lon0: float, k0: float = 0.9996, fe: float = 500000.0, fn: float = 0.0) -> tuple[Column, Column]:
    """(lat, lon) in degrees of transverse Mercator metres on GRS80 (a sixth-order series in n)."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (y - F.lit(fn)) / F.lit(k0 * big), (x - F.lit(fe)) / F.lit(k0 * big)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    return F.degrees(lat), F.lit(lon0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
