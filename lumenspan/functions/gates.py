"""Validation gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def valid_depth(d: Column, low: float | None = None, high: float | None = None) -> Column:
    """Finite, above zero, and within the bounds that are set (inclusive)."""
    ok = finite(d) & (d > 0)
    if low is not None:
        ok = ok & (d >= low)
    return ok & (d <= high) if high is not None else ok


def within(x: Column, low: Column | None, high: Column | None) -> Column:
    """Inside bounds; a NULL bound is none."""
    return (F.lit(True) if low is None else low.isNull() | (x >= low)) & (F.lit(True) if high is None else high.isNull() | (x <= high))


def reasons(checks: list[tuple[Column, str | Column]]) -> Column:
    """Texts of the checks that reject, in their order; NULL does not reject."""
    return F.array_compact(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in checks]))


def readiness(valid: Column, inlier: Column, residual: Column, object_px: Column, surface_px: Column, patches: Column, touches: Column, *, min_valid=0.25, min_inlier=0.25, max_residual=2.0, min_patches: int | None = 20) -> Column:
    """Reasons against an inspection now; none means ready."""
    text = F.when(finite(residual), F.format_string("%.2f", F.bround(residual, 2))).otherwise("inf")
    pct = lambda c: F.format_string("%.1f%%", F.bround(c * 100.0, 1))
    checks = [
        (valid < min_valid, F.concat(F.lit("Depth valid low ("), pct(valid), F.lit(f" < {min_valid * 100:.0f}%)"))),
        (inlier < min_inlier, F.concat(F.lit("Plane inlier low ("), pct(inlier), F.lit(f" < {min_inlier * 100:.0f}%)"))),
        (~finite(residual) | (residual > max_residual), F.concat(F.lit("Plane residual high ("), text, F.lit(f" mm > {max_residual:.1f} mm)"))),
        (object_px == 0, "Object surface not found"),
        (surface_px == 0, "Surface-only mask not found"),
    ]
    if min_patches is not None:
        checks.append((patches < min_patches, F.concat(F.lit("Too few valid patches ("), patches.cast("string"), F.lit(f" < {min_patches})"))))
    return reasons([*checks, (touches, "Object too close to image edge / FOV")])


def touches_edge(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int, margin: int) -> Column:
    """Whether a mask's box comes within the margin; an empty mask does."""
    return F.coalesce((x0 <= margin) | (y0 <= margin) | (x1 >= width - 1 - margin) | (y1 >= height - 1 - margin), F.lit(True))


def cloud_type(name: Column) -> Column:
    """Kind of a point cloud by its file name; the first rule that fits."""
    n = F.lower(name)
    return (
        F.when(n.contains("with_floor") | n.contains("바닥"), "OBJECT_PLATFORM_FLOOR")
        .when(n.contains("물체+플랫폼") | n.contains("object+platform") | n.contains("object_and_platform"), "OBJECT_AND_PLATFORM")
        .when(n.contains("물체만") | n.contains("object_only"), "OBJECT_ONLY")
        .when(n.startswith("final_dc_mask_phase"), "OBJECT_ONLY")
        .otherwise("UNKNOWN")
    )


def inside(path: Column, root: str) -> Column:
    """Whether a normalised path is the root or lies below it."""
    return (path == root) | path.startswith(root.rstrip("/") + "/")
