"""Morphology of frames, each operator as a composition of steps on masks.

A composition is written once and run by two interpreters: ``Tables`` on
DataFrames (``operators/pixels.py``), ``Sql`` as text for DuckDB, whose steps
are set-based definitions of their own.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.operators import hypotheses as V
from lumenspan.operators import intervals as I
from lumenspan.operators import pixels as P
from lumenspan.operators.selection import percentile
from lumenspan.plans.kernels import H, PIXELS, W_, points, points_sql, rasters
from lumenspan.registry import query
from lumenspan.session import written

SHAPE = P.Shape(H, W_)
#: Sizes on frames of 24 x 32 pixels; operators take others as parameters.
CLOSE, MARGIN, EDGE = 2, 1, 2


class Steps:
    """Compositions that both interpreters share."""

    def opened(self, x, offsets):
        return self.dilate(self.erode(x, offsets), offsets)

    def closed(self, x, offsets, times=1):
        for _ in range(times):
            x = self.dilate(x, offsets)
        for _ in range(times):
            x = self.erode(x, offsets)
        return x

    def filled(self, x, connectivity=8, most=None):
        return self.union(x, self.holes(x, connectivity, most))

    def external(self, x):
        """The largest component with all inside its outline, also behind
        diagonal gaps."""
        return self.filled(self.largest(x), 4)

    def inspection(self, x):
        """Largest part, filled, closed, largest again, eroded."""
        return self.erode(self.largest(self.closed(self.filled(self.largest(x)), P.ellipse(CLOSE))), P.ellipse(MARGIN))


class Tables(Steps):
    """Masks as runs of pixels, dealt by frame once."""

    def __init__(self, spark, sf):
        self.px = written(rasters(spark, sf), "pixels")
        self.frames = self.px.select("frame").distinct()

    def runs(self, pixels):
        return I.from_pixels(I.dealt(pixels.select(*P.PIXEL)))

    def mask(self, where="`set`"):
        return self.runs(self.px.where(where.replace('"set"', "`set`")))

    def keep(self, x):
        return written(x, "runs")

    def dilate(self, x, offsets):
        return I.dilate(x, offsets, SHAPE)

    def erode(self, x, offsets):
        return I.erode(x, offsets, SHAPE)

    def erode_box(self, x, radius):
        return I.erode(x, P.box(radius), SHAPE)

    def union(self, x, y):
        return I.union(x, y)

    def minus(self, x, y):
        return I.minus(x, y)

    def both(self, x, y):
        return I.both(x, y)

    def where(self, x, condition):
        return I.from_pixels(I.to_pixels(x).where(condition))

    def best(self, x, score, allowed="true"):
        return I.best(x, SHAPE, F.expr(score), F.expr(allowed))

    def largest(self, x):
        return I.largest(x, SHAPE)

    def holes(self, x, connectivity, most):
        return I.holes(x, SHAPE, connectivity, most)

    def filled(self, x, connectivity=8, most=None):
        return I.filled(x, SHAPE, connectivity, most)

    def density(self, x, radius, least):
        return self.runs(P.density(I.to_pixels(x), radius, least, SHAPE))

    def convex(self, x):
        return I.convex(x)

    def guarded(self, x, y, condition):
        """The rows of y in frames whose areas a (of x) and b (of y), and edge
        (does y touch the frame's edge zone), meet the condition."""
        edge = (F.col("u0") <= EDGE) | (F.col("u1") >= W_ - EDGE - 1) | ~F.col("v").between(EDGE + 1, H - EDGE - 2)
        a, b = x.groupBy("frame").agg(F.sum(I.length()).alias("a")), y.groupBy("frame").agg(F.sum(I.length()).alias("b"), F.bool_or(edge).alias("edge"))
        return y.join(a.join(b, "frame").where(condition), "frame", "left_semi")

    def dilate_by_area(self, x, scale, low, high):
        area = F.sum(I.length()).over(W.partitionBy("frame"))
        return I.dilate_by(x, F.least(F.greatest((F.sqrt(area) * scale).cast("int"), F.lit(low)), F.lit(high)), [P.ellipse(r) for r in range(high + 1)], SHAPE)

    def polygons(self, x, corners):
        """The part of x inside each frame's polygon, given by its corners
        (expressions of the frame's number)."""
        at = F.array(*[F.struct(F.expr(u).cast("long").alias("u"), F.expr(v).cast("long").alias("v")) for u, v in corners])
        edge = lambda i: F.struct(F.get("at", i).alias("a"), F.get("at", (i + 1) % len(corners)).alias("b"))
        edges = self.frames.select("frame", at.alias("at")).select("frame", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(corners) - 1)), edge)).alias("e"))
        return I.both(x, I.polygons(edges.select("frame", *[F.col(f"e.{c[0]}.{c[1]}").alias(c) for c in ("au", "av", "bu", "bv")]), SHAPE))

    def counts(self, x):
        n, span = I.length(), F.col("u1") - F.col("u0") + 1
        got = x.groupBy("frame").agg(F.sum(n).alias("pixels"), F.sum(((F.col("u0") + F.col("u1")) * span / 2).cast("long")).alias("u"), F.sum(F.col("v") * span).alias("v"))
        return self.frames.join(got, "frame", "left").select("frame", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pixels", "u", "v")])


class Sql(Steps):
    """Each step is a common table expression; a mask is its name."""

    def __init__(self):
        self.parts = [
            'px as materialized (select (o_orderkey // 1536) * 2 + o_custkey % 2 as frame, o_orderkey % 32 as u, o_orderkey // 32 % 24 as v, max(o_totalprice) as d, bool_or(o_orderstatus <> \'O\') as "set" from orders group by all)',
            "fr as materialized (select distinct frame from px)",
            "grid as materialized (select u, v from (select unnest(range(32)) as u), (select unnest(range(24)) as v))",
        ]

    def add(self, body, head=""):
        name = f"s{len(self.parts)}"
        self.parts.append(f"{name}{head} as {'' if head else 'materialized '}({body})")
        return name

    def keep(self, x):
        return x

    def polygons(self, x, corners):
        edges = self.add(" union all ".join(f"select frame, {a[0]} as au, {a[1]} as av, {b[0]} as bu, {b[1]} as bv from fr" for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)))
        cross = "((bu - au) * (v - av) - (bv - av) * (u - au))"
        on = f"{cross} = 0 and u between least(au, bu) and greatest(au, bu) and v between least(av, bv) and greatest(av, bv)"
        right = f"(av <= v) <> (bv <= v) and ({cross} > 0) = (bv > av)"
        return self.add(f"select frame, u, v from {x} join {edges} using (frame) group by all having bool_or({on}) or count(*) filter ({right}) % 2 = 1")

    def mask(self, where='"set"'):
        return self.add(f"select frame, u, v from px where {where.replace('`', chr(34))}")

    @staticmethod
    def offsets(offsets):
        return "(values " + ", ".join(f"({a}, {b})" for a, b in offsets) + ") o(du, dv)"

    def dilate(self, x, offsets):
        return self.add(f"select distinct frame, u + du as u, v + dv as v from {x}, {self.offsets(offsets)} where u + du between 0 and 31 and v + dv between 0 and 23")

    def erode(self, x, offsets):
        # a set pixel stays unless one of its neighbours in the frame is unset; the offsets hold (0, 0)
        return self.add(f"select * from {x} where (frame, u, v) not in (select m.frame, m.u, m.v from {x} m, {self.offsets(offsets)} where m.u + du between 0 and 31 and m.v + dv between 0 and 23 and (m.frame, m.u + du, m.v + dv) not in (select frame, u, v from {x}))")

    def erode_box(self, x, radius):
        off = self.add(f"select grid.frame, grid.u, grid.v from (select * from fr, grid) grid where (frame, u, v) not in (select frame, u, v from {x})")
        return self.add(f"select m.* from {x} m where not exists (select 1 from {off} b where b.frame = m.frame and abs(b.u - m.u) <= {radius} and abs(b.v - m.v) <= {radius})")

    def union(self, x, y):
        return self.add(f"select * from {x} union select * from {y}")

    def minus(self, x, y):
        return self.add(f"select * from {x} except select * from {y}")

    def both(self, x, y):
        return self.add(f"select * from {x} intersect select * from {y}")

    def where(self, x, condition):
        return self.add(f"select * from {x} where {condition}")

    def labels(self, x, connectivity=8):
        near = "greatest(abs(b.u - a.u), abs(b.v - a.v)) = 1" if connectivity == 8 else "abs(b.u - a.u) + abs(b.v - a.v) = 1"
        step = f"(values {', '.join(f'({a}, {b})' for a, b in P.box(1))}) o(du, dv)"
        nb = self.add(f"select a.frame, a.v * 32 + a.u as p, b.v * 32 + b.u as q from {x} a, {step} join {x} b on b.frame = a.frame and b.u = a.u + du and b.v = a.v + dv where {near}")
        ln = f"s{len(self.parts)}"
        self.add(f"select frame, v * 32 + u, v * 32 + u from {x} union select n.frame, n.q, min(l.label) from {ln} l join {nb} n on n.frame = l.frame and n.p = l.p join recurring.{ln} c on c.frame = n.frame and c.p = n.q where l.label < c.label group by n.frame, n.q", "(frame, p, label) using key (frame, p)")
        return self.add(f"select frame, p % 32 as u, p // 32 as v, label from {ln}")

    def best(self, x, score, allowed="true"):
        y = self.labels(x)
        top = self.add(f"select frame, max_by(label, ({score}, -label)) as label from (select frame, label, count(*) as area, avg(u) as cx, avg(v) as cy from {y} group by all) where {allowed} group by frame")
        return self.add(f"select frame, u, v from {y} join {top} using (frame, label)")

    def largest(self, x):
        return self.best(x, "area")

    def holes(self, x, connectivity, most):
        y = self.labels(self.add(f"select frame, u, v from fr, grid except select * from {x}"), connectivity)
        inner = self.add(f"select frame, label from {y} group by all having not bool_or(u in (0, 31) or v in (0, 23)){'' if most is None else f' and count(*) <= {most}'}")
        return self.add(f"select frame, u, v from {y} join {inner} using (frame, label)")

    def density(self, x, radius, least):
        size = 2 * radius + 1
        mirror = lambda c, n: f"case when {c} < 0 then -1 - ({c}) when {c} >= {n} then {2 * n - 1} - ({c}) else {c} end"
        box_ = self.add(f"select g.u, g.v, {mirror('g.u + du', 32)} as x, {mirror('g.v + dv', 24)} as y from grid g, {self.offsets(P.box(radius))}")
        return self.add(f"select m.frame, b.u, b.v from {x} m join {box_} b on b.x = m.u and b.y = m.v group by all having count(*) >= {least} * {size * size}")

    def convex(self, x):
        ends = self.add(f"select distinct frame, unnest([min(u), max(u)]) as u, v from {x} group by frame, v")
        side = lambda p: f"(b.u - a.u) * ({p}.v - a.v) - (b.v - a.v) * ({p}.u - a.u)"
        edges = self.add(f"select a.frame, a.u as au, a.v as av, b.u as bu, b.v as bv from {ends} a join {ends} b on a.frame = b.frame and (a.u, a.v) <> (b.u, b.v) join {ends} c on c.frame = a.frame group by all having min({side('c')}) >= 0")
        span = self.add(f"select frame, min(u) as u0, max(u) as u1, min(v) as v0, max(v) as v1 from {x} group by frame")
        return self.add(f"select s.frame, g.u, g.v from {span} s join grid g on g.u between u0 and u1 and g.v between v0 and v1 where not exists (select 1 from {edges} e where e.frame = s.frame and (bu - au) * (g.v - av) - (bv - av) * (g.u - au) < 0)")

    def guarded(self, x, y, condition):
        ok = self.add(f"select frame from (select frame, count(*) as a from {x} group by frame) join (select frame, count(*) as b, bool_or(not (u between {EDGE + 1} and {W_ - EDGE - 2} and v between {EDGE + 1} and {H - EDGE - 2})) as edge from {y} group by frame) using (frame) where {condition}")
        return self.add(f"select * from {y} where frame in (select frame from {ok})")

    def dilate_by_area(self, x, scale, low, high):
        r = self.add(f"select frame, least(greatest(trunc(sqrt(count(*)) * {scale})::int, {low}), {high}) as r from {x} group by frame")
        steps = ", ".join(f"({k}, {a}, {b})" for k in range(high + 1) for a, b in P.ellipse(k))
        return self.add(f"select distinct frame, u + du as u, v + dv as v from {x} join {r} using (frame) join (values {steps}) o(r, du, dv) using (r) where u + du between 0 and 31 and v + dv between 0 and 23")

    def counts(self, x):
        return f"with recursive {', '.join(self.parts)} select frame, count(m.u) as pixels, coalesce(sum(m.u), 0)::bigint as u, coalesce(sum(m.v), 0)::bigint as v from fr left join {x} m using (frame) group by frame"


def morphology(name: str, doc: str, steps) -> None:
    """Register ``steps`` (a function of an interpreter, to a mask) as a query
    that counts the mask's pixels and sums their places."""
    sql = Sql()

    def run(spark, sf):
        t = Tables(spark, sf)
        return t.counts(steps(t))

    run.__doc__ = doc
    query(name, sql.counts(steps(sql)))(run)


def hull_guard(share: float, growth: float = 1.5) -> str:
    """A hull is kept if it grows no more, covers no more of the frame, and
    stays off its edge."""
    return f"b <= {growth} * a and b <= {share} * {H * W_} and not edge"


_RECT = f"u between {EDGE} and {W_ - 1 - EDGE} and v between {EDGE} and {H - 1 - EDGE}"
#: Corners of a concave polygon whose places differ from frame to frame.
_CORNERS = [("2 + frame % 3", "2"), ("28", "3 + frame % 5"), ("12 + frame % 7", "9"), ("26", "20"), ("4", "18 - frame % 4"), ("9", "10")]
_CENTRAL = f"area - 20 * sqrt((cx - {(W_ - 1) / 2}) * (cx - {(W_ - 1) / 2}) + (cy - {(H - 1) / 2}) * (cy - {(H - 1) / 2}))"


def _blob(a):
    """A part of each frame that does not reach its edge."""
    return a.keep(a.where(a.largest(a.where(a.mask(), "u between 6 and 25 and v between 5 and 18")), "(u - 16) * (u - 16) + (v - 12) * (v - 12) <= 60"))


def _contour_roi(a):
    views = [a.mask(), a.mask("d > 50000"), a.mask("d < 170000 and `set`")]
    agreed = a.union(a.union(a.both(views[0], views[1]), a.both(views[1], views[2])), a.both(views[0], views[2]))
    main = a.best(a.where(agreed, "u between 5 and 26 and v between 5 and 18"), _CENTRAL, f"area >= 8 and area <= {0.75 * H * W_}")
    full = a.keep(a.filled(a.where(a.closed(main, P.ellipse(1)), _RECT), 4))
    return a.union(full, a.guarded(full, a.where(a.convex(full), _RECT), hull_guard(0.75)))


def _hybrid_roi(a):
    """A board of known and unknown pixels: those with a price are measured, and
    those of some height over the board's plane are the object's."""
    board = a.where(a.mask("true"), _RECT)
    unknown = a.keep(a.where(a.holes(a.mask("true"), 4, None), _RECT))
    objects = a.where(a.mask("`set` and d > 40000"), _RECT)
    main = a.keep(a.largest(objects))
    enclosed = a.keep(a.both(a.holes(main, 8, None), unknown))
    around = a.minus(a.both(a.dilate(main, P.ellipse(2)), unknown), enclosed)
    toned = a.where(around, "(u + v) % 3 <> 0")  # unknown pixels whose colour is the object's
    hybrid = a.closed(a.union(a.union(main, enclosed), toned), P.ellipse(1))
    allowed = a.union(objects, unknown)
    return a.both(a.erode(a.largest(a.both(hybrid, allowed)), P.ellipse(1)), a.union(board, unknown))


morphology("mor02_border_ring", "A workspace less its erosion by a box, 10 pixels wide at least; beyond the frame counts as set.", lambda a: (lambda w: a.minus(w, a.erode_box(w, 10)))(a.where(a.filled(a.closed(a.mask(), P.box(1))), f"u between {EDGE} and {W_ - 1 - EDGE}")))
morphology("mor03_open_close", "Opened, then closed, by ellipses.", lambda a: a.closed(a.opened(a.mask(), P.ellipse(1)), P.ellipse(2), times=2))
morphology("mor05_polygon", "Set pixels in a concave polygon of each frame, its outline included.", lambda a: a.polygons(a.mask(), _CORNERS))
morphology("mor06_external_fill", "The largest component, filled to its outline, inside the workspace.", lambda a: a.where(a.external(a.mask()), _RECT))
morphology("mor07_guarded_hull", "The hull of a part, nothing where it grows or covers too much or comes near the edge.", lambda a: (lambda x: a.guarded(x, a.where(a.convex(x), _RECT), hull_guard(0.75)))(a.keep(a.closed(_blob(a), P.ellipse(1)))))
morphology("mor08_fill_holes", "All enclosed holes; a diagonal gap opens one.", lambda a: a.filled(a.mask()))
morphology("mor09_fill_small_holes", "Enclosed holes of at most three pixels.", lambda a: a.filled(a.mask(), most=3))
morphology("mor13_contour_roi", "Pixels that two of three views agree on: main component by area and place, closed, filled, its hull if guarded, else itself.", _contour_roi)
morphology("mor15_local_band", "Bands about markers, without the markers and their surroundings.", lambda a: (lambda m: a.minus(a.dilate(m, P.ellipse(4)), a.dilate(m, P.ellipse(1))))(a.mask("d > 160000")))
morphology("mor21_density_support", "Known pixels in dense surroundings, closed, opened, and the central part.", lambda a: a.best(a.opened(a.closed(a.both(a.density(a.mask(), 2, 0.5), a.mask("true")), P.ellipse(2)), P.ellipse(1)), _CENTRAL, "area >= 4"))
morphology("mor24_silhouette", "Points as discs, closed, the largest part filled.", lambda a: a.external(a.closed(a.dilate(a.mask("u % 5 = 0 and v % 4 < 2 and d > 150000"), P.ellipse(1)), P.ellipse(2))))
morphology("mor25_dynamic_object", "What differs from the background: opened, closed, largest, filled, eroded.", lambda a: a.erode(a.external(a.closed(a.opened(a.mask("abs(d - 60000) >= 12000"), P.box(1)), P.box(1))), P.box(1)))
morphology("mor28_mask_cleaner", "Opened, closed, bridged, components of some size, filled, eroded.", lambda a: a.erode(a.best(a.filled(a.external(a.closed(a.closed(a.opened(a.filled(a.mask("true"), most=2), P.box(1)), P.box(1)), P.box(2)))), "area", "area >= 20"), P.box(1)))
morphology("mor30_silhouette_finalize", "Closed, smoothed at a half, the largest part filled, eroded; no hull.", lambda a: a.erode(a.external(a.density(a.closed(a.mask(), P.ellipse(1)), 1, 0.5)), P.ellipse(1)))
morphology("mor31_search_ring", "A ring beyond a search area about a part, as wide as its size asks.", lambda a: (lambda s: a.minus(a.dilate(s, P.ellipse(3)), s))(a.dilate_by_area(_blob(a), 0.3, 1, 5)))


_OBJECT, _SURFACE = "`set` and d > 60000", "`set` and d > 90000"


def _inspected(a):
    """Object, surface and inspection mask of each frame."""
    x, y = a.mask(_OBJECT), a.mask(_SURFACE)
    return x, y, a.inspection(a.union(x, y))


def _inspection_sql() -> str:
    sql = Sql()
    x, y, z = _inspected(sql)
    n = lambda name, m: f"(select frame, count(*) as {name} from {m} group by frame) using (frame)"
    return f"""with recursive {", ".join(sql.parts)},
n as (select frame, coalesce(o, 0) as object_px, coalesce(s, 0) as surface_px, coalesce(i, 0) as pixels from fr left join {n("o", x)} left join {n("s", y)} left join {n("i", z)}),
t as (select *, case when object_px = 0 or surface_px = 0 then 'EMPTY_INPUT' when object_px = {H * W_} then 'FULL_FRAME_OBJECT' when pixels = 0 then 'EMPTY_AFTER_EROSION' when pixels = {H * W_} then 'FULL_FRAME' else 'OK' end as status from n)
select frame, status, case when status = 'OK' then pixels end as pixels, case when status = 'OK' then round(pixels / surface_px, 6) end as to_surface, case when status = 'OK' then round(pixels / object_px, 6) end as to_object from t"""


@query("mor11_inspection_mask", _inspection_sql())
def mor11(spark, sf):
    """Inspection mask with its guards: an input or a result that is empty or
    covers the frame has a status instead of ratios."""
    t = Tables(spark, sf)
    n = t.frames
    for name, m in zip(("object_px", "surface_px", "pixels"), _inspected(t), strict=True):
        n = n.join(m.groupBy("frame").agg(F.sum(I.length()).alias(name)), "frame", "left")
    n = n.fillna(0)
    whole = H * W_
    status = F.when((F.col("object_px") == 0) | (F.col("surface_px") == 0), "EMPTY_INPUT").when(F.col("object_px") == whole, "FULL_FRAME_OBJECT").when(F.col("pixels") == 0, "EMPTY_AFTER_EROSION").when(F.col("pixels") == whole, "FULL_FRAME").otherwise("OK")
    good = lambda c: F.when(F.col("status") == "OK", c)
    return n.withColumn("status", status).select("frame", "status", good(F.col("pixels")).alias("pixels"), good(F.round(F.col("pixels") / F.col("surface_px"), 6)).alias("to_surface"), good(F.round(F.col("pixels") / F.col("object_px"), 6)).alias("to_object"))


def _components_sql() -> str:
    sql = Sql()
    x = sql.labels(sql.mask())
    return f"with recursive {', '.join(sql.parts)} select frame, label, count(*) as area, round(avg(u), 6) as cx, round(avg(v), 6) as cy from {x} group by all"


@query("mor10_components", _components_sql())
def mor10(spark, sf):
    """Labels, areas and centres of the 8-connected components of each frame."""
    found = I.areas(I.labelled(I.from_pixels(I.dealt(rasters(spark, sf).where("`set`"))), SHAPE))
    return found.select("frame", "label", "area", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


_DISC = "(values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(du, dv)"


@query("mor01_erode", f"""with {PIXELS}, m as (select frame, u, v from px where "set"),
k as (select m.frame, m.u, m.v, count(*) filter (q.u is not null or m.u + du not between 0 and 31 or m.v + dv not between 0 and 23) as n from m cross join {_DISC} left join m q on q.frame = m.frame and q.u = m.u + du and q.v = m.v + dv group by all)
select frame, count(*) filter (n = 5) as eroded, count(*) as mask from k group by frame""")
def mor01(spark, sf):
    """Erosion by a disc of radius 1; outside the frame counts as set."""
    m = rasters(spark, sf).where("`set`").select(*P.PIXEL)
    kept = P.erode(m, P.ellipse(1), SHAPE).withColumn("on", F.lit(1))
    return m.join(kept, P.PIXEL, "left").groupBy("frame").agg(F.count("on").alias("eroded"), F.count("*").alias("mask"))


@query("mor23_laplacian_variance", """with g as (select * from (select distinct (o_orderkey // 1536) * 2 + o_custkey % 2 as frame from orders), (select unnest(range(32)) as u), (select unnest(range(24)) as v)),
px as (select (o_orderkey // 1536) * 2 + o_custkey % 2 as frame, o_orderkey % 32 as u, o_orderkey // 32 % 24 as v, max(o_totalprice) / 2000 as d from orders group by all),
x as materialized (select g.frame, g.u, g.v, coalesce(d, 0) as d from g left join px using (frame, u, v)),
n as (select frame, d, lag(d) over a as l, lead(d) over a as r, lag(d) over b as t, lead(d) over b as o from x window a as (partition by frame, v order by u), b as (partition by frame, u order by v))
select frame, round(var_pop(coalesce(l, r) + coalesce(r, l) + coalesce(t, o) + coalesce(o, t) - 4 * d), 4) as sharpness from n group by frame""")
def mor23(spark, sf):
    """Variance of the Laplacian; the frame is mirrored about its edge pixels,
    and a pixel without a value is 0."""
    px = rasters(spark, sf)
    rest = P.complement(px.select(*P.PIXEL), px.select("frame").distinct(), SHAPE).withColumn("g", F.lit(0.0))
    g = px.select(*P.PIXEL, (F.col("d") / 2000).alias("g")).unionByName(rest)
    total = -4 * F.col("g")
    for row, along in (("v", "u"), ("u", "v")):
        w = W.partitionBy("frame", row).orderBy(along)
        before, after = F.lag("g").over(w), F.lead("g").over(w)
        total = total + F.coalesce(before, after) + F.coalesce(after, before)
    return g.select("frame", total.alias("l")).groupBy("frame").agg(F.round(F.var_pop("l"), 4).alias("sharpness"))


#: Places of the result to places of the frame, and back.
HOMOGRAPHY = ((1.0, 0.1, 0.03), (0.0, 1.0, 1.07), (0.001, 0.0, 1.0))


def _warp_sql() -> str:
    sql = Sql()

    def warped(x, matrix):
        at = [" + ".join(["0.0::double", *[f"{k!r}::double * {c}" for k, c in zip(row, ("u", "v", "1.0::double"), strict=True)]]) for row in matrix]
        grid = sql.add(f"select u as x, v as y, round_even(({at[0]}) / ({at[2]}), 0)::bigint as u, round_even(({at[1]}) / ({at[2]}), 0)::bigint as v from grid")
        return sql.add(f"select frame, x as u, y as v from {x} join {grid} using (u, v)")

    out = warped(sql.mask(), HOMOGRAPHY)
    back = warped(out, P.inverse(HOMOGRAPHY))
    return f"with recursive {', '.join(sql.parts)} select frame, (select count(*) from {out} o where o.frame = fr.frame) as pixels, (select count(*) from {back} o where o.frame = fr.frame) as back from fr"


@query("mor20_perspective_warp", _warp_sql())
def mor20(spark, sf):
    """A mask seen through a homography, nearest pixels, and back through its
    inverse; outside the frame nothing is set."""
    t = Tables(spark, sf)
    out = P.warp(t.px.where("`set`").select(*P.PIXEL), HOMOGRAPHY, SHAPE)
    back = P.warp(out, P.inverse(HOMOGRAPHY), SHAPE)
    n = [m.groupBy("frame").agg(F.count("*").alias(c)) for m, c in ((out, "pixels"), (back, "back"))]
    return t.frames.join(n[0], "frame", "left").join(n[1], "frame", "left").fillna(0)


#: Plane of the board in inverse depth, over places scaled to -1 to 1, and the
#: height of what lies on it; gates and limits of a surface's geometry.
PLANE, HEIGHT = (0.0001, 0.00005, 0.002), 30.0
LOW, HIGH, LEAST_VALID, LEAST_INLIERS, MOST_RESIDUAL, LEAST_AREA = 4.0, 250.0, 0.25, 0.25, 2.0, 6
PATCH, STRIDE = 4, 2
_X, _Y = f"(u / {W_ - 1}e0 * 2 - 1)", f"(v / {H - 1}e0 * 2 - 1)"
_BOARD = f"1.0 / ({PLANE[0]!r} * {_X} + {PLANE[1]!r} * {_Y} + {PLANE[2]!r})"
_ON_BOARD = "d > 130000 and u between 6 and 25 and v between 5 and 18"


def _surface(a, candidate):
    """Object and surface: opened, closed, the main component by area and
    place, filled to its outline, and eroded by the margin."""
    x = a.closed(a.opened(a.where(candidate, _RECT), P.ellipse(0)), P.ellipse(1), times=2)
    main = a.best(a.where(x, _RECT), _CENTRAL, f"area >= {LEAST_AREA} and area <= {0.75 * (H - 2 * EDGE) * (W_ - 2 * EDGE)}")
    obj = a.keep(a.where(a.filled(main, 4), _RECT))
    return obj, a.erode(obj, P.ellipse(MARGIN))


#: Measured depth: the board with noise and what lies on it; every fifth frame
#: is scattered, so that no plane is found there.
_NEAR = f"case when frame % 5 = 4 then 100 + d % 700 else {_BOARD} + d % 1.5 - case when {_ON_BOARD} then {HEIGHT} else 0.0 end end"
_POINT = {"x": _X, "y": _Y, "z": _NEAR}
_PLANE = {"tolerance": 2.5, "least": 50}
_WORK = (H - 2 * EDGE) * (W_ - 2 * EDGE)
_GOOD = f"coalesce(valid >= {LEAST_VALID} and inliers / n >= {LEAST_INLIERS} and residual <= {MOST_RESIDUAL}, false)"
_UP = f"1.0 / (a * {_X} + b * {_Y} + c) - ({_NEAR}) between {LOW} and {HIGH}"


def _surface_sql() -> str:
    sql = Sql()
    sql.parts += [points_sql(_POINT, f"{_RECT} and ({_NEAR}) between 80 and 2000"), *V.planes_sql("pt", V.INVERSE, "p", **_PLANE)]
    sql.parts.append(f"gate as materialized (select frame, round(coalesce(valid, 0), 6) as depth_valid, {_GOOD} as good, a, b, c from fr left join (select key as frame, count(*) / {_WORK} as valid from pt group by key) using (frame) left join pplanes on key = frame)")
    obj, surface = _surface(sql, sql.add(f"select frame, u, v from px join gate using (frame) where good and {_RECT} and {_UP}"))
    patch = f"select frame, x, y from {surface} m join (select u as x, v as y from grid where u % {STRIDE} = 0 and v % {STRIDE} = 0) on m.u between x and x + {PATCH - 1} and m.v between y and y + {PATCH - 1} group by all having count(*) = {PATCH * PATCH}"
    n = lambda m: f"(select count(*) from ({m}) m where m.frame = gate.frame)"
    return f"""with recursive {", ".join(sql.parts)}
select frame, depth_valid, good as plane, {n(f"select * from {obj}")} as object_px, {n(f"select * from {surface}")} as surface_px, {n(patch)} as patches from gate"""


@query("mor12_surface_geometry", _surface_sql())
def mor12(spark, sf):
    """Valid depth of each frame's workspace, its plane by votes, gates on share
    of voters and residual, heights over it, main component, surface and whole
    patches; a frame that fails a gate has nothing on it."""
    t = Tables(spark, sf)
    at = points(t.px, _POINT, f"{_RECT} and ({_NEAR}) between 80 and 2000")
    valid = at.groupBy("key").agg((F.count("*") / _WORK).alias("valid"))
    gate = t.frames.join(valid.join(V.planes(at, V.INVERSE, **_PLANE), "key", "left").withColumnRenamed("key", "frame"), "frame", "left")
    gate = written(gate.select("frame", F.round(F.coalesce("valid", F.lit(0.0)), 6).alias("depth_valid"), F.expr(_GOOD).alias("plane"), "a", "b", "c"), "gate")
    obj, surface = _surface(t, t.runs(t.px.where(_RECT).join(gate.where("plane"), "frame").where(_UP)))
    obj, surface = written(I.to_pixels(obj), "object"), written(I.to_pixels(surface), "surface")
    start = lambda c: F.explode(F.expr(f"filter(transform(sequence(0, {PATCH - 1}), i -> {c} - i), x -> x >= 0 and x % {STRIDE} = 0)"))
    patches = surface.select("frame", "u", start("v").alias("y")).select("frame", "y", start("u").alias("x")).groupBy("frame", "x", "y").agg(F.count("*").alias("n")).where(F.col("n") == PATCH * PATCH)
    out = gate.select("frame", "depth_valid", "plane")
    for name, m in (("object_px", obj), ("surface_px", surface), ("patches", patches)):
        out = out.join(m.groupBy("frame").agg(F.count("*").alias(name)), "frame", "left")
    return out.fillna(0, ["object_px", "surface_px", "patches"])


#: A board with holes in its depth: the board's corners, markers on it, depth
#: (0: invalid), places in space, and Lab values of the colour image.
_BOARD_QUAD = [("2 + frame % 2", "2"), ("29", "2 + frame % 3"), ("28", "21"), ("3", "20 - frame % 2")]
_MARKER = "(u between 3 and 5 and v between 3 and 5 or u between 25 and 27 and v between 17 and 19)"
_THING = "u between 9 and 21 and v between 7 and 16 and (u - 15) * (u - 15) + (v - 12) * (v - 12) <= 38"
_RAW = f"case when frame % 7 = 6 then 100 + d % 700 when frame % 11 = 5 or d % 11 < 0.8 then 0 else 500 + 0.4 * u - 0.2 * v + d % 1.5 - case when frame % 13 <> 12 and {_THING} then 30 else 0 end end"
_VALID = "z between 80 and 2000"
_SPACE = {"x": "(u - 15.5) * z / 500", "y": "(v - 11.5) * z / 500", "z": "z"}
_LAB = ("coalesce(d, 50000) / 1000 % 60", "(u * 3 + v) % 40 - 20", "(u + 2 * v) % 30 - 15")
RING, NEAR_UNKNOWN, TONE = 3, 2, 45
HEIGHT_LOW, HEIGHT_HIGH, ON_PLANE = 10, 120, 4.0
LEAST_RATIO, MOST_SPREAD, MOST_FRAME = 0.6, 2.0, 0.75
_RING_PLANE = {"tolerance": 2.5, "least": 30}
_SIGNED = "a * (u - 15.5) * z / 500 + b * (v - 11.5) * z / 500 + c * z - d_plane"
_FAULT = f"""case when coalesce(valid_px, 0) = 0 then 'NO_DEPTH' when ratio is null then 'PLANE_FIT_FAILED' when not (ratio >= {LEAST_RATIO} and residual <= {MOST_SPREAD}) then 'PLANE_REJECTED' end"""
_STATE = f"""coalesce(fault, case when coalesce(object_px, 0) = 0 then 'NO_OBJECT' when coalesce(pixels, 0) = 0 then 'EMPTY' when pixels >= {MOST_FRAME * H * W_} then 'NEARLY_FULL' else 'OK' end)"""


def _ring(a, board):
    """The board's border without the markers and what is near them."""
    return a.minus(a.minus(board, a.erode_box(board, RING)), a.dilate(a.where(board, _MARKER), P.ellipse(1)))


def _joined(a, board, objects, unknown, toned):
    """Main object, and the region: with enclosed and near unknown pixels of its
    tone, closed, never on measured board, largest, eroded, on the board."""
    main = a.keep(a.largest(objects))
    enclosed = a.keep(a.both(a.holes(main, 8, None), unknown))
    near = a.minus(a.both(a.dilate(main, P.ellipse(NEAR_UNKNOWN)), unknown), enclosed)
    hybrid = a.closed(a.union(a.union(main, enclosed), toned(main, near)), P.ellipse(1))
    return main, a.both(a.erode(a.largest(a.both(hybrid, a.union(objects, unknown))), P.ellipse(1)), board)


def _hybrid_sql() -> str:
    sql = Sql()
    board = sql.polygons(sql.add("select frame, u, v from fr, grid"), _BOARD_QUAD)
    dz = sql.add(f"select frame, u, v, d, z from (select *, {_RAW} as z from px) where {_VALID}")
    known = sql.both(sql.add(f"select frame, u, v from {dz}"), board)
    ring = _ring(sql, board)
    sql.parts += [f"pt as materialized (select frame as key, v * {W_} + u as id, {', '.join(f'({e})::double as {c}' for c, e in _SPACE.items())} from {ring} join {dz} using (frame, u, v))", *V.planes_sql("pt", V.METRIC, "p", **_RING_PLANE)]
    n = lambda m, c: f"(select frame, count(*) as {c} from {m} group by frame)"
    sql.parts.append(f"gate as materialized (select *, {_FAULT} as fault from (select frame, board_px, valid_px, inliers / n as ratio, residual, a, b, c, d as d_plane from fr left join {n(board, 'board_px')} using (frame) left join {n(known, 'valid_px')} using (frame) left join pplanes on key = frame))")
    high = sql.add(f"select frame, u, v, {_SIGNED} as up from {known} join {dz} using (frame, u, v) join gate using (frame) where fault is null")
    objects, unknown = sql.add(f"select frame, u, v from {high} where up between {HEIGHT_LOW} and {HEIGHT_HIGH}"), sql.minus(board, known)

    def toned(main, near):
        lab = ", ".join(f"{e} as c{i}" for i, e in enumerate(_LAB))
        tone = sql.add(f"select frame, u, v, {lab} from (select * from fr, grid) left join px using (frame, u, v)")
        mid = sql.add(f"select frame, {', '.join(f'median(c{i}) as m{i}' for i in range(3))} from {main} join {tone} using (frame, u, v) group by frame")
        return sql.add(f"select frame, u, v from {near} join {tone} using (frame, u, v) join {mid} using (frame) where sqrt({' + '.join(f'(c{i} - m{i}) * (c{i} - m{i})' for i in range(3))}) <= {TONE}")

    main, out = _joined(sql, board, objects, unknown, toned)
    flat = sql.add(f"select frame, u, v from {high} where abs(up) <= {ON_PLANE}")
    return f"""with recursive {", ".join(sql.parts)},
t as (select * from gate left join {n(main, 'object_px')} using (frame) left join {n(flat, 'background_px')} using (frame) left join {n(unknown, 'unknown_px')} using (frame) left join {n(out, 'pixels')} using (frame)),
e as (select *, {_STATE} as status from t)
select frame, status, coalesce(board_px, 0) as board_px, coalesce(valid_px, 0) as valid_px, round(ratio, 6) as inlier_ratio, round(residual, 6) as residual, case when status = 'OK' then background_px end as background_px, case when status = 'OK' then object_px end as object_px, case when status = 'OK' then coalesce(unknown_px, 0) end as unknown_px, case when status = 'OK' then pixels end as pixels, case when status = 'OK' then round(pixels / object_px, 6) end as to_object from e"""


@query("mor14_hybrid_roi", _hybrid_sql())
def mor14(spark, sf):
    """Region of each frame's board pose: a metric plane voted for by the
    board's ring without its markers, heights over it, unknown depth kept apart
    until what the object encloses or what is near and of its tone is taken in,
    closed, kept off the measured board; a frame that fails has a named fault
    and no figures."""
    t = Tables(spark, sf)
    whole = t.frames.select("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(H - 1).cast("long"))).alias("v")).select("frame", "v", F.lit(0).cast("long").alias("u0"), F.lit(W_ - 1).cast("long").alias("u1"))
    board = t.keep(t.polygons(whole, _BOARD_QUAD))
    dz = written(t.px.withColumn("z", F.expr(_RAW)).where(_VALID).select(*P.PIXEL, "d", "z"), "depths")
    known = t.keep(t.both(t.runs(dz), board))
    at = I.to_pixels(_ring(t, board)).join(dz, P.PIXEL)
    at = written(at.select(F.col("frame").alias("key"), (F.col("v") * W_ + F.col("u")).alias("id"), *[F.expr(e).cast("double").alias(c) for c, e in _SPACE.items()]), "points")
    found = V.planes(at, V.METRIC, **_RING_PLANE).select(F.col("key").alias("frame"), (F.col("inliers") / F.col("n")).alias("ratio"), "residual", "a", "b", "c", F.col("d").alias("d_plane"))
    many = lambda m, c: m.groupBy("frame").agg(F.sum(I.length()).alias(c))
    gate = t.frames.join(many(board, "board_px"), "frame", "left").join(many(known, "valid_px"), "frame", "left").join(found, "frame", "left")
    gate = written(gate.withColumn("fault", F.expr(_FAULT)), "gate")
    high = written(I.to_pixels(known).join(dz, P.PIXEL).join(gate.where("fault is null").drop("ratio", "residual"), "frame").select(*P.PIXEL, F.expr(_SIGNED).alias("up")), "heights")
    objects, unknown = t.keep(t.runs(high.where(F.col("up").between(HEIGHT_LOW, HEIGHT_HIGH)))), t.keep(t.minus(board, known))

    def toned(main, near):
        colour = lambda m: I.to_pixels(m).join(t.px.select(*P.PIXEL, "d"), P.PIXEL, "left").select(*P.PIXEL, *[F.expr(e).alias(f"c{i}") for i, e in enumerate(_LAB)])
        mid = colour(main).groupBy("frame").agg(*[F.median(f"c{i}").alias(f"m{i}") for i in range(3)])
        apart = F.sqrt(sum((F.col(f"c{i}") - F.col(f"m{i}")) * (F.col(f"c{i}") - F.col(f"m{i}")) for i in range(3)))
        return t.runs(colour(near).join(mid, "frame").where(apart <= TONE))

    main, out = _joined(t, board, objects, unknown, toned)
    flat = high.where(F.abs("up") <= ON_PLANE).groupBy("frame").agg(F.count("*").alias("background_px"))
    told = gate
    for m in (many(main, "object_px"), flat, many(unknown, "unknown_px"), many(out, "pixels")):
        told = told.join(m, "frame", "left")
    told = told.withColumn("status", F.expr(_STATE))
    good = lambda c, n: F.when(F.col("status") == "OK", c).alias(n)
    return told.select("frame", "status", F.coalesce("board_px", F.lit(0)).alias("board_px"), F.coalesce("valid_px", F.lit(0)).alias("valid_px"), F.round("ratio", 6).alias("inlier_ratio"), F.round("residual", 6).alias("residual"), good(F.col("background_px"), "background_px"), good(F.col("object_px"), "object_px"), good(F.coalesce("unknown_px", F.lit(0)), "unknown_px"), good(F.col("pixels"), "pixels"), good(F.round(F.col("pixels") / F.col("object_px"), 6), "to_object"))


_DARK = "d < 120000"


def _corner_sql() -> str:
    sql = Sql()
    x = sql.largest(sql.closed(sql.mask(_DARK), P.ellipse(1)))
    corner = lambda name, key: f"min_by(u, ({key}, v, u)) as x{name}, min_by(v, ({key}, v, u)) as y{name}"
    return f"with recursive {', '.join(sql.parts)} select frame, count(*) as area, {corner(0, 'u + v')}, {corner(1, 'v - u')}, {corner(2, '-u - v')}, {corner(3, 'u - v')} from {x} group by frame having count(*) >= 4"


@query("mor26_board_finder", _corner_sql())
def mor26(spark, sf):
    """The largest dark part of each frame and its four corners, the extreme
    places by u + v and v - u; the same corner may stand twice."""
    t = Tables(spark, sf)
    x = I.to_pixels(t.largest(t.closed(t.mask(_DARK), P.ellipse(1))))
    out = [F.count("*").alias("area")]
    for i, key in enumerate(("u + v", "v - u", "-u - v", "u - v")):
        out += [F.min_by(c, F.struct(F.expr(key).alias("k"), "v", "u")).alias(f"{n}{i}") for c, n in (("u", "x"), ("v", "y"))]
    return x.groupBy("frame").agg(*out).where("area >= 4")


def _detector_sql() -> str:
    sql = Sql()
    _, surface = _surface(sql, sql.mask(_ON_BOARD))
    return f"""with recursive {", ".join(sql.parts)},
p as (select frame, x, y, var_pop(px.d / 250000) as score from {surface} m join px using (frame, u, v) join (select u as x, v as y from grid where u % {STRIDE} = 0 and v % {STRIDE} = 0) on u between x and x + {PATCH - 1} and v between y and y + {PATCH - 1} group by all having count(*) >= {PATCH * PATCH // 2}),
t as (select quantile_cont(score, 0.5) as threshold from p where frame % 4 = 0)
select frame, count(score) as patches, round(max(score), 6) as score, case when count(score) = 0 then 'RECHECK' when max(score) > (select threshold from t) then 'NG' else 'OK' end as judgement from fr left join p using (frame) group by frame"""


@query("ext07_production_detector", _detector_sql())
def ext07(spark, sf):
    """Frame to judgement: surface, patches on it, a score of each, and a
    threshold from the scores of the frames kept for validation."""
    t = Tables(spark, sf)
    _, surface = _surface(t, t.mask(_ON_BOARD))
    px = I.to_pixels(surface).join(t.px.select(*P.PIXEL, (F.col("d") / 250000).alias("x_")), P.PIXEL)
    start = lambda c: F.explode(F.expr(f"filter(transform(sequence(0, {PATCH - 1}), i -> {c} - i), x -> x >= 0 and x % {STRIDE} = 0)"))
    scores = px.select("frame", "u", "x_", start("v").alias("y")).select("frame", "y", "x_", start("u").alias("x")).groupBy("frame", "x", "y").agg(F.var_pop("x_").alias("score"), F.count("*").alias("n")).where(F.col("n") >= PATCH * PATCH // 2)
    scores = written(scores.select("frame", "score"), "scores")
    threshold = percentile(scores.where("frame % 4 = 0"), "score", 0.5).first()
    best = t.frames.join(scores, "frame", "left").groupBy("frame").agg(F.count("score").alias("patches"), F.max("score").alias("score"))
    judged = F.when(F.col("patches") == 0, "RECHECK").when(F.col("score") > F.lit(threshold and threshold[0]), "NG").otherwise("OK")
    return best.select("frame", "patches", F.round("score", 6).alias("score"), judged.alias("judgement"))
