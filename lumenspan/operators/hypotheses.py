"""Planes of groups of points by votes on sampled hypotheses.

Points are rows (key, id, x, y, z).  A seeded order of each group, by a hash of
its ids, gives a pool of about ``POOL`` points; arithmetic on the round's number
names three of the pool, and a plane through them is solved in columns.  All
points of the table then vote on all planes of their group in one aggregate,
which is combined before the shuffle, so a group of any size is worked on by as
many tasks as hold its rows.  The plane with most votes is fitted again to its
voters by sums.  Every formula is text that Spark and other SQL engines read
alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.session import written

POOL, ROUNDS, SEED = 512, 160, 42
#: Columns of a plane.
PLANE = ["a", "b", "c", "d"]

#: Three different places 0 .. m - 1 of the pool for round k.
FIRST = f"((k * 7919 + {SEED}) * 31 % 1000003) % m"
SECOND = f"(({FIRST}) + 1 + ((k * 104729 + {SEED}) * 17 % 1000003) % (m - 1)) % m"
_STEP = f"((k * 15485863 + {SEED}) * 13 % 1000003) % (m - 2)"
#: The third counts over the two others.
THIRD = f"({_STEP}) + case when ({_STEP}) >= least(i, j) then 1 else 0 end + case when ({_STEP}) + case when ({_STEP}) >= least(i, j) then 1 else 0 end >= greatest(i, j) then 1 else 0 end"


@dataclass(frozen=True)
class Model:
    """Formulas of a plane: through three points p, q, r; how far a point is
    off; the sums that fit it, and the fit by the sums."""

    through: dict[str, str]
    real: str
    off: str
    sums: dict[str, str]
    steps: list[dict[str, str]]


def _det(a: str, b: str, c: str, d: str, e: str, f: str, g: str, h: str, i: str) -> str:
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_T = [f"(1 / {p}.z)" for p in "pqr"]
_MAIN = _det("p.x", "p.y", "1", "q.x", "q.y", "1", "r.x", "r.y", "1")
_NORMAL = _det("sxx", "sxy", "sx", "sxy", "syy", "sy", "sx", "sy", "n")
#: 1 / z is linear in x and y, which lie between -1 and 1.
INVERSE = Model(
    through={
        "a": _det(_T[0], "p.y", "1", _T[1], "q.y", "1", _T[2], "r.y", "1") + f" / {_MAIN}",
        "b": _det("p.x", _T[0], "1", "q.x", _T[1], "1", "r.x", _T[2], "1") + f" / {_MAIN}",
        "c": _det("p.x", "p.y", _T[0], "q.x", "q.y", _T[1], "r.x", "r.y", _T[2]) + f" / {_MAIN}",
        "d": "0.0",
    },
    real=f"abs({_MAIN}) > 1e-9",
    off="case when a * x + b * y + c > 1e-9 then abs(1 / (a * x + b * y + c) - z) else 1e300 end",
    sums={"sxx": "x * x", "sxy": "x * y", "syy": "y * y", "sx": "x", "sy": "y", "sxt": "x / z", "syt": "y / z", "st": "1 / z"},
    steps=[{
        "a": _det("sxt", "sxy", "sx", "syt", "syy", "sy", "st", "sy", "n") + f" / nullif({_NORMAL}, 0)",
        "b": _det("sxx", "sxt", "sx", "sxy", "syt", "sy", "sx", "st", "n") + f" / nullif({_NORMAL}, 0)",
        "c": _det("sxx", "sxy", "sxt", "sxy", "syy", "syt", "sx", "sy", "st") + f" / nullif({_NORMAL}, 0)",
        "d": "0.0",
    }],
)

_U = {c: f"(q.{c} - p.{c})" for c in "xyz"}
_V = {c: f"(r.{c} - p.{c})" for c in "xyz"}
_CROSS = {"a": f"({_U['y']} * {_V['z']} - {_U['z']} * {_V['y']})", "b": f"({_U['z']} * {_V['x']} - {_U['x']} * {_V['z']})", "c": f"({_U['x']} * {_V['y']} - {_U['y']} * {_V['x']})"}
_SIZE = f"sqrt({_CROSS['a']} * {_CROSS['a']} + {_CROSS['b']} * {_CROSS['b']} + {_CROSS['c']} * {_CROSS['c']})"
#: Points in space; the fit is the least axis of their spread, in closed form:
#: the least root of the spread's characteristic polynomial by a cosine, and
#: the longest product of two rows of what is left.
METRIC = Model(
    through={c: f"{e} / {_SIZE}" for c, e in _CROSS.items()} | {"d": "(" + " + ".join(f"{_CROSS[c]} / {_SIZE} * p.{w}" for c, w in zip("abc", "xyz", strict=True)) + ")"},
    real=f"{_SIZE} > 1e-12",
    off="abs(a * x + b * y + c * z - d)",
    sums={"sx": "x", "sy": "y", "sz": "z", "sxx": "x * x", "sxy": "x * y", "sxz": "x * z", "syy": "y * y", "syz": "y * z", "szz": "z * z"},
    steps=[
        {"mx": "sx / n", "my": "sy / n", "mz": "sz / n"},
        {"e": "sxx / n - mx * mx", "f": "sxy / n - mx * my", "g": "sxz / n - mx * mz", "h": "syy / n - my * my", "i": "syz / n - my * mz", "j": "szz / n - mz * mz"},
        {"mean": "(e + h + j) / 3"},
        {"size": "sqrt(greatest(((e - mean) * (e - mean) + (h - mean) * (h - mean) + (j - mean) * (j - mean) + 2 * (f * f + g * g + i * i)) / 6, 1e-300))"},
        {"turn": _det("(e - mean)", "f", "g", "f", "(h - mean)", "i", "g", "i", "(j - mean)") + " / (2 * size * size * size)"},
        {"root": "mean + 2 * size * cos(acos(greatest(-1.0, least(1.0, turn))) / 3 + 2.0943951023931953)"},
        {"ux": "f * i - g * (h - root)", "uy": "g * f - (e - root) * i", "uz": "(e - root) * (h - root) - f * f", "vx": "f * (j - root) - g * i", "vy": "g * g - (e - root) * (j - root)", "vz": "(e - root) * i - f * g", "wx": "(h - root) * (j - root) - i * i", "wy": "i * g - f * (j - root)", "wz": "f * i - (h - root) * g"},
        {"lu": "ux * ux + uy * uy + uz * uz", "lv": "vx * vx + vy * vy + vz * vz", "lw": "wx * wx + wy * wy + wz * wz"},
        {c: f"case when lu >= lv and lu >= lw then u{c} when lv >= lw then v{c} else w{c} end" for c in "xyz"},
        {"len_": "case when z > 0 then -sqrt(x * x + y * y + z * z) else sqrt(x * x + y * y + z * z) end"},  # the normal looks at the camera
        {"a": "x / nullif(len_, 0)", "b": "y / nullif(len_, 0)", "c": "z / nullif(len_, 0)"},
        {"d": "a * mx + b * my + c * mz"},
    ],
)

_UNIT = "conv(substr(h, 1, 8), 16, 10) / 4294967296.0"


def planes(points: DataFrame, model: Model, *, tolerance: float, least: int, rounds: int = ROUNDS, pool: int = POOL) -> DataFrame:
    """(key, n, a, b, c, d, inliers, residual) of each group with ``least``
    points and voters at least: the plane fitted to the voters of the best
    hypothesis (ties: the first), how many points it has within ``tolerance``,
    and their median distance.  ``points`` is read several times."""
    many = points.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(3, least))
    seeded = points.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(SEED)), "key", "id").cast("binary")))
    chosen = seeded.join(many, "key").where(F.expr(_UNIT) < pool / F.col("n"))
    # about ``pool`` points of a group
    pooled = chosen.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("h", "id", "x", "y", "z"))).alias("pool"), F.first("n").alias("n"))
    # three of the pool are picked inside the group's row, so no row of a round carries the pool
    drawn = pooled.withColumn("m", F.size("pool")).where("m >= 3").withColumn("drawn", F.expr(f"transform(sequence(0L, {rounds - 1}L), k -> named_struct('k', k, 'i', {FIRST}, 'j', {SECOND}))"))
    picked = ", ".join(f"'{p}', get(pool, cast({e} as int))" for p, e in (("p", "w.i"), ("q", "w.j"), ("r", re.sub(r"\b([ijk])\b", r"w.\1", THIRD))))
    rows = drawn.select("key", F.explode(F.expr(f"transform(drawn, w -> named_struct('k', w.k, {picked}))")).alias("w")).select("key", "w.*").where(model.real)
    tried = written(rows.select("key", "k", *[F.expr(e).cast("double").alias(c) for c, e in model.through.items()]), "hypotheses")
    near = F.expr(model.off) <= tolerance
    votes = points.join(tried, "key").where(near).groupBy("key", "k").agg(F.count("*").alias("votes"))
    top = votes.groupBy("key").agg(F.max(F.struct("votes", (-F.col("k")).alias("k"))).alias("t")).where(F.col("t.votes") >= least).select("key", (-F.col("t.k")).alias("k"))
    best = tried.join(top, ["key", "k"], "left_semi").drop("k")
    fit = points.join(best, "key").where(near).groupBy("key").agg(F.count("*").cast("double").alias("n"), *[F.sum(F.expr(e)).alias(c) for c, e in model.sums.items()])
    for step in model.steps:
        fit = fit.withColumns({c: F.expr(e) for c, e in step.items()})
    fitted = written(fit.select("key", *PLANE), "planes")
    off = F.expr(model.off)
    told = points.join(fitted, "key").withColumn("_off", off).groupBy("key", *PLANE).agg(F.count("*").alias("n"), F.count_if(F.col("_off") <= tolerance).alias("inliers"), F.percentile(F.when(F.col("_off") <= tolerance, F.col("_off")), 0.5).alias("residual"))
    return told.select("key", "n", *PLANE, "inliers", "residual")


def sequential(points: DataFrame, model: Model, limit: int, *, tolerance: float, least: int, rounds: int = ROUNDS) -> DataFrame:
    """Up to ``limit`` planes of each group (column ``no`` from 1), each among
    the points that lie within ``tolerance`` of none before."""
    out, left = None, points
    for no in range(1, limit + 1):
        found = written(planes(left, model, tolerance=tolerance, least=least, rounds=rounds).withColumn("no", F.lit(no)), "found")
        out = found if out is None else out.unionByName(found)
        if no < limit:
            rest = left.join(found.select("key", *PLANE), "key")  # groups without a plane have no more
            left = written(rest.where(F.expr(model.off) > tolerance).select(*points.columns), "left")
    return out


def sequential_sql(points: str, model: Model, prefix: str, limit: int, **options) -> list[str]:
    """The same as ``sequential``: the last expression is ``<prefix>all``."""
    out, left = [], points
    for no in range(1, limit + 1):
        out += planes_sql(left, model, f"{prefix}{no}", **options)
        out.append(f"{prefix}left{no} as materialized (select p.* from {left} p join {prefix}{no}planes using (key) where {model.off} > {options['tolerance']})")
        left = f"{prefix}left{no}"
    return [*out, f"{prefix}all as ({' union all '.join(f'select *, {no} as no from {prefix}{no}planes' for no in range(1, limit + 1))})"]


def planes_sql(points: str, model: Model, prefix: str, *, tolerance: float, least: int, rounds: int = ROUNDS, pool: int = POOL) -> list[str]:
    """The same as common table expressions; the last, ``<prefix>planes``, has
    the columns of ``planes``, and ``points`` names a relation."""
    x = prefix
    unit = "('0x' || substr(h, 1, 8))::bigint / 4294967296.0"
    out = [
        f"{x}n as (select key, count(*) as n from {points} group by key having count(*) >= {max(3, least)})",
        f"{x}pool as materialized (select key, x, y, z, row_number() over (partition by key order by h, id, x, y, z) - 1 as place, count(*) over (partition by key) as m from (select p.*, n, md5('{SEED}:' || key::varchar || ':' || id::varchar) as h from {points} p join {x}n using (key)) where {unit} < {pool} / n)",
        f"{x}rounds as materialized (select key, k, m, i, j, {THIRD} as t from (select key, k, m, {FIRST} as i, {SECOND} as j from (select distinct key, m from {x}pool where m >= 3), (select unnest(range({rounds})) as k)))",
        f"{x}tried as materialized (select key, k, {', '.join(f'{e} as {c}' for c, e in model.through.items())} from (select o.key, o.k, p, q, r from {x}rounds o join {x}pool p on p.key = o.key and p.place = o.i join {x}pool q on q.key = o.key and q.place = o.j join {x}pool r on r.key = o.key and r.place = o.t) where {model.real})",
        f"{x}top as (select key, min_by(k, (-votes, k)) as k from (select key, k, count(*) as votes from {points} join {x}tried using (key) where {model.off} <= {tolerance} group by key, k) group by key having max(votes) >= {least})",
        f"{x}fit0 as (select key, count(*)::double as n, {', '.join(f'sum({e}) as {c}' for c, e in model.sums.items())} from {points} join {x}tried using (key) join {x}top using (key, k) where {model.off} <= {tolerance} group by key)",
    ]
    last = f"{x}fit0"
    for i, step in enumerate(model.steps, 1):
        kept = ", ".join(f"{e} as {c}" for c, e in step.items())
        out.append(f"{x}fit{i} as (select {kept}, {last}.* from {last})")
        last = f"{x}fit{i}"
    out.append(f"{x}planes as (select key, n, a, b, c, d, count(*) filter (off <= {tolerance}) as inliers, quantile_cont(off, 0.5) filter (off <= {tolerance}) as residual from (select key, f.a, f.b, f.c, f.d, count(*) over (partition by key) as n, {model.off} as off from {points} join (select key, a, b, c, d from {last}) f using (key)) group by all)")
    return out
