"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic).  Raking scales what
is kept of each cell until the kept tokens' marginals meet the targets; a cell
never keeps more than it has, and what a full cell cannot give the free cells
of its level take on in the rounds that follow.  Rounds go on until the largest
gap of a level stops shrinking; targets that contradict each other leave one,
which is reported.  A document is then kept with its
cell's kept share.  Where a level's target asks for more tokens than the level
has, the kept share of the whole (``rate``) is lowered until it does not, so the
drawn mixture stays calibrated.  DataFrame functions only: no Python runs on
the executors.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.llm.common import materialize

#: Rounds of raking between two looks at the gaps; a round meets each of the
#: marginals in turn.  The plan is cut there.
CUT_ROUNDS = 10
#: A gap is closed below this, and stops shrinking where a look finds it less
#: than one part in ``STILL`` smaller.
CLOSED, STILL = 1e-10, 50
#: Gap of a level, relative to its target, above which targets count as missed.
TOLERANCE = 0.01
#: Rounds that the SQL takes, enough for either end.
SQL_ROUNDS = 240
#: Share of the tokens that is to be kept, where the targets allow it.
RATE = 0.5
#: Target of a level: its own share to this power, over all levels.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Up to so many cells, raking runs in one task; beyond, by grouped sums.
ONE_TASK_CELLS = 100_000
WORD = r"[^ \t\n\x0B\f\r]+"
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A topic by surface form, the first that fits."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.rlike("(?i)(general public license|apache license|mit license|creative commons|cc by)"), "legal")
        .when(t.rlike(r"([0-9]{1,3}\.){3}[0-9]{1,3}|[a-z0-9]@[a-z0-9]|token = "), "contact")
        .when(t.contains(" | "), "table")
        .when(t.rlike(r"!!|\*\*\*|###|%%%|&&&"), "noise")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _level_targets(cells: DataFrame, dim: str, power: float, given: dict[str, float] | None, total: float) -> tuple[DataFrame, float]:
    """(level, target share) of a dimension, and the largest rate at which no
    level needs more tokens than it has."""
    levels = cells.groupBy(dim).agg(F.sum("n").alias("has"))
    named = F.lit(None).cast("double")
    if given:
        named = F.create_map(*[F.lit(x) for k, v in given.items() for x in (str(k), float(v))])[F.col(dim)]
    own = F.pow(F.col("has") / F.lit(total), F.lit(float(power)))
    levels = materialize(levels.withColumn("named", named).withColumn("own", F.when(F.col("named").isNull(), own)), "levels")
    sums = levels.agg(F.sum("named").alias("named"), F.sum("own").alias("own")).first()
    fixed, free = float(sums["named"] or 0.0), float(sums["own"] or 0.0)
    # named levels that the table lacks leave their share to the others
    rest = max(0.0, 1.0 - fixed) if free else 0.0
    share = F.coalesce("named", F.col("own") * F.lit(rest / free if free else 0.0)) / F.lit(fixed + rest or 1.0)
    levels = levels.withColumn("target", share)
    feasible = levels.where("target > 0").agg(F.min(F.col("has") / (F.col("target") * F.lit(total)))).first()[0]
    return levels.select(dim, F.col("target").alias(f"t_{dim}")), float(feasible if feasible is not None else 1.0)


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, one_task: bool = True, *, rate: float = RATE, targets: dict[str, dict[str, float]] | None = None) -> tuple[DataFrame, float, float]:
    """``cells`` (one column a dimension, n > 0) with ``m``, the tokens to be
    kept of each, and ``t_<dimension>``, the target share of its level; the rate
    that was possible; and the largest gap of a level, relative to its target.
    The marginals of m follow the targets: those given (level to share), else
    the level's share to the dimension's power, normalised.  0 <= m <= n.
    """
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    if not total:
        return cells.withColumns({"m": F.lit(0.0), **{f"t_{d}": F.lit(0.0) for d in powers}}), rate, 0.0
    out = cells
    for d, p in powers.items():
        levels, feasible = _level_targets(cells, d, p, (targets or {}).get(d), total)
        rate = min(rate, feasible)
        out = out.join(F.broadcast(levels) if one_task else levels, d)  # no more levels than cells
    out = materialize(out.withColumn("m", F.lit(rate) * F.col("n")), "raked")
    gap = float("inf")
    while True:
        out = out.coalesce(1) if one_task else out
        for _ in range(CUT_ROUNDS):
            for d in powers:
                if one_task:
                    out = out.withColumn("_sum", F.sum("m").over(W.partitionBy(d)))
                else:
                    out = out.join(materialize(out.groupBy(d).agg(F.sum("m").alias("_sum")), "sums"), d)
                fitted = F.when(F.col("_sum") > 0, F.col("m") * (F.col(f"t_{d}") * F.lit(rate * total) / F.col("_sum"))).otherwise(F.lit(0.0))
                out = out.withColumn("m", F.least(F.col("n").cast("double"), fitted)).drop("_sum")
                out = out if one_task else materialize(out, "raked")
        out = materialize(out, "raked")
        before, gap = gap, float(gaps(out, list(powers)).agg(F.max(F.abs("gap"))).first()[0] or 0.0)
        if gap < CLOSED or gap > before * (1 - 1 / STILL):
            return out, rate, gap


def gaps(raked: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, level, target, expected, gap) of raked cells: the share of
    the kept tokens that each level is to have and will have, and how far that
    is off, relative to the target."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("level"), F.col(f"t_{d}").alias("target")) for d in dims])).alias("at")
    sums = raked.select("m", each).groupBy("at.dimension", "at.level").agg(F.first("at.target").alias("target"), F.sum("m").alias("m"))
    expected = F.col("m") / F.greatest(F.sum("m").over(W.partitionBy("dimension")), F.lit(1e-300))
    gap = F.when(F.col("target") > 0, F.col("expected") / F.col("target") - 1).otherwise(F.when(F.col("expected") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return sums.select("dimension", "level", "target", expected.alias("expected")).withColumn("gap", gap)


def report(raked: DataFrame, gap: float, dims: list[str], tolerance: float, strict: bool) -> None:
    """Say which levels miss their targets by more than ``tolerance``, as a
    warning or, if ``strict``, as an error."""
    if gap <= tolerance:
        return
    worst = gaps(raked, dims).orderBy(F.abs("gap").desc(), "dimension", "level").limit(5).collect()
    named = ", ".join(f"{r['dimension']} {r['level']}: {r['expected']:.4f} instead of {r['target']:.4f}" for r in worst)
    text = f"targets that cannot be met together: the largest gap is {gap:.1%} of a target ({named})"
    if strict:
        raise ValueError(text)
    warnings.warn(text, RuntimeWarning, stacklevel=3)


def mix(docs: DataFrame, *, keep: list[str] | None = None, rate: float = RATE, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, strict: bool = False, seed: int = 17) -> DataFrame:
    """Every row of docs (its columns ``keep``, all if None) as struct ``row`` with source, lang, topic, n_tokens,
    weight (kept share of its cell's tokens over that of all), prob (kept share
    of its cell's tokens, 1 at most) and keep (a hash of doc_id and seed lies
    below prob; rows that repeat a doc_id share its fate).

    ``targets`` gives shares of the kept tokens by dimension and level; levels
    not named there share what is left by ``powers``.  Where targets contradict
    each other, so that a level's expected share stays off by more than
    ``tolerance`` of its target, the levels are named in a warning, or in an
    error if ``strict``.  NULL source or language
    is a level of its own, ``(none)``.  Rows without tokens take weight 1 and
    the rate itself as prob: they cost nothing.  A NULL doc_id counts as the id
    ''.  An empty table gives no row.  Columns of docs may bear any name.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        topic_of(F.col("text").cast("string")).alias("topic"),
        token_count(F.col("text").cast("string")).alias("n_tokens"),
    )
    rows = materialize(rows, "annotated")  # texts are searched once
    dims = list(powers)
    cells = materialize(rows.groupBy(*dims).agg(F.sum("n_tokens").alias("n")).where("n > 0"), "cells")
    few = cells.count() <= ONE_TASK_CELLS
    raked, rate, gap = rake(cells, powers, few, rate=rate, targets=targets)
    report(raked, gap, dims, tolerance, strict)
    shares = materialize(raked.select(*dims, (F.col("m") / F.col("n")).alias("share")), "shares")
    out = rows.join(F.broadcast(shares) if few else shares, dims, "left")
    share = F.when(F.col("n_tokens") > 0, F.col("share")).otherwise(F.lit(rate))
    out = out.withColumns({"weight": F.round(share / F.lit(rate), 6), "prob": F.round(share, 6)}).drop("share")
    return out.withColumn("keep", draw(F.col("row.doc_id"), seed) < F.col("prob"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from md5, which SQL engines share."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def oracle_sql(rate: float = RATE, powers: dict[str, float] = POWERS, rounds: int = SQL_ROUNDS, seed: int = 17) -> str:
    levels = ", ".join(f"sum(n) over (partition by {d}) as h_{d}, count(*) over (partition by {d}) as c_{d}" for d in powers)
    own = ", ".join(f"power(h_{d} / total, {p}) as u_{d}" for d, p in powers.items())
    normal = ", ".join(f"u_{d} / sum(u_{d} / c_{d}) over () as t_{d}" for d in powers)
    feasible = ", ".join(f"min(h_{d} / (t_{d} * total)) over ()" for d in powers)
    step = "select * from r where i < " + str(rounds)
    for d in powers:
        step = f"select * replace (least(n, m * (t_{d} * rate * total / sum(m) over (partition by {d}))) as m) from ({step})"
    return f"""
with recursive rows_ as (
  select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang,
    case when regexp_matches(coalesce(text, ''), '(?i)(general public license|apache license|mit license|creative commons|cc by)') then 'legal'
         when regexp_matches(coalesce(text, ''), '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}|[a-z0-9]@[a-z0-9]|token = ') then 'contact'
         when contains(coalesce(text, ''), ' | ') then 'table'
         when regexp_matches(coalesce(text, ''), '!!|\\*\\*\\*|###|%%%|&&&') then 'noise'
         else 'prose' end as topic,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::bigint as n_tokens
  from documents),
cells as (select source, lang, topic, sum(n_tokens)::double as n from rows_ group by all having sum(n_tokens) > 0),
s as (select *, sum(n) over () as total, {levels} from cells),
u as (select *, {own} from s),
t as (select *, {normal} from u),
f as (select *, least({rate}::double, {feasible}) as rate from t),
r as (select *, rate * n as m, 0 as i from f union all select * replace (i + 1 as i) from ({step})),
j as (select doc_id, source, lang, topic, n_tokens, (select any_value(rate) from f) as rate,
    case when n_tokens > 0 then m / n else (select any_value(rate) from f) end as share
  from rows_ left join (select * from r where i = {rounds}) using (source, lang, topic)),
p as (select *, round(share / rate, 6) as weight, round(share, 6) as prob from j)
select doc_id, source, lang, topic, n_tokens, weight, prob,
  (('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0) < prob as keep
from p
"""
