"""File sets of captures and of regions: one set of names a sink, written with
a commit, read back and counted."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenspan.operators import intervals as I
from lumenspan.operators import pixels as P
from lumenspan.plans.kernels import H, W_
from lumenspan.plans.masks import _RECT, Sql, Tables, _hybrid_roi, _inspected
from lumenspan.registry import query
from lumenspan.session import scratch
from lumenspan.sources import artifacts, files


def _geometry(a):
    obj, surface, inside = _inspected(a)
    return {"final_depth.npy": (a.mask("true"), None), "object_mask.png": (obj, None), "surface_mask.png": (surface, None), "surface_geometry_overlay.png": (surface, 2), "inspection_mask.png": (inside, None), "inspection_mask_overlay.png": (inside, 2)}


def _rgb(a):
    return {"final_rgb.png": (a.mask("true"), None), "final_ir.png": (a.mask("d > 100000"), 3)}


def _roi(a):
    main = a.keep(a.largest(a.where(a.mask(), _RECT)))
    full = a.keep(a.where(a.filled(a.closed(main, P.ellipse(1)), 4), _RECT))
    return {"depth_object_candidate_mask.png": (a.mask(), None), "depth_object_vote_count.png": (a.mask("`set` or d > 50000"), None), "depth_main_component_mask.png": (main, None), "depth_object_contour_filled.png": (full, None), "inspection_mask.png": (a.erode(full, P.ellipse(1)), None), "inspection_mask_overlay.png": (full, 2)}


def _hybrid(a):
    board, objects = a.where(a.mask("true"), _RECT), a.where(a.mask("`set` and d > 40000"), _RECT)
    unknown = a.where(a.holes(a.mask("true"), 4, None), _RECT)
    return {"board_roi_mask.png": (board, None), "board_background_mask.png": (a.minus(board, objects), None), "depth_object_mask.png": (objects, None), "depth_unknown_mask.png": (unknown, None), "hybrid_inspection_mask.png": (_hybrid_roi(a), None), "hybrid_roi_diagnostics.json": (objects, None)}


#: Sinks: their files' masks by name; an overlay or an infrared image only in
#: frames whose number the second value divides.
SINKS = {
    "snk15_geometry_artifacts": ("Depth and masks of an accepted capture, overlays where it has colour.", _geometry),
    "snk16_rgb_artifacts": ("The image of an accepted capture, infrared where there is one.", _rgb),
    "snk19_roi_evidence": ("Candidates, votes, main component, filled contour and mask of a depth region.", _roi),
    "snk20_hybrid_evidence": ("Board, background, object and unknown masks of a hybrid region, and its figures.", _hybrid),
}


def _content(name: str, v: np.ndarray, u0: np.ndarray, u1: np.ndarray, d: np.ndarray) -> bytes:
    """A file's bytes from its runs of set pixels, which are pixels with their
    depths where the file holds depths."""
    if name.endswith(".json"):
        return json.dumps({"object_pixels": int((u1 - u0 + 1).sum()), "height": H, "width": W_}, indent=2).encode()
    if name.endswith(".npy"):
        depth, out = np.zeros((H, W_), np.float32), io.BytesIO()
        depth[v, u0] = d
        np.save(out, depth)
        return out.getvalue()
    colour = "overlay" in name or "rgb" in name
    image = np.zeros((H, W_, 3) if colour else (H, W_, 1), np.uint8)
    for row, lo, hi in zip(v.tolist(), u0.tolist(), u1.tolist(), strict=True):
        image[row, lo : hi + 1] = 255
    return files.png_bytes(image)


def _pixels(name: str, content: bytes) -> int:
    if name.endswith(".json"):
        return json.loads(content)["object_pixels"]
    image = np.load(io.BytesIO(content)) if name.endswith(".npy") else files.png_pixels(content)
    return int((image.reshape(H, W_, -1) > 0).any(axis=2).sum())


def _images(t, masks: dict):
    """(frame, name, content): every file of every frame, empty masks too.

    A file is made from its runs, not its pixels, and many files in one step of
    a Python worker.
    """
    rows = None
    for name, (runs, each) in masks.items():
        if name.endswith(".npy"):
            at = I.to_pixels(runs).join(t.px.select(*P.PIXEL, "d"), P.PIXEL, "left")
            marks = at.select("frame", F.struct("v", F.col("u").alias("u0"), F.col("u").alias("u1"), F.coalesce(F.col("d").cast("double"), F.lit(0.0)).alias("d")).alias("run"))
        else:
            marks = runs.select("frame", F.struct("v", "u0", "u1", F.lit(0.0).alias("d")).alias("run"))
        every = t.frames.select("frame", F.lit(None).cast(marks.schema["run"].dataType).alias("run"))
        own = marks.unionByName(every).where(F.lit(True) if each is None else F.col("frame") % each == 0).select("frame", F.lit(name).alias("name"), "run")
        rows = own if rows is None else rows.unionByName(own)

    @F.pandas_udf("binary")
    def content(name: pd.Series, v: pd.Series, u0: pd.Series, u1: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_content(*x) for x in zip(name, v, u0, u1, d, strict=True)], dtype=object)

    listed = I.dealt(rows).groupBy("frame", "name").agg(F.collect_list("run").alias("r"))
    return listed.select("frame", "name", content("name", *[F.col(f"r.{c}") for c in ("v", "u0", "u1", "d")]).alias("content"))


def _register(key: str, doc: str, masks) -> None:
    sql = Sql()
    parts = [f"select frame, '{name}' as name, (select count(*) from {m} m where m.frame = fr.frame) as pixels from fr" + (f" where frame % {each} = 0" if each else "") for name, (m, each) in masks(sql).items()]

    def run(spark, sf):
        t, out = Tables(spark, sf), scratch(spark, key)
        artifacts.write(_images(t, masks(t)), out)
        count = F.pandas_udf(lambda name, content: pd.Series([_pixels(n, bytes(c)) for n, c in zip(name, content, strict=True)]), "long")
        return artifacts.read(spark, out).select("frame", "name", count("name", "content").alias("pixels"))

    run.__doc__ = doc
    query(key, f"with recursive {', '.join(sql.parts)} {' union all '.join(parts)}")(run)


for _key, (_doc, _masks) in SINKS.items():
    _register(_key, _doc, _masks)
