"""Recorded files as DataFrames: images, manifests, point clouds, JSON, arrays.
Spark lists and reads the files; a column function or a small decoder does the rest."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
INFERENCE_SUFFIXES = ("jpg", "jpeg", "png", "bmp")
MANIFEST_V1 = ("path", "split", "label", "session", "regions", "material", "view", "notes")
MANIFEST_V2 = ("path", "split", "label", "session", "mask", "source_run", "plane", "material", "view", "notes")
POSE_SCHEMA = "schema_version string, input_ply string, planes array<struct<plane_name:string,dominant:boolean,points_count:int,roll_deg:double,pitch_deg:double>>"


def image_files(spark: SparkSession, root: str, suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """(path, modificationTime, length, content) below root, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return with_suffix(files, suffixes).orderBy("path")


def with_suffix(listing: DataFrame, suffixes) -> DataFrame:
    """Files of a listing by the ending of their path, whatever its case."""
    return listing.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))


def first_occurrences(paths: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, where it stands first; the order of the rest is kept."""
    k = F.row_number().over(W.partitionBy(key).orderBy(order))
    return paths.withColumn("_k", k).where("_k = 1").drop("_k")


def png_pixels(data: bytes) -> np.ndarray:
    """(h, w, channels) of an 8 or 16-bit PNG without interlace or palette."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += size + 12
    w, h, depth, colour, _, _, interlace = head
    if depth not in (8, 16) or colour not in (0, 2, 4, 6) or interlace:
        raise ValueError("unsupported PNG")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = n * depth // 8
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    last = np.zeros(w * step, np.int64)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + last) % 256
        elif kind:
            for x in range(len(line)):
                a = line[x - step] if x >= step else 0
                c = last[x - step] if x >= step else 0
                b = last[x]
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    e = a + b - c
                    p = a if abs(e - a) <= abs(e - b) and abs(e - a) <= abs(e - c) else b if abs(e - b) <= abs(e - c) else c
                line[x] = (line[x] + p) % 256
        last = line
        out[y] = line
    return (out.view(">u2") if depth == 16 else out).reshape(h, w, n)


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG of (h, w) or (h, w, 3) bytes."""
    p = pixels[:, :, None] if pixels.ndim == 2 else pixels
    h, w, n = p.shape
    raw = b"".join(b"\0" + p[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if n == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_images(files: DataFrame) -> DataFrame:
    """path, height, width, channels, pixels (row by row) and error of PNG
    files: a file that cannot be read is a row with an error and no pixels."""

    def one(content: bytes | None) -> tuple:
        try:
            got = png_pixels(bytes(content or b""))
        except (ValueError, TypeError, IndexError, struct.error, zlib.error) as e:
            return None, None, None, None, f"{type(e).__name__}: {e}"
        return *got.shape, np.ascontiguousarray(got).tobytes(), None

    @F.pandas_udf("struct<height:int,width:int,channels:int,pixels:binary,error:string>")
    def decode(content: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([one(x) for x in content], columns=["height", "width", "channels", "pixels", "error"])
        return out.astype({c: "Int32" for c in ("height", "width", "channels")})

    return files.select("path", decode("content").alias("image")).select("path", "image.*")


def manifest(spark: SparkSession, path: str, columns=MANIFEST_V1) -> DataFrame:
    """All columns as text; a byte-order mark in front of the header is no
    part of it, since columns are taken by position."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=True)


def manifest_split(rows: DataFrame, split: str) -> DataFrame:
    """Rows of a split; none at all is an error when the result is read."""
    some = rows.agg(F.max(F.when(F.col("split") == split, True)).alias("_some"))
    checked = some.select(F.when(F.col("_some").isNull(), F.raise_error(F.lit(f"no rows of split {split}"))).otherwise(True).alias("_ok"))
    return rows.where(F.col("split") == split).crossJoin(F.broadcast(checked)).where("_ok").drop("_ok")


def manifest_paths(rows: DataFrame, split: str, root: str) -> DataFrame:
    """Absolute paths of a split; train and val hold normal images only."""
    bad = F.lit(split in ("train", "val")) & (F.col("label") != "normal")
    path = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "path"))
    return manifest_split(rows, split).select(F.when(bad, F.raise_error(F.lit("only normal images may be trained on"))).otherwise(path).alias("path"))


def validation_entries(rows: DataFrame, root: str) -> DataFrame:
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    path = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "path"))
    extra = [blank(F.col(c)).alias(c) for c in ("mask", "regions") if c in rows.columns]
    return rows.where("split = 'val' and label = 'normal'").select(path.alias("path"), *extra)


def ply_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, x, y, z, red, green, blue) of ASCII point clouds; rows with
    too few numbers are skipped."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return ply_from_text(text)


def ply_from_text(files: DataFrame) -> DataFrame:
    """(path, value) with whole files as text to points."""
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    t = files.select("path", lines.alias("lines")).withColumn("end", F.array_position("lines", "end_header"))
    vertex = F.filter(F.slice("lines", 1, F.col("end").cast("int")), lambda l: l.startswith("property") & ~l.startswith("property list"))
    t = t.withColumn("names", F.transform(vertex, lambda l: F.element_at(F.split(l, r"\s+"), -1)))
    count = F.regexp_extract(F.array_join(F.slice("lines", 1, F.col("end").cast("int")), "\n"), r"element vertex (\d+)", 1).cast("int")
    t = t.withColumn("rows", F.slice("lines", F.col("end").cast("int") + 1, count))
    t = t.where("end > 0").select("path", "names", F.posexplode("rows").alias("pos", "row"))
    t = t.withColumn("v", F.split(F.trim("row"), r"\s+"))
    get = lambda n, k: F.try_element_at("v", F.array_position("names", n).cast("int")).try_cast(k)
    colour = [F.when(F.array_contains("names", c), get(c, "int")).alias(c) for c in ("red", "green", "blue")]
    return t.where("size(v) >= 3 and size(v) >= size(names)").select("path", "pos", *[get(c, "double").alias(c) for c in "xyz"], *colour)


def ply_headers(files: DataFrame, most: int = 256) -> DataFrame:
    """(path, valid, has_color, has_normals) from the first lines."""
    head = F.slice(F.split(F.regexp_replace("value", "\r", ""), "\n"), 1, most)
    t = files.select("path", head.alias("h")).withColumn("end", F.array_position("h", "end_header"))
    has = lambda n: F.exists("h", lambda l: l.rlike(rf"^property \S+ {n}$"))
    ascii_ = F.exists("h", lambda l: l.startswith("format ascii"))
    return t.select("path", ((F.col("end") > 0) & ascii_ & has("x") & has("y") & has("z")).alias("valid"), (has("red") & has("green") & has("blue")).alias("has_color"), (has("nx") & has("ny") & has("nz")).alias("has_normals"))


def poses(json: Column) -> Column:
    """A pose document; ``planes`` is NULL where the text is no such JSON."""
    return F.from_json(json, POSE_SCHEMA)


def intrinsics(doc: Column) -> Column:
    """fx, fy, cx, cy, possibly nested; NULL unless all are finite and the
    focal lengths positive."""
    get = lambda k: F.coalesce(F.get_json_object(doc, f"$.color_intrinsics.{k}"), F.get_json_object(doc, f"$.{k}")).try_cast("double")
    v = {k: get(k) for k in ("fx", "fy", "cx", "cy")}
    ok = (v["fx"] > 0) & (v["fy"] > 0)
    for x in v.values():
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(ok, F.struct(*[x.alias(k) for k, x in v.items()]))


def axis_contract(doc: Column) -> Column:
    """A missing contract is unverified."""
    return F.struct(F.coalesce(F.get_json_object(doc, "$.verified").cast("boolean"), F.lit(False)).alias("verified"), F.coalesce(F.get_json_object(doc, "$.roll_sign").try_cast("int"), F.lit(1)).alias("roll_sign"))


def regions(doc: Column) -> Column:
    return F.from_json(F.get_json_object(doc, "$.regions"), "array<struct<x1:int,y1:int,x2:int,y2:int>>")


def npy_values(files: DataFrame) -> DataFrame:
    """(path, v, u, value) of two-dimensional .npy files."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                v, u = np.indices(a.shape)
                yield pd.DataFrame({"path": path, "v": v.ravel(), "u": u.ravel(), "value": a.astype(float).ravel()})

    return files.select("path", "content").mapInPandas(run, "path string, v long, u long, value double")


def latest(files: DataFrame, *keys: str) -> DataFrame:
    """The newest file (of each key); the later path wins a tie."""
    return files.groupBy(*keys).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
