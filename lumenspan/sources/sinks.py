"""Writers: fixed columns and formats; Spark's commit protocol makes each
write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.text import fixed
from lumenspan.sources.files import MANIFEST_V1


def write_manifest(rows: DataFrame, path: str, columns=MANIFEST_V1) -> None:
    """CSV with a header, a folder for each split; absent columns are empty."""
    known = set(rows.columns)
    out = rows.select(*[(F.col(c) if c in known else F.lit("").alias(c)) for c in columns], F.col("split").alias("_split"))
    out.write.mode("overwrite").partitionBy("_split").csv(path, header=True)


def write_scores(rows: DataFrame, path: str, thresholds: dict[str, float] | None = None) -> None:
    """Scores, with a 0/1 flag for each method above its threshold."""
    for method, limit in (thresholds or {}).items():
        rows = rows.withColumn(f"{method}_is_anomaly", (F.col(method) > limit).cast("int"))
    rows.write.mode("overwrite").csv(path, header=True)


def append_log(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Rows added to those already written."""
    writer = rows.write.mode("append")
    writer.csv(path, header=True) if form == "csv" else writer.format(form).save(path)


def write_json(rows: DataFrame, path: str, nulls: bool = False, compression: str | None = None) -> None:
    """One document a row; keys without a value are left out, or kept with
    ``nulls``."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not nulls).lower()}).alias("value")).write.mode("overwrite").text(path, compression=compression)


#: Keys of a plane's result, in order (fixed values): those without a value yet
#: are null, and these begin with another.
PLANE_KEYS = """
inspection_order plane_index plane_name alignment_mode desired_roll_deg desired_pitch_deg commanded_roll_deg commanded_pitch_deg commanded_roll commanded_pitch
actual_platform_roll_deg actual_platform_pitch_deg actual_platform_z_cm status inspection_judgement quality_judgement failure_stage failure_reason
automatic_z_success best_z automatic_z_stop_reason selected_candidate_rank selected_z selected_roll selected_pitch selected_quality_score final_candidate_attempts automatic_z_result_path
anomaly_success anomaly_executed anomaly_result anomaly_result_path classification candidate_frames_reused_for_anomaly
final_capture_attempts final_capture_accepted_attempt final_capture_depth_valid_ratio final_capture_plane_inlier_ratio final_capture_plane_residual final_capture_object_area_px final_capture_surface_area_px final_capture_attempt_diagnostics
geometry_capture_attempts geometry_accepted_attempt geometry_capture_attempt_diagnostics final_rgb_warmup_frames geometry_rgb_coordinate_contract
final_depth_path final_rgb_path final_ir_path object_mask_path surface_mask_path surface_geometry_overlay_path inspection_mask_path inspection_mask_overlay_path surface_patch_overlay_path
commanded_rp actual_rp depth_valid_ratio plane_inlier_ratio plane_residual object_area_px surface_area_px surface_ratio inspection_area_px inspection_to_surface_ratio inspection_to_object_ratio
anomaly_roi_type workspace_source workspace_area_px depth_candidate_area_px depth_main_component_area_px filled_object_area_px fill_gain_px fill_gain_ratio depth_contour_roi_artifacts
selected_inspection_patch_count selected_surface_patch_count aruco_roi_status aruco_marker_ids aruco_marker_count aruco_fallback_reason
board_roi_area_px board_plane_valid board_plane_inlier_ratio board_plane_residual_mm depth_object_area_px depth_unknown_area_px hybrid_inspection_area_px hybrid_to_depth_object_ratio
depth_p05_mm depth_median_mm depth_p95_mm board_roi_depth_valid_ratio roi_diagnostic_artifacts usable_patch_count pose_metadata
""".split()
PLANE_DEFAULTS = {"status": "PENDING", "inspection_judgement": "RECHECK", "quality_judgement": "RECHECK"} | dict.fromkeys(["automatic_z_success", "anomaly_success", "anomaly_executed", "candidate_frames_reused_for_anomaly", "board_plane_valid"], False)
PLANE_DEFAULTS |= dict.fromkeys(["final_capture_attempts", "final_capture_object_area_px", "final_capture_surface_area_px", "geometry_capture_attempts", "final_rgb_warmup_frames", "aruco_marker_count"], 0)
PLANE_DEFAULTS |= {"geometry_rgb_coordinate_contract": "Orbbec aligned depth to COLOR_STREAM", "aruco_roi_status": "NOT_AVAILABLE"}
#: Lists and maps begin empty.
PLANE_LISTS = ["final_candidate_attempts", "final_capture_attempt_diagnostics", "geometry_capture_attempt_diagnostics", "aruco_marker_ids"]
PLANE_MAPS = ["depth_contour_roi_artifacts", "roi_diagnostic_artifacts", "pose_metadata"]


def plane_documents(rows: DataFrame) -> DataFrame:
    """Results of planes with all their keys, from the columns at hand."""
    empty = {c: F.array().cast("array<string>") for c in PLANE_LISTS} | {c: F.create_map().cast("map<string,string>") for c in PLANE_MAPS}
    return with_keys(rows.withColumns({c: e for c, e in empty.items() if c not in rows.columns}), PLANE_KEYS, PLANE_DEFAULTS)


def with_keys(rows: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """The columns ``keys`` in order: those of ``rows``, where NULL or absent
    their default, where there is none NULL.  A column that is no key is an
    error."""
    unknown = [c for c in rows.columns if c not in keys]
    if unknown:
        raise ValueError(f"no keys of the document: {unknown}")

    def value(key: str):
        own = [F.col(key)] if key in rows.columns else []
        rest = [F.lit(defaults[key])] if key in defaults else [] if own else [F.lit(None).cast("string")]
        return F.coalesce(*own, *rest).alias(key)

    return rows.select(*[value(k) for k in keys])


def write_sweep(rows: DataFrame, path: str, numbers: list[str], digits: int = 6) -> None:
    rows.withColumns({c: fixed(F.col(c), digits) for c in numbers}).write.mode("overwrite").csv(path, header=True)


def write_artifacts(rows: DataFrame, path: str, by: str) -> None:
    """Rows as Parquet, a folder for each value of ``by``."""
    rows.write.mode("overwrite").partitionBy(by).parquet(path)
