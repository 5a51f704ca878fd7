"""Catalogue tables on Parquet: schemas, reads, partitioned writes. Keyed writes are in ``sources.keyed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMAS = {
    "imports": "import_id string, name string, root_path string, status string, total_files int, "
    "imported_files int, skipped_files int, failed_files int, duplicate_files int, error string, "
    "created_at timestamp, updated_at timestamp, completed_at timestamp",
    "products": "product_id string, import_id string, product_name string, slug string, folder_path string, "
    "category string, image_count int, primary_image_id string, created_at timestamp, updated_at timestamp",
    "images": "image_id string, product_id string, import_id string, source_hash string, storage_key string, "
    "file_name string, relative_path string, mime_type string, byte_size bigint, width int, height int, "
    "exif_orientation int, has_alpha boolean, color_space string, captured_at timestamp, camera_make string, "
    "camera_model string, position int, is_primary boolean, vision_status string, created_at timestamp, "
    "updated_at timestamp",
    "vision_analyses": "source_hash string, engine_version string, schema_version int, provider string, "
    "status string, image_width int, image_height int, person_count int, face_count int, shot_type string, "
    "garment_type string, overall_confidence double, payload string, model_versions string, duration_ms int, "
    "error string, created_at timestamp",
    "derived_assets": "source_hash string, kind string, storage_key string, mime_type string, width int, "
    "height int, byte_size bigint, created_at timestamp",
    "rules": "rule_id string, rule_name string, match_type string, operator string, value string, "
    "template_id string, priority int, is_active boolean, created_at timestamp",
    "batches": "batch_id string, name string, status string, total_jobs int, completed_jobs int, "
    "failed_jobs int, cancelled_jobs int, created_at timestamp, updated_at timestamp, started_at timestamp, "
    "completed_at timestamp",
    "jobs": "job_id string, kind string, status string, priority int, batch_id string, dedupe_key string, "
    "payload string, attempts int, max_attempts int, worker_id string, claimed_at timestamp, "
    "heartbeat_at timestamp, available_at timestamp, error string, result string, created_at timestamp, "
    "updated_at timestamp, completed_at timestamp",
    "creatives": "creative_id string, product_id string, image_id string, template_id string, batch_id string, "
    "source_hash string, storage_key string, mime_type string, width int, height int, byte_size bigint, "
    "framing string, render_ms int, created_at timestamp",
}


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Scan one catalogue table with its declared schema."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{base}/{name}")


def write_table(df: DataFrame, base: str, name: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{base}/{name}")


def parse_payload(raw: Column, schema: str, default: Column | None = None) -> Column:
    """JSON text as a struct; null, empty or broken text gives the default.

    ``from_json`` alone turns broken text into a struct of nulls, hence the validity test.
    """
    parsed = F.from_json(raw, schema)
    valid = raw.isNotNull() & (raw != "") & F.try_parse_json(raw).isNotNull()
    chosen = F.when(valid, parsed)
    return chosen if default is None else F.coalesce(chosen, default)
