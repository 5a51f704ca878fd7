"""Vocabularies and constants shared by the jobs.

Fixed values: they are part of the data contract and must not change.
"""

SUPPORTED_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "avif", "tif", "tiff")
SUPPORTED_MIME_TYPES = ("image/jpeg", "image/png", "image/webp", "image/avif", "image/tiff")
SYSTEM_NAMES = ("__macosx", "thumbs.db", "desktop.ini", "ehthumbs.db", "node_modules", ".picasaoriginals")
MAX_FILE_BYTES = 64 * 1024 * 1024
MAX_REQUEST_BYTES = 48 * 1024 * 1024

EXTENSION_BY_MIME = {
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/webp": "webp",
    "image/avif": "avif",
    "image/tiff": "tiff",
}
MIME_BY_FORMAT = {
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "png": "image/png",
    "webp": "image/webp",
    "avif": "image/avif",
    "tiff": "image/tiff",
    "heif": "image/heif",
    "gif": "image/gif",
}

IMPORT_STATUSES = ("open", "importing", "completed", "failed", "cancelled")
VISION_STATUSES = ("pending", "processing", "ready", "failed", "unavailable")
ANALYSIS_STATUSES = ("ready", "failed", "unavailable")
DERIVED_KINDS = ("person_mask", "garment_mask", "cutout", "preview", "debug_overlay")
BATCH_STATUSES = ("queued", "running", "completed", "failed", "cancelled")
JOB_KINDS = ("vision", "render", "background_fill")
JOB_STATUSES = ("pending", "claimed", "running", "completed", "failed", "cancelled")
LIVE_JOB_STATUSES = ("pending", "claimed", "running")
MEDIA_ROOTS = ("originals", "derived", "creatives", "assets")

MATCH_TYPES = ("folder", "category", "import", "shot_type", "garment_type", "name", "default")
OPERATORS = ("equals", "contains", "starts_with", "ends_with", "matches", "any")
TYPE_WEIGHT = {
    "default": 0, "name": 1, "category": 2, "import": 3,
    "shot_type": 3, "garment_type": 3, "folder": 4,
}
OPERATOR_WEIGHT = {
    "any": 1, "contains": 2, "ends_with": 3, "starts_with": 4, "matches": 4, "equals": 5,
}
MATCH_TYPE_LABELS = {
    "folder": "folder", "category": "category", "import": "import", "name": "product name",
    "shot_type": "detected shot type", "garment_type": "detected garment type", "default": "default",
}
OPERATOR_LABELS = {
    "equals": "is", "contains": "contains", "starts_with": "starts with",
    "ends_with": "ends with", "matches": "matches", "any": "is anything",
}

SHOT_TYPES = (
    "full_body", "three_quarter", "half_body", "portrait", "close_up",
    "detail", "flat_lay", "product_only", "unknown",
)
HEAD_FRAMEABLE_SHOTS = ("full_body", "three_quarter", "half_body", "portrait", "close_up")
GARMENT_TYPES = ("full_outfit", "upper_body", "lower_body", "outerwear", "accessory", "unknown")
SLEEVE_LENGTHS = ("sleeveless", "short", "three_quarter", "long", "unknown")
NECKLINES = ("high", "crew", "v_or_scoop", "off_shoulder", "unknown")

ANCHOR_NAMES = (
    "head_top", "eye_line", "chin", "neck", "shoulder_left", "shoulder_right",
    "shoulder_center", "chest", "waist", "hip_center", "knee_center", "ankle_center",
    "feet", "garment_top", "garment_hem", "subject_center", "subject_top", "subject_bottom",
)
SOURCE_WEIGHT = {
    "face_landmarks": 1.0, "face_box": 0.95, "person_mask": 0.9, "keypoints": 0.85,
    "garment_mask": 0.8, "interpolated": 0.7, "person_box": 0.5, "extrapolated": 0.45,
}
KEYPOINT_NAMES = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder",
    "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip",
    "left_knee", "right_knee", "left_ankle", "right_ankle",
)

ATR_LABELS = (
    "background", "hat", "hair", "sunglasses", "upper_clothes", "skirt", "pants", "dress", "belt",
    "left_shoe", "right_shoe", "face", "left_leg", "right_leg", "left_arm", "right_arm", "bag", "scarf",
)
ATR = {label: i for i, label in enumerate(ATR_LABELS)}


def _classes(*labels: str) -> tuple[int, ...]:
    return tuple(ATR[label] for label in labels)


CLASS_SETS = {
    "garment": _classes("upper_clothes", "skirt", "pants", "dress", "belt", "scarf"),
    "upper_garment": _classes("upper_clothes", "dress", "scarf"),
    "lower_garment": _classes("skirt", "pants"),
    "skin": _classes("face", "left_arm", "right_arm", "left_leg", "right_leg"),
    "head": _classes("hat", "hair", "face", "sunglasses"),
    "feet": _classes("left_shoe", "right_shoe", "left_leg", "right_leg"),
    "arms": _classes("left_arm", "right_arm"),
    # Denominator of body coverage: clothing plus every visible body part.
    "body": _classes(
        "upper_clothes", "skirt", "pants", "dress", "belt", "scarf", "face", "hair", "hat",
        "left_arm", "right_arm", "left_leg", "right_leg", "left_shoe", "right_shoe",
    ),
}

THRESHOLDS = {
    "person_score": 0.35, "person_nms_iou": 0.45, "face_score": 0.5, "face_nms_iou": 0.4,
    "keypoint_score": 0.3, "mask_binary": 0.5, "max_detections": 20,
}
POSE_INPUT_SIZE = 640
FACE_INPUT_SIZE = 640
FACE_STRIDES = (8, 16, 32)
FACE_ANCHORS_PER_LOCATION = 2

ASPECT_RATIOS = {
    "1:1": (1080, 1080), "4:5": (1080, 1350), "2:3": (1200, 1800), "3:4": (1200, 1600),
    "9:16": (1080, 1920), "16:9": (1920, 1080), "1.91:1": (1200, 628),
}
TEMPLATE_SCHEMA_VERSION = 1
TEMPLATE_VARIABLES = (
    "product_name", "category", "folder", "file_name", "shot_type", "garment_type", "index",
)

RETRY_ATTEMPTS = 3
FILL_TIMEOUT_MS = 180_000
FILL_POLL_MS = 5_000
FILL_COOLDOWN_MS = 20_000
STALE_CLAIM_MS = 5 * 60 * 1000
PRUNE_AFTER_MS = 7 * 24 * 60 * 60 * 1000
SUPERSAMPLE = 2

DEFAULT_FILL_PROMPT = (
    "Seamlessly continue this photograph's existing backdrop floor lighting and shadow beyond its "
    "current edges matching colour texture and perspective exactly with no visible seam"
)
GARMENT_FILL_CLAUSE = (
    "of the frame where the visible garment fabric has been cropped by the photo and does not end there "
    "continue that exact same fabric its embroidery pattern colour and natural drape as a direct physical "
    "continuation of the garment beyond that edge rather than inventing where it ends do not generate skin "
    "limbs or any other body part in that specific region and do not generate a hem cuff or any garment "
    "edge or ending there"
)
