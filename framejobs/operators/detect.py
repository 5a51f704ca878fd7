"""Detections: decode model heads into boxes and landmarks, suppress overlaps, pick the subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framejobs import vocab
from framejobs.functions import geometry as G
from framejobs.operators.ranking import bounded, largest_group
from framejobs.session import stored

# Candidates of one image that a single fold may hold; an image beyond it is suppressed in rounds.
MAX_FOLD = 20_000
_T = vocab.THRESHOLDS


def _unbox(value: Column, axis: str) -> Column:
    return G.unletterbox(value, F.col(f"pad_{axis}"), F.col("scale"), F.col(f"scale_{axis}"))


def decode_pose(candidates: DataFrame, score_min: float = _T["person_score"], keypoint_min: float = _T["keypoint_score"]) -> DataFrame:
    """Pose-head rows (56 channels each) to person candidates in source pixels.

    A keypoint outside the frame keeps its place but is never visible.
    """
    c = lambda i: F.get("channels", i if isinstance(i, Column) else F.lit(i))
    w, h = F.col("source_width"), F.col("source_height")
    box = G.clamp_box(
        G.box(
            _unbox(c(0) - c(2) / 2, "x"), _unbox(c(1) - c(3) / 2, "y"),
            _unbox(c(0) + c(2) / 2, "x"), _unbox(c(1) + c(3) / 2, "y"),
        ), w, h,
    )
    points = F.transform(
        F.sequence(F.lit(0), F.lit(16)),
        lambda k: F.struct(
            _unbox(c(5 + k * 3), "x").alias("x"), _unbox(c(6 + k * 3), "y").alias("y"), c(7 + k * 3).alias("score")
        ),
    )
    seen = F.transform("__points", lambda p: F.struct(
        p["x"].alias("x"), p["y"].alias("y"), p["score"].alias("score"),
        ((p["score"] >= keypoint_min) & (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= w) & (p["y"] <= h)).alias("visible"),
    ))
    staged = (
        candidates.filter(c(4) >= score_min)
        .withColumn("box", box)
        .filter(G.box_area(F.col("box")) > 0)
        .withColumn("__points", points)
        .withColumn("__kps", seen)
    )
    visible = F.filter("__kps", lambda k: k["visible"])
    names = F.array(*[F.lit(n) for n in vocab.KEYPOINT_NAMES])
    area = w * h
    return staged.select(
        "source_hash", "anchor_index", "source_width", "source_height", "box", c(4).alias("score"),
        F.map_from_arrays(names, F.col("__kps")).alias("keypoints"),
        G.mean(F.transform(visible, lambda k: k["score"])).alias("keypoint_confidence"),
        F.size(visible).alias("visible_keypoint_count"),
        F.when(area > 0, G.clamp01(G.box_area(F.col("box")) / area)).otherwise(F.lit(0.0)).alias("area_ratio"),
    )


def decode_faces(candidates: DataFrame, score_min: float = _T["face_score"]) -> DataFrame:
    """Face-head rows to face candidates: cell centre plus distances in stride units.

    Cells run row by row with the anchors of one place adjacent. ``offsets`` may be null.
    """
    stride = F.col("stride")
    cells = F.floor(F.lit(vocab.FACE_INPUT_SIZE) / stride)
    place = F.floor(F.col("cell_index") / vocab.FACE_ANCHORS_PER_LOCATION)
    w, h = F.col("source_width"), F.col("source_height")
    d = lambda i: F.get("distances", F.lit(i)) * stride
    staged = candidates.filter(F.col("score") >= score_min).withColumns({
        "__cx": F.pmod(place, cells) * stride, "__cy": F.floor(place / cells) * stride,
    })
    cx, cy = F.col("__cx"), F.col("__cy")
    staged = staged.withColumn("box", G.clamp_box(
        G.box(_unbox(cx - d(0), "x"), _unbox(cy - d(1), "y"), _unbox(cx + d(2), "x"), _unbox(cy + d(3), "y")), w, h
    ))
    staged = staged.filter((F.col("box.right") - F.col("box.left") > 1) & (F.col("box.bottom") - F.col("box.top") > 1))
    names = ("left_eye", "right_eye", "nose", "left_mouth", "right_mouth")
    o = lambda i: F.get("offsets", F.lit(i)) * stride
    marks = F.when(F.col("offsets").isNotNull(), F.struct(*[
        G.point(_unbox(cx + o(2 * i), "x"), _unbox(cy + o(2 * i + 1), "y")).alias(name) for i, name in enumerate(names)
    ]))
    staged = staged.withColumn("landmarks", marks)
    dx = F.col("landmarks.right_eye.x") - F.col("landmarks.left_eye.x")
    dy = F.col("landmarks.right_eye.y") - F.col("landmarks.left_eye.y")
    roll = F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(F.degrees(F.atan2(dy, dx)))
    return staged.select(
        "source_hash", "anchor_index", "source_width", "source_height", "box", "score", "landmarks", roll.alias("roll")
    )


def nms(
    candidates: DataFrame, iou_max: float, cap: int = _T["max_detections"], max_fold: int = MAX_FOLD
) -> DataFrame:
    """Greedy suppression per image: best score first, index on ties, overlap strictly above the limit.

    Adds ``detection_index``. An image has at most as many candidates as its model has anchors; one
    that still exceeds ``max_fold`` is worked off in rounds that never gather its rows.
    """
    if largest_group(candidates, ["source_hash"]) <= max_fold:
        return _nms_fold(candidates, iou_max, cap)
    counts = candidates.groupBy("source_hash").agg(F.count(F.lit(1)).alias("n"))
    hot = bounded(counts.filter(F.col("n") > max_fold).select("source_hash"))
    cold = _nms_fold(candidates.join(hot, "source_hash", "left_anti"), iou_max, cap)
    return cold.unionByName(_nms_rounds(candidates.join(hot, "source_hash", "left_semi"), iou_max, cap))


def _nms_fold(candidates: DataFrame, iou_max: float, cap: int) -> DataFrame:
    """Fold over the sorted boxes of one image; only boxes are gathered, the rest joins back."""
    row = F.struct((-F.col("score")).alias("neg"), F.col("anchor_index").alias("anchor_index"), F.col("box"))
    grouped = candidates.groupBy("source_hash").agg(F.array_sort(F.collect_list(row)).alias("__all"))

    def take(kept: Column, row: Column) -> Column:
        hit = F.exists(kept, lambda k: G.iou(k["box"], row["box"]) > iou_max)
        return F.when((F.size(kept) >= cap) | hit, kept).otherwise(F.concat(kept, F.array(row)))

    kept = F.aggregate("__all", F.slice("__all", 1, 0), take)
    winners = grouped.select("source_hash", F.posexplode(kept).alias("detection_index", "__row")).select(
        "source_hash", "detection_index", F.col("__row.anchor_index").alias("anchor_index")
    )
    rest = [c for c in candidates.columns if c != "source_hash"]
    return candidates.join(winners, ["source_hash", "anchor_index"]).select("source_hash", "detection_index", *rest)


def _nms_rounds(candidates: DataFrame, iou_max: float, cap: int) -> DataFrame:
    """One winner per image and round; the winners are few and meet the rest by a broadcast join."""
    columns = ["source_hash", "detection_index", *[c for c in candidates.columns if c != "source_hash"]]
    rest, kept = stored(candidates), None
    packed = F.struct(*[c for c in candidates.columns if c != "source_hash"])
    for i in range(cap):
        best = stored(
            rest.groupBy("source_hash").agg(F.max_by(packed, F.struct("score", -F.col("anchor_index"))).alias("w"))
        )
        won = best.select("source_hash", F.lit(i).alias("detection_index"), "w.*").select(*columns)
        kept = won if kept is None else kept.unionByName(won)
        if best.isEmpty():
            break
        winners = best.select("source_hash", F.col("w.box").alias("__box"), F.col("w.anchor_index").alias("__won"))
        near = (G.iou(F.col("box"), F.col("__box")) > iou_max) | (F.col("anchor_index") == F.col("__won"))
        rest = stored(
            rest.join(bounded(winners), "source_hash", "left").filter(~F.coalesce(near, F.lit(False)))
            .drop("__box", "__won")
        )
    return kept


def gather(detections: DataFrame, name: str) -> DataFrame:
    """Kept detections of an image as one array in rank order; suppression caps its length."""
    fields = [c for c in detections.columns if c not in ("source_hash", "source_width", "source_height")]
    packed = F.struct("detection_index", *[c for c in fields if c != "detection_index"])
    return detections.groupBy("source_hash").agg(F.array_sort(F.collect_list(packed), _by_index).alias(name))


def _by_index(a: Column, b: Column) -> Column:
    return a["detection_index"] - b["detection_index"]


def primary_person_index(persons: Column, image_width: Column) -> Column:
    """The subject: frame share, confidence, skeleton completeness and centrality; first on ties."""
    half = image_width / 2

    def score(p: Column, i: Column) -> Column:
        centre = (p["box"]["left"] + p["box"]["right"]) / 2
        centrality = F.lit(1.0) - F.least(F.lit(1.0), F.abs(centre - half) / half)
        value = (
            p["area_ratio"] * 0.45 + p["score"] * 0.20 + p["visible_keypoint_count"] / 17 * 0.20 + centrality * 0.15
        )
        return F.struct(value.alias("v"), (-i).alias("i"))

    best = -F.array_max(F.transform(persons, score))["i"]
    return F.when(F.size(persons) > 0, best)


def primary_face_index(faces: Column, person_box: Column) -> Column:
    """The face most inside the person's box; without a person the largest face."""
    alone = F.array_max(F.transform(
        faces, lambda f, i: F.struct(
            ((f["box"]["right"] - f["box"]["left"]) * (f["box"]["bottom"] - f["box"]["top"])).alias("v"), (-i).alias("i")
        )
    ))

    def score(f: Column, i: Column) -> Column:
        area = G.box_area(f["box"])
        inside = F.try_divide(G.intersection(f["box"], person_box), area)
        share = F.try_divide(area, (person_box["right"] - person_box["left"]) * (person_box["bottom"] - person_box["top"]) * 0.15)
        value = inside * 0.5 + f["score"] * 0.3 + F.least(F.lit(1.0), share) * 0.2
        return F.when((area > 0) & (inside >= 0.5), F.struct(value.alias("v"), (-i).alias("i")))

    held = F.array_max(F.array_compact(F.transform(faces, score)))
    index = F.when(person_box.isNull(), -alone["i"]).otherwise(-held["i"])
    return F.when(F.size(faces) > 0, index)


def with_primary_subject(images: DataFrame) -> DataFrame:
    """Add the primary person and face of images that carry ``persons`` and ``faces`` arrays."""
    staged = images.withColumn(
        "primary_person_index", primary_person_index(F.col("persons"), F.col("image_width"))
    )
    staged = staged.withColumn("person", F.get("persons", F.col("primary_person_index")))
    staged = staged.withColumn(
        "primary_face_index", primary_face_index(F.col("faces"), F.col("person.box"))
    )
    return staged.withColumn("face", F.get("faces", F.col("primary_face_index")))
