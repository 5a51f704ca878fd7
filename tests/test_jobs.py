"""Operators on small fixtures: golden rows, skew paths against plain paths, properties."""

import random
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from framejobs.functions import paths
from framejobs.operators import analyze, detect, exports, framing, hooks, hygiene, ingest, jobs as J, layout, lookup, ranking, reports, routing
from framejobs.plans import settings
from framejobs.sources import bridge as B, media, tables, templates as T
from framejobs.streaming.jobs import JobMachine, RowJobMachine


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def hot_rows(spark, n=3000):
    """One group holds a third of the rows."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"),
        (F.hash("id") % 50).alias("v"),
    )


def test_rank_of_a_hot_group_matches_the_plain_window(spark):
    df = hot_rows(spark)
    order = [F.desc("v"), F.asc("id")]
    plain = ranking.rank_within(df, ["k"], order, "r").select("id", "r")
    spread = ranking.rank_within(df, ["k"], order, "r", max_group_rows=10).select("id", "r")
    assert rows(plain, "id") == rows(spread, "id")


def test_previous_row_of_a_hot_group(spark):
    df = hot_rows(spark, 900)
    order = [F.col("v"), F.col("id")]
    plain = ranking.previous_within(df, ["k"], order, ["v"]).select("id", "prev_v")
    spread = ranking.previous_within(df, ["k"], order, ["v"], max_group_rows=10).select("id", "prev_v")
    assert rows(plain, "id") == rows(spread, "id")


def test_ingest_is_independent_of_partitioning_and_skew_path(spark, sf_dir):
    files, analyses = B.files(spark, sf_dir), B.analyses(spark, sf_dir)
    columns = ["image_id", "product_id", "position", "is_primary", "vision_status"]
    a = ingest.import_catalog(files, analyses, "2.0")[2].select(columns)
    b = ingest.import_catalog(files.repartition(13), analyses, "2.0", max_group_rows=3)[2].select(columns)
    assert rows(a, "image_id") == rows(b, "image_id")


def test_suppression_rounds_match_the_fold(spark, sf_dir):
    boxes = detect.decode_pose(B.pose_candidates(spark, sf_dir))
    fold = detect.nms(boxes, 0.45).select("source_hash", "anchor_index", "detection_index")
    rounds = detect.nms(boxes, 0.45, max_fold=5).select("source_hash", "anchor_index", "detection_index")
    assert rows(fold, "source_hash", "detection_index") == rows(rounds, "source_hash", "detection_index")


def test_kept_boxes_do_not_overlap(spark, sf_dir):
    kept = detect.nms(detect.decode_pose(B.pose_candidates(spark, sf_dir)), 0.45).select("source_hash", "detection_index", "box")
    from framejobs.functions.geometry import iou

    other = kept.select("source_hash", F.col("detection_index").alias("j"), F.col("box").alias("b"))
    pairs = kept.join(other, "source_hash").filter(F.col("detection_index") < F.col("j"))
    assert pairs.filter(iou(F.col("box"), F.col("b")) > 0.45).count() == 0


def test_blocks_of_a_large_key_pack_like_one_fold(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 5}", i, rng.choice([1, 5, 20, 60, 150])) for i in range(1500)]
    df = spark.createDataFrame(data, "k string, i bigint, byte_size bigint")
    want, state = {}, {}
    for k, i, weight in data:
        unit, total, empty = state.get(k, (0, 0, True))
        if not empty and total + weight > 100:
            unit, total = unit + 1, 0
        state[k] = (unit, total + weight, False)
        want[i] = unit
    for limit in (20, 10_000):
        got = ingest.pack_by_bytes(df, ["k"], "i", "byte_size", 100, limit).collect()
        assert {r.i: r.unit_id for r in got} == want


def greedy(sizes, limit):
    unit = total = 0
    out = []
    for i, w in enumerate(sizes):
        if total + w > limit and i:
            unit, total = unit + 1, 0
        total += w
        out.append(unit)
    return out


def test_large_keys_are_packed_like_the_sequential_fold(spark, monkeypatch):
    rng = random.Random(8)
    keys = {"even": [7] * 5000, "zeros": [0] * 300 + [rng.choice([0, 0, 3, 101, 250]) for _ in range(3000)] + [0] * 50, None: [rng.randint(0, 120) for _ in range(4000)],
            "huge": [150] * 700, "one": [5], "nil": [0] * 9, "wide": [1] * 30}
    rows = [(k, i, w) for k, sizes in keys.items() for i, w in enumerate(sizes)]
    df = spark.createDataFrame(rows, "k string, i int, byte_size bigint").repartition(7)
    got = {}
    for r in ingest.pack_by_bytes(df, ["k"], "i", "byte_size", 100, 10).collect():
        got.setdefault(r.k, {})[r.i] = r.unit_id
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: greedy(sizes, 100) for k, sizes in keys.items()}


def test_one_key_of_a_million_files(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(900_000)).alias("byte_size"))
    stages = []
    whole = ingest.stored
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        ingest.stored = lambda d: stages.append(d) or whole(d)
        got = ingest.pack_by_bytes(df, ["k"], "i", "byte_size", 1_000_000, 10_000).toPandas().sort_values("i")
    finally:
        ingest.stored = whole
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got.unit_id.tolist() == greedy(got.byte_size.tolist(), 1_000_000)
    assert len(stages) <= 10 + 2 * 6  # two tables a round, a round for each binary digit of 24 blocks


def sequential_names(names):
    used, out = set(), []
    for name in names:
        if name in used:
            n = 2
            while f"{name}-{n}" in used:
                n += 1
            name = f"{name}-{n}"
        used.add(name)
        out.append(f"{name}.jpg")
    return out


def test_archive_names_follow_the_order_of_arrival(spark):
    rng = random.Random(3)
    pool = ["x", "x-2", "x-3", "x-2-2", "x-02", "y", "y-1", "z", "z-9", "dir/x", "a-b"]
    names = [rng.choice(pool) for _ in range(400)]
    df = spark.createDataFrame([(i, f"{n}.jpg", "jpg") for i, n in enumerate(names)], "i int, archive_name string, extension string")
    for limit in (5, 10_000):
        got = rows(exports.number_collisions(df, [F.asc("i")], limit).select("i", "archive_name"), "i")
        assert [r[1] for r in got] == sequential_names(names)


def test_rule_order_does_not_depend_on_row_order(spark, sf_dir):
    subjects = spark.createDataFrame(
        [("p1", "set-1", "AW25/dresses", "dresses", "imp_1", "close_up", None), ("p2", "x", "AW25-archive", None, None, None, None)],
        "product_id string, product_name string, folder_path string, category string, import_id string, shot_type string, garment_type string",
    )
    shuffled = list(settings.RULES)
    random.Random(7).shuffle(shuffled)
    schema = settings.rules(spark).schema
    other = spark.createDataFrame([(*r[:8], datetime(2024, 1, 1, 0, r[8])) for r in shuffled], schema)
    a = routing.route(subjects, settings.rules(spark)).select("product_id", "rule_id")
    b = routing.route(subjects, other).select("product_id", "rule_id")
    assert rows(a, "product_id") == rows(b, "product_id")


def test_folder_rule_stops_at_a_path_boundary(spark):
    subjects = spark.createDataFrame(
        [("a", "n", "AW25-archive"), ("b", "n", "aw25/x")], "product_id string, product_name string, folder_path string"
    ).selectExpr("*", "null::string category", "null::string import_id", "null::string shot_type", "null::string garment_type")
    rule = spark.createDataFrame(
        [("r", "r", "folder", "starts_with", " AW25 ", "t", 1, True, datetime(2024, 1, 1))], settings.rules(spark).schema
    )
    assert rows(routing.route(subjects, rule).select("product_id", "rule_id"), "product_id") == [("a", None), ("b", "r")]


def test_long_rule_lists_continue_in_the_next_case(spark):
    schema = settings.rules(spark).schema
    many = spark.createDataFrame(
        [(f"r{i:04d}", "n", "name", "equals", f"p{i}", f"t{i}", 1000 - i, True, datetime(2024, 1, 1)) for i in range(450)], schema
    )
    subjects = spark.range(0, 500, 50).selectExpr(
        "id", "concat('p', id) product_name", "'' folder_path", "null::string category", "null::string import_id",
        "null::string shot_type", "null::string garment_type",
    )
    got = rows(routing.route(subjects, many).select("id", "template_id"), "id")
    assert got == [(i, f"t{i}" if i < 450 else None) for i in range(0, 500, 50)]


def subject(spark, anchors, shot="full_body", box=None, w=4000.0, h=4000.0):
    schema = (
        "source_hash string, image_width double, image_height double, "
        "anchors map<string,struct<x:double,y:double,confidence:double>>, shot_type string, "
        "subject_box struct<left:double,top:double,right:double,bottom:double>"
    )
    return spark.createDataFrame([("s", w, h, anchors, shot, box)], schema)


def test_span_crop(spark):
    anchors = {"head_top": (400.0, 100.0, 0.9), "feet": (400.0, 940.0, 0.9), "subject_center": (400.0, 500.0, 0.9)}
    spec = T.template("t", keep_inside=[], max_upscale=10.0)
    r = framing.frame_catalog(subject(spark, anchors), [spec]).head()
    assert abs(r.crop.height - 1000) < 1e-9 and abs(r.crop.width - 800) < 1e-9 and abs(r.crop.y - 20) < 1e-9
    assert r.violations == [] and all(abs(p.error_y or 0) < 1e-9 and abs(p.error_x or 0) < 1e-9 for p in r.placements)


def test_crop_height_of_a_span_ignores_the_canvas(spark):
    anchors = {"head_top": (400.0, 100.0, 0.9), "feet": (400.0, 940.0, 0.9), "subject_center": (400.0, 500.0, 0.9)}
    specs = [T.template(f"t{i}", aspect_ratio=a, keep_inside=[], max_upscale=100.0) for i, a in enumerate(("1:1", "9:16", "16:9"))]
    got = {round(r.crop.height, 9) for r in framing.frame_catalog(subject(spark, anchors), specs).collect()}
    assert got == {1000.0}


def test_upscale_clamp_and_fallback(spark):
    strategy = T._strategy("fixed", "Fixed", [], 0.0, [], None, None, {"mode": "fixed", "source_per_canvas_pixel": 500 / 1350})
    r = framing.frame_catalog(subject(spark, {}), [T.template("t", keep_inside=[], max_upscale=1.5, strategies=[strategy])]).head()
    assert abs(r.crop.height - 900) < 1e-9 and [v.code for v in r.violations] == ["max_upscale_clamped"]
    r = framing.frame_catalog(subject(spark, {}, "unknown"), [T.template("t")]).head()
    assert r.strategy_id == "subject_fit" and r.used_fallback
    r = framing.frame_catalog(subject(spark, {}), [T.template("t", strategies=[])]).head()
    assert r.strategy_id == "implicit_fit" and not r.used_fallback


def test_clamped_crops_stay_inside(spark, sf_dir):
    specs = [t for t in settings.TEMPLATES if t["overflow"] == "clamp"]
    f = framing.frame_catalog(B.framing_subjects(spark, sf_dir), specs)
    small = f.filter("overflow_policy = 'clamp' AND crop.width < image_width AND crop.height < image_height")
    assert small.count() > 0
    assert small.filter(framing.has_overflow(F.col("overflow"))).count() == 0


def test_planned_pairs_frame_like_all_pairs(spark, sf_dir):
    subjects = B.framing_subjects(spark, sf_dir)
    pairs = subjects.filter("shot_type = 'portrait'").select("source_hash", F.lit("tpl_3").alias("template_id"))
    columns = ["source_hash", "template_id", "crop", "strategy_id"]
    some = framing.frame_catalog(subjects, settings.templates(spark), pairs).select(columns)
    every = framing.frame_catalog(subjects, settings.TEMPLATES).filter("template_id = 'tpl_3' AND shot_type = 'portrait'")
    assert rows(some, "source_hash") == rows(every.select(columns), "source_hash")


def test_filters_stay_above_the_sealed_chain(spark, sf_dir):
    f = framing.frame_catalog(B.framing_subjects(spark, sf_dir), settings.TEMPLATES).filter("upscale > 1 AND crop.x > 0")
    assert len(f._jdf.queryExecution().optimizedPlan().toString()) < 400_000


def test_batch_status_and_eta(spark):
    now = datetime(2024, 1, 1, 0, 0, 10, tzinfo=timezone.utc)
    spec = [("failed", ["failed"] * 2), ("done", ["failed", "completed"]), ("idle", []), ("busy", ["failed", "running"])]
    jobs = spark.createDataFrame(
        [(b, s) for b, statuses in spec for s in statuses] + [("eta", "completed")] * 5 + [("eta", "pending")] * 15,
        "batch_id string, status string",
    )
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    batches = spark.createDataFrame([(b, "queued", start) for b in ("failed", "done", "idle", "busy", "eta")], "batch_id string, status string, started_at timestamp")
    got = {r.batch_id: (r.status, r.eta_seconds) for r in J.batch_progress(jobs, batches, now).collect()}
    assert got == {"failed": ("failed", None), "done": ("completed", None), "idle": ("queued", None), "busy": ("running", None), "eta": ("running", 30)}


def test_job_machine_transitions():
    machine = JobMachine()
    s = {"status": "pending", "attempts": 0, "max_attempts": 2, "heartbeat_at": None, "available_at": None, "error": None, "updated_at": 0}
    for step in (("claim", 1), ("run", 2), ("fail", 3), ("claim", 4), ("fail", 5)):
        machine._step(s, *step, None)
    assert (s["status"], s["attempts"]) == ("failed", 2)
    machine._step(s, "retry", 6, None)
    machine._step(s, "claim", 7, None)
    machine._step(s, "defer_refund", 8, "5000")
    machine._step(s, "claim", 9, None)
    assert (s["status"], s["attempts"], s["available_at"]) == ("pending", 0, 5008)


def test_usable_analysis_ignores_an_older_ready_row(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame(
        [("a", "1.0", "ready", 1, t(1)), ("a", "1.1", "failed", 1, t(2)), ("b", "1.0", "ready", 1, t(1)),
         ("c", "2.0", "ready", 0, t(1)), ("d", "2.0", "ready", 1, t(1)), ("d", "1.0", "ready", 1, t(9))],
        "source_hash string, engine_version string, status string, schema_version int, created_at timestamp",
    )
    got = rows(lookup.usable_analyses(df, "2.0").select("source_hash", "engine_version", "stale"), "source_hash")
    assert got == [("b", "1.0", True), ("d", "2.0", False)]


def test_shared_bytes_survive_a_delete(spark):
    images = spark.createDataFrame([("i1", "p1", "m1", "h1", "k1"), ("i2", "p2", "m2", "h1", "k1"), ("i3", "p1", "m1", "h2", "k2")],
                                   "image_id string, product_id string, import_id string, source_hash string, storage_key string")
    tables_ = {"images": images, "products": images.select("product_id", "import_id").distinct(),
               "creatives": spark.createDataFrame([("c1", "i3", "o1")], "creative_id string, image_id string, storage_key string")}
    listing = spark.createDataFrame([("originals", "k1", 5), ("originals", "k2", 7), ("creatives", "o1", 1), ("derived", "a/b/h2/m.png", 2)],
                                    "root string, key string, size bigint")
    _, _, report = hygiene.delete_impact(tables_, "import", spark.createDataFrame([("m1",)], "import_id string"), listing)
    r = report.head()
    assert (r.files_deleted, r.freed_bytes, r.shared_files_kept, r.removed_images, r.removed_creatives) == (3, 10, 1, 2, 1)


def test_tables_round_trip(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([("b1", "c1", 1), ("b2", "c2", 2)], "batch_id string, creative_id string, byte_size bigint")
    tables.write_table(df, base, "creatives_plan", ["batch_id"])
    assert tables.read_table(spark, base, "creatives_plan").filter("batch_id = 'b2'").count() == 1
    (tmp_path / "media" / "ab").mkdir(parents=True)
    (tmp_path / "media" / "ab" / "x.jpg").write_bytes(b"\xff\xd8abc\xff\xd9")
    (tmp_path / "media" / "y.jpg").write_bytes(b"\xff\xd8abc")
    listed = rows(media.scan_media(spark, {"originals": f"{base}/media"}).select("root", "key", "size"), "key")
    assert listed == [("originals", "ab/x.jpg", 7), ("originals", "y.jpg", 5)]
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{base}/media")
    assert blobs.filter(media.complete_jpeg(F.col("content"))).count() == 1


def test_flat_lay_without_a_person(spark):
    df = spark.range(1).selectExpr(
        "1000.0d image_width", "1000.0d image_height", "named_struct('type', 'upper_body') garment",
        "named_struct('has_person', false, 'has_face', false, 'head_visible', false, 'shoulders_visible', false, "
        "'hips_visible', false, 'knees_visible', false, 'ankles_visible', false, 'face_height_ratio', 0.0d, "
        "'person_height_ratio', 0.0d, 'person_coverage', 0.5d) signals",
    )
    shot = analyze.classify_shot(df).head().shot
    assert (shot.type, shot.confidence, shot.reason, shot.share) == ("flat_lay", 0.7, "fills_frame", 0.5)


def test_analysis_merge_follows_time(spark):
    schema = "source_hash string, engine_version string, status string, error string, created_at int, shot_type string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    current = frame([("a", "1", "ready", None, 1, "old"), ("b", "1", "ready", None, 5, "old"), ("c", "1", "ready", None, 1, "old")])
    incoming = frame([("a", "1", "ready", None, 9, "new"), ("c", "1", "ready", None, 3, "new")])
    failures = spark.createDataFrame(
        [("a", "1", "failed", "early", 2), ("b", "1", "failed", "late", 7), ("c", "1", "failed", "same", 3), ("d", "1", "failed", "only", 1)],
        "source_hash string, engine_version string, status string, error string, created_at int")
    got = {r.source_hash: (r.status, r.error, r.created_at, r.shot_type) for r in lookup.merge_analyses(current, incoming, failures).collect()}
    assert got == {
        "a": ("ready", None, 9, "new"), "b": ("failed", "late", 7, "old"), "c": ("failed", "same", 3, "new"), "d": ("failed", "only", 1, None)}


def test_storage_key_follows_the_type(spark):
    rows = [("a.png", None, "png"), ("a.PNG", "image/jpeg", "jpg"), ("a.tif", "", "tiff"), ("a.webp", "image/gif", "webp"), ("a.jpeg", None, "jpg")]
    df = spark.createDataFrame(rows, "n string, m string, want string")
    for r in df.select("want", paths.original_key(F.lit("abcdef"), paths.stored_mime(F.col("n"), F.col("m"))).alias("k")).collect():
        assert r.k == f"ab/cd/abcdef.{r.want}"


def test_root_files_are_products_of_their_own(spark):
    names = ["日本.jpg", "中国.jpg", "x" * 90 + "1.jpg", "x" * 90 + "2.jpg"]
    df = spark.createDataFrame([(n, n) for n in names], "relative_path string, file_name string").withColumn("import_id", F.lit("i"))
    assert ingest.group_products(df).select("product_id").distinct().count() == 4


def test_equal_bytes_have_one_storage_key(spark):
    files = [
        (1, "a/x.png", "x.png", None, "h1"), (2, "b/x.jpg", "x.jpg", "image/jpeg", "h1"), (3, "c/x.webp", "x.webp", "image/webp", "h1"),
        (4, "a/y.jpg", "y.jpg", None, "h2"), (5, "b/y.png", "y.png", "image/png", "h2"), (6, "b/z.png", "z.png", "image/png", "h3"),
    ]
    listing = spark.createDataFrame(
        [(a, "i", p, n, m, 10, h, datetime(2024, 1, 1, 0, a)) for a, p, n, m, h in files],
        "arrival int, import_id string, relative_path string, file_name string, mime_type string, byte_size int, source_hash string, created_at timestamp")
    analyses = spark.createDataFrame([], "source_hash string, engine_version string, status string")
    keys = lambda df: {tuple(r) for r in ingest.import_catalog(df, analyses, "1")[2].select("arrival", "storage_key").collect()}
    # The type under which the bytes arrived first.
    assert keys(listing) == {(a, f"h{n}//h{n}.{e}") for a, n, e in [(1, 1, "png"), (2, 1, "png"), (3, 1, "png"), (4, 2, "jpg"), (5, 2, "jpg"), (6, 3, "png")]}
    # The type they decode to; bytes that do not decode have failed.
    decoded = listing.withColumn("format", F.when(F.col("source_hash") == "h1", "webp").when(F.col("source_hash") == "h2", "png"))
    assert keys(decoded) == {(a, f"h{n}//h{n}.{e}") for a, n, e in [(1, 1, "webp"), (2, 1, "webp"), (3, 1, "webp"), (4, 2, "png"), (5, 2, "png")]}
    outcomes = ingest.import_catalog(decoded, analyses, "1")[0]
    assert ingest.import_counters(outcomes).select("imported_files", "failed_files").collect()[0] == (5, 1)


def test_calibration_by_ranks_and_by_sketches(spark):
    rng = random.Random(2)
    values = {True: [rng.random() ** 3 for _ in range(6001)], False: [rng.choice([0.1, 0.1, 0.5]) for _ in range(500)], None: [0.25]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [(True, None), (False, None)]
    df = spark.createDataFrame(rows, "has_face boolean, best_head_score double").repartition(5)
    want = df.groupBy("has_face").agg(F.count(F.lit(1)).alias("n"), F.min("best_head_score").alias("min"), *[
        F.percentile("best_head_score", q).alias(f"p{int(q * 100)}") for q in reports.QUANTILES])
    exact = {r.has_face: r for r in want.collect()}
    for limit in (100, 1_000_000):
        got = reports.threshold_calibration(df, limit).collect()
        assert len(got) == 3
        for r in got:
            assert r.n == exact[r.has_face].n and [r[f"p{int(q * 100)}"] for q in reports.QUANTILES] == pytest.approx(
                [exact[r.has_face][f"p{int(q * 100)}"] for q in reports.QUANTILES])
    days = [reports.threshold_sketches(df.where(F.col("best_head_score") < 0.2)), reports.threshold_sketches(df.where("best_head_score >= 0.2 or best_head_score is null"))]
    for sketches in (reports.threshold_sketches(df), reports.merge_sketches(days[0].union(days[1]))):
        for r in reports.sketched_calibration(sketches).collect():
            assert (r.n, r.min) == (exact[r.has_face].n, exact[r.has_face].min)
            known = sorted(values[r.has_face])
            for q in reports.QUANTILES:
                v = r[f"p{int(q * 100)}"]
                low, high = sum(x < v for x in known) / len(known), sum(x <= v for x in known) / len(known)
                assert low - reports.sketch_error(400) <= q <= high + reports.sketch_error(400)


def test_rasters_are_packed_whole_and_bands_look_them_up(spark):
    rng = random.Random(4)
    data = [rng.randint(0, 255) for _ in range(15)]
    masks = spark.createDataFrame([("a", "garment_mask", 5, 3, data), (None, "person_mask", 5, 3, data), ("b", "person_mask", 5, 3, None)],
                                  "source_hash string, kind string, width int, height int, data array<int>")
    row, = layout.packed_masks(masks).collect()
    grid = layout._grid(row.width, row.height, row.bits)
    assert grid.ravel().tolist() == [v >= 127.5 for v in data]
    band = pd.DataFrame([{"x": 0.0, "y": 0.0, "w": 100.0, "h": 60.0, "cols": 10, "rows": 6, "image_width": 100.0, "image_height": 60.0}]).itertuples(index=False)
    band = next(band)
    cloth, body = np.zeros((3, 5), dtype=bool), np.ones((6, 10), dtype=bool)
    assert layout._sampled(band, {}) == "background" and layout._sampled(band, {"garment_mask": cloth}) == "background"
    assert layout._sampled(band, {"garment_mask": cloth, "person_mask": body}) == "skin"
    assert layout._sampled(band, {"garment_mask": ~cloth, "person_mask": body}) == "garment"
    cloth[:, :2] = True  # samples right of the third raster column meet no cloth
    assert layout._sampled(band, {"garment_mask": cloth}) == "garment"
    assert layout._sampled(band._replace(w=0.0), {"garment_mask": ~cloth}) == "background"


def test_pages_at_any_depth(spark):
    rng = random.Random(6)
    data = [(rng.choice([None, 1, 2, 3]), f"k{i:04d}", i) for i in range(700)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "t int, k string, i int").repartition(5)
    keys = [("t", True), ("k", False)]
    want = [r[2] for r in sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
    order = [F.desc("t"), F.asc("k")]
    for shallow in (0, 10_000):
        got = lookup.page(df, order, 50, 640, shallow).collect()
        assert [r.i for r in sorted(got, key=lambda r: want.index(r.i))] == want[640:690] and all(r.has_more for r in got)
        got = lookup.page(df, order, 50, 660, shallow).collect()
        assert {r.i for r in got} == set(want[660:]) and not any(r.has_more for r in got)
    index = lookup.rank_index(df, keys, 100)
    assert [r.i for r in lookup.page_at(df, keys, index, 20, 350).collect()] == want[350:370]
    assert [r.i for r in lookup.page_at(df, keys, index, 20, 5).collect()] == want[5:25]
    last, seen = None, []
    while rows_ := lookup.page_after(df, keys, 150, last).collect():
        seen += [r.i for r in rows_]
        last = rows_[-1].asDict()
    assert seen == want
    up = [("t", False), ("k", True)]
    first = lookup.page_after(df, up, 30).collect()
    assert first[0].t is None and lookup.page_after(df, up, 400, first[-1].asDict()).count() == 400
    with pytest.raises(ValueError):
        lookup.list_products(df, df, df, 501)


def test_scorer_hooks_keep_their_contract(spark):
    images = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "source_hash string, x double")
    contract = hooks.Contract(("source_hash", "x"), "source_hash string, score double")

    def twice(batch):
        return pa.RecordBatch.from_arrays([batch.column("source_hash"), pc.multiply(batch.column("x"), 2.0)], names=["source_hash", "score"])

    assert sorted(map(tuple, hooks.score(images, twice, contract).collect())) == [("a", 2.0), ("b", 4.0)]
    bad = [
        (images.drop("x"), twice, contract), (images, twice, hooks.Contract(("x",), "source_hash string, score double")),
        (images, twice, hooks.Contract(("source_hash", "x"), "source_hash string, score float")),
        (images, lambda b: b, contract), (images, lambda b: twice(b).select(["score", "source_hash"]), contract),
    ]
    for df, hook, terms in bad:
        with pytest.raises(hooks.ContractError):
            hooks.score(df, hook, terms)

    def stranger(batch):
        return pa.RecordBatch.from_arrays([pa.array(["z"] * batch.num_rows, pa.string()), batch.column("x")], names=["source_hash", "score"])

    with pytest.raises(Exception, match="not asked about"):
        hooks.score(images, stranger, contract).collect()
    assert hooks.score(images.limit(0), twice, contract).collect() == []


def test_timing_percentiles_are_exact(spark):
    """Among 600,000 rows an approximate percentile is a rank or so off; a missing time counts behind all others."""
    ms = F.col("id") % 400
    rows = spark.range(600_000).select(F.create_map(F.lit("pose"), ms, F.lit("face"), F.when(F.col("id") % 10 < 6, ms)).alias("timings"))
    for limit in (ranking.MAX_GROUP_ROWS, 10):
        got = {r.stage: r for r in reports.timing_report(rows, limit).collect()}
        assert (got["pose"].n, got["pose"].mean_ms, got["pose"].p50_ms, got["pose"].p95_ms, got["pose"].max_ms) == (600_000, 199.5, 199, 379, 399)
        known = sorted(i for i in range(400) if i % 10 < 6)
        assert (got["face"].n, got["face"].p50_ms, got["face"].p95_ms) == (600_000, known[-(-300_000 // 1500) - 1], None)


def test_creatives_compare_numbers_and_make_texts_for_those_that_stay(spark, sf_dir):
    every = B.creatives(spark, sf_dir)
    last = ranking.last_by(B.creative_events(spark, sf_dir), ["image_id", "template_id"], F.struct("created_at", "seq", "sub_seq"))
    assert every.schema.simpleString() == B.creative_events(spark, sf_dir).schema.simpleString()
    assert every.exceptAll(last.select(*every.columns)).count() == 0 and every.count() == last.count()
    some = B.creatives(spark, sf_dir, "storage_key", "violations")
    assert some.columns == ["storage_key", "violations"] and some.exceptAll(every.select(*some.columns)).count() == 0
    for df in (every, some):
        grouped = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
        assert len(grouped) == 1 and "crt_" not in grouped[0] and "img_" not in grouped[0]
    assert "l_extendedprice" in str(every._jdf.queryExecution().executedPlan()) and "l_extendedprice" not in str(some._jdf.queryExecution().executedPlan())


def test_job_machine_reads_and_writes_a_job_once_a_call():
    """Each call on state is a round trip to the JVM: one read, one write, and a timer only where none is set before it."""
    from types import SimpleNamespace as Named

    calls, kept = [], {}
    state = Named(get=lambda: (calls.append("get"), kept.get("v"))[1], update=lambda v: (calls.append("update"), kept.update(v=v)))
    machine, clock = RowJobMachine(stale_ms=100), lambda w: Named(getCurrentWatermarkInMs=lambda: w)
    machine.init(Named(getValueState=lambda *_: state, registerTimer=lambda t: calls.append(t)))
    event = lambda ts, i, name: {"ts_ms": ts, "event_id": i, "event": name, "detail": None}
    take = lambda w, *events: list(machine.handleInputRows(("j",), iter(events), clock(w)))
    wake = lambda w: list(machine.handleExpiredTimer(("j",), clock(w), None))
    first = take(0, event(10, 2, "run"), event(5, 1, "claim"))
    assert calls == ["get", 6, "update"] and [(r.status, r.heartbeat_at, r.revision) for r in first] == [("running", 10, 1)]
    second = take(0, event(7, 3, "heartbeat"))
    assert calls[3:] == ["get", "update"] and [(r.status, r.attempts, r.revision) for r in second] == [("running", 1, 2)]
    assert wake(50) == [] and calls[5:] == ["get", 111, "update"]
    last = wake(200)
    assert [(r.status, r.stale, r.revision) for r in last] == [("pending", True, 3), ("pending", False, 4)] and last[0].silent_since == 10
    assert kept["v"][-1] == "[]"
