"""Hand-derived cases for the column expressions."""

from pyspark.sql import functions as F

from framejobs.functions import geometry as G, paths as P, rules as R, text as X
from framejobs.operators import planning


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


def test_natural_order(spark):
    names = ["look-10", "look-2", "Look-1", "look-02b", "a", "1", "look-2a"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(P.natural_key(F.col("n")), "n").collect()]
    assert got == ["1", "a", "Look-1", "look-2", "look-2a", "look-02b", "look-10"]


def test_display_names_and_slugs(spark):
    assert one(spark, P.display_name(F.lit("  RED-DRESS_front__01.jpg ")))[0].startswith("RED-DRESS front 01")
    cases = {
        "Crème Brûlée": "creme-brulee", "ﬁne ½ Ǆ": "fine-1-2-dz", "---": "item", "日本": "item", "Ａ１": "a1",
        "x" * 90: "x" * 80, "ÅNGSTRÖM": "angstrom", "été": "ete", "Straße": "stra-e",
    }
    got = one(spark, *[P.slugify(F.lit(k)) for k in cases])
    assert got == tuple(cases.values())


def test_classification_order(spark):
    def reason(path, name, mime, size):
        return P.skip_reason(F.lit(path), F.lit(name), F.lit(mime).cast("string"), F.lit(size))

    got = one(
        spark, reason("a/.DS_Store", ".DS_Store", None, 0), reason("a/b.jpg", "b.jpg", "text/plain", 5),
        reason("a/b.jpg", "b.jpg", "", 5), reason("a/b.bin", "b.bin", "image/png", 5),
        reason("a/b.jpg", "b.jpg", None, 64 * 1024 * 1024 + 1), reason("a/b.jpg", "b.jpg", None, 0),
        reason("x/~$b.jpg", "~$b.jpg", None, 5), reason("Thumbs.DB/b.jpg", "b.jpg", None, 5),
    )
    assert got == (
        "system_file", "unsupported_type", None, None, "too_large", "empty", "system_file", "system_file",
    )


def test_globs(spark):
    cases = [
        ("aw25/x", "aw25/**/x", True), ("aw25/a/b/x", "aw25/**/x", True), ("aw25/ab", "aw25/?", False),
        ("a.b", "a.b", True), ("axb", "a.b", False), ("a\n", "a", False), ("anything", "", False), ("a/b", "*", False),
    ]
    got = one(spark, *[R.glob_matches(F.lit(v), F.lit(p)) for v, p, _ in cases])
    assert got == tuple(want for *_, want in cases)


def test_specificity_and_budget(spark):
    assert one(
        spark, R.specificity(F.lit("folder"), F.lit("equals"), F.lit("AW25/dresses")),
        R.specificity(F.lit("default"), F.lit("any"), F.lit("")), planning.retry_budget(F.lit("ai_extend")),
        planning.retry_budget(F.lit("solid")),
    ) == (452, 0, 77, 3)


def test_substitution_is_single_pass(spark):
    values = F.create_map(F.lit("a"), F.lit("{{b}}"), F.lit("b"), F.lit("no"))
    assert one(spark, X.substitute(F.lit("{{a}}-{{c}}-{x}-{{ a }}-{{{b}}}"), values))[0] == "{{b}}-{{c}}-{x}-{{ a }}-{no}"


def test_fill_key_and_prompt(spark):
    over = F.struct(*[F.lit(v).alias(n) for n, v in (("left", 10.4), ("top", 0.0), ("right", 3.5), ("bottom", 0.0))])
    key, one_edge, three = one(
        spark, X.fill_key(over, F.lit("")), X.fill_prompt(F.lit(" base "), F.array(F.lit("bottom"))),
        X.fill_prompt(F.lit("base"), F.array(F.lit("top"), F.lit("left"), F.lit("right"))),
    )
    assert key == "aiextend_10_0_4_0_e3b0c44298fc"
    assert one_edge.startswith("base except at the bottom edge of the frame")
    assert three.startswith("base except at the top left and right edges of the frame")


def test_catalog_path(spark):
    path = lambda p, name: P.catalog_path(F.lit(p), F.lit("webp"), F.lit(name))
    assert one(spark, path("Men/MADA:01/look.1.jpg", "Men"), path("Men", "Men"), path("a//b.png", "")) == (
        "MADA_01/look.1.webp", "untitled.webp", "a/b.webp",
    )


def test_rounding_and_iou(spark):
    a = G.box(*[F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)])
    b = G.box(*[F.lit(v) for v in (1.0, 0.0, 3.0, 2.0)])
    got = one(spark, G.js_round(F.lit(-2.5)), G.js_round(F.lit(2.5)), G.iou(a, b), G.iou(a, G.box(*[F.lit(9.0)] * 4)))
    assert got[:2] == (-2, 3) and abs(got[2] - 1 / 3) < 1e-12 and got[3] == 0.0


def test_report_text(spark):
    assert one(
        spark, X.format_bytes(F.lit(1536)), X.format_bytes(F.lit(5 * 1024**2)), X.format_bytes(F.lit(0)),
        X.format_duration(F.lit(61_500)), X.format_seconds(F.lit(3_720)), X.percent(F.lit(0.256), 1), X.humanize(F.lit("full_body")),
    ) == ("2 KB", "5.0 MB", "0 KB", "1m 2s", "1h 2m", "25.6%", "Full body")
