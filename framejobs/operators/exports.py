"""Export manifests: archive names of creatives and how each will be converted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from framejobs.functions import paths as P
from framejobs.functions.geometry import js_round
from framejobs.operators.ranking import MAX_GROUP_ROWS, bounded, rank_within
from framejobs.session import stored

FORMATS = ("jpeg", "png", "webp")
LAYOUTS = ("template", "catalog", "product")


@dataclass(frozen=True)
class ExportOptions:
    """Requested conversion; out-of-range values are ignored."""

    format: str | None = None
    scale: float | None = None
    size_min_kb: float | None = None
    size_max_kb: float | None = None

    def clamped(self) -> "ExportOptions":
        scale = self.scale
        scale = int(scale + 0.5) if scale is not None and 0 < scale <= 100 else None
        low, high = self.size_min_kb, self.size_max_kb
        sized = low is not None and high is not None and low > 0 and high >= low
        return ExportOptions(
            self.format if self.format in FORMATS else None, scale, low if sized else None, high if sized else None
        )


def export_plan(creatives: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """What converting each creative takes: nothing, a resize, a new format, a size budget."""
    o = options.clamped()
    native = F.when(F.col("mime_type") == "image/png", "png").when(F.col("mime_type") == "image/webp", "webp").otherwise("jpeg")
    target = F.lit(o.format) if o.format else native
    resize = F.lit(o.scale is not None and o.scale > 0 and o.scale != 100)
    budget = (target != "png") & F.lit(o.size_max_kb is not None)
    untouched = ~resize & (target == native) & ~budget
    ext = F.when(target == "png", "png").when(target == "webp", "webp").otherwise("jpg")
    kept = F.when(F.col("mime_type").isin("image/jpeg", "image/png", "image/webp"), P.extension_of_mime(F.col("mime_type"))).otherwise("jpg")
    width = F.when(resize, F.greatest(F.lit(1).cast("long"), js_round(F.col("width") * ((o.scale or 100) / 100.0)))).otherwise(F.col("width").cast("long"))
    return creatives.withColumns({
        "action": F.when(untouched, "copy").when(target == "png", "encode_png").when(budget, "encode_within_budget")
        .otherwise("encode"),
        "target_format": target,
        "extension": F.when(untouched, kept).otherwise(ext),
        "output_width": width,
        "max_bytes": F.when(budget, F.lit(None if o.size_max_kb is None else int(o.size_max_kb * 1024)).cast("long")),
    })


def _stem(name: Column, extension: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension) - 1)


_SUFFIX = r"-[1-9][0-9]{0,17}\z"
_SUFFIXES = r"(?:-[1-9][0-9]{0,17})+\z"


def number_collisions(manifest: DataFrame, order: list[Column], max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Give repeated archive names the suffixes -2, -3, ... in order, skipping names already taken.

    The n-th holder of a name simply gets suffix n, unless a generated name can meet one that really
    occurs (``x-2.jpg`` beside two ``x.jpg``). Such names depend on who came first; only their families
    (names that agree up to trailing numbers) go through the sequential fold.
    """
    stem = _stem(F.col("archive_name"), F.col("extension"))
    named = stored(manifest.withColumn("__family", F.regexp_replace(stem, _SUFFIXES, "")))
    counts = named.groupBy("archive_name", "extension", "__family").agg(F.count(F.lit(1)).alias("__n"))
    parent = F.concat(F.regexp_replace(stem, _SUFFIX, ""), F.lit("."), F.col("extension"))
    children = counts.filter(stem.rlike(_SUFFIX)).select(parent.alias("archive_name"), "extension", "__family")
    repeated = counts.filter(F.col("__n") > 1).select("archive_name", "extension")
    clashing = children.join(repeated, ["archive_name", "extension"], "left_semi").select("__family", "extension")
    clashing = bounded(stored(clashing.distinct()))

    family = ["__family", "extension"]
    plain = named.join(clashing, family, "left_anti").select(*manifest.columns)
    ranked = rank_within(plain, ["archive_name"], order, "__n", max_group_rows)
    suffixed = F.concat(stem, F.lit("-"), F.col("__n").cast("string"), F.lit("."), "extension")
    plain = ranked.withColumn(
        "archive_name", F.when(F.col("__n") == 1, F.col("archive_name")).otherwise(suffixed)
    ).select(*manifest.columns)

    rows = named.join(clashing, family, "left_semi").repartition(*family).sortWithinPartitions(*family, *order)
    settled = rows.select("__family", *manifest.columns).mapInPandas(
        _settle, "__family string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema)
    )
    return plain.unionByName(settled.select(*manifest.columns))


def _settle(batches):
    """Name the rows of clashing families in order. All suffixes below a base's next one are taken, so
    memory holds the distinct names of one family, not its rows."""
    current, seen, following = None, set(), {}

    def taken(stem: str) -> bool:
        base, _, number = stem.rpartition("-")
        generated = number.isdigit() and number[0] != "0" and 2 <= int(number) < following.get(base, 2)
        return stem in seen or generated

    for pdf in batches:
        names = []
        for family, extension, name in zip(pdf["__family"], pdf["extension"], pdf["archive_name"]):
            if (family, extension) != current:
                current, seen, following = (family, extension), set(), {}
            stem = name[: -(len(extension) + 1)]
            if taken(stem):
                n = following.get(stem, 2)
                while f"{stem}-{n}" in seen:
                    n += 1
                following[stem] = n + 1
                stem = f"{stem}-{n}"
            else:
                seen.add(stem)
            names.append(f"{stem}.{extension}")
        yield pdf.assign(archive_name=names)


def export_manifest(
    creatives: DataFrame, images: DataFrame, products: DataFrame, imports: DataFrame, templates: DataFrame,
    layout: str = "template", options: ExportOptions = ExportOptions(), order: list[Column] | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Archive path of every creative under one of three layouts, repeated names numbered.

    template: <template>/<product>.<ext>; catalog: the path inside the import; product: flat file names.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    planned = export_plan(creatives, options)
    named = planned.join(products.select("product_id", "product_name", "import_id"), "product_id", "left")
    if layout == "template":
        labels = templates.select("template_id", F.col("name").alias("__template"))
        named = named.join(bounded(labels), "template_id", "left")
        path = F.concat(
            P.safe_name(F.coalesce("__template", F.lit("template"))), F.lit("/"),
            P.safe_name(F.coalesce("product_name", F.lit("product"))), F.lit("."), F.col("extension"),
        )
    else:
        files = images.select("image_id", "file_name", "relative_path")
        named = named.join(files, "image_id", "left")
        if layout == "catalog":
            roots = imports.select("import_id", F.col("name").alias("__import"))
            named = named.join(bounded(roots), "import_id", "left")
            path = P.catalog_path(
                F.coalesce("relative_path", "image_id"), F.col("extension"), F.coalesce("__import", F.lit(""))
            )
        else:
            base = F.regexp_replace(F.coalesce("file_name", "image_id"), r"\.[^./]+\z", "")
            base = F.when(base == "", "untitled").otherwise(base)
            path = F.concat(P.safe_segment(base), F.lit("."), F.col("extension"))
    keep = [*creatives.columns, "action", "extension", "output_width", "max_bytes"]
    manifest = named.withColumn("archive_name", path).select(*keep, "archive_name")
    order = order or [F.desc("created_at"), F.asc("creative_id")]
    return number_collisions(manifest, order, max_group_rows)


def archive_file_name(layout: str, import_names: list[str], product: str | None = None, label: str = "all-creatives") -> str:
    """Name of the archive itself: the import's or product's name when there is exactly one."""
    illegal = str.maketrans({c: "_" for c in '<>:"/\\|?*'})
    clean = lambda v: v.translate(illegal).strip(" .\t\n") or "untitled"
    if layout == "product":
        return clean(product or "product") + ".zip"
    if layout == "catalog" and len(set(import_names)) == 1:
        return clean(import_names[0]) + ".zip"
    return f"export-{label}.zip"
