"""Keyed lookups: usable analyses, primary images, names, assets, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framejobs import vocab
from framejobs.operators.ranking import bounded, last_by, previous_within, rank_within

_RECENCY = ("created_at", "engine_version")


def latest_analyses(analyses: DataFrame) -> DataFrame:
    """Newest analysis of each content hash, whatever version produced it."""
    return last_by(analyses, ["source_hash"], F.struct(*_RECENCY))


def usable_analyses(analyses: DataFrame, engine_version: str) -> DataFrame:
    """The current version's row when it is ready, else the newest row of any status if that is ready.

    An older ready row behind a newer failed one is not used. One aggregate, two conditional picks.
    """
    fields = [c for c in analyses.columns if c != "source_hash"]
    row = F.struct(*fields)
    good = (F.col("status") == "ready") & (F.col("schema_version") != 0)
    current = good & (F.col("engine_version") == engine_version)
    picked = analyses.groupBy("source_hash").agg(
        F.max_by(F.when(current, row), F.when(current, F.struct(*_RECENCY))).alias("current"),
        F.max_by(row, F.struct(*_RECENCY)).alias("latest"),
    )
    latest_good = (F.col("latest.status") == "ready") & (F.col("latest.schema_version") != 0)
    chosen = picked.withColumn("stale", F.col("current").isNull()).withColumn(
        "row", F.coalesce("current", F.when(latest_good, F.col("latest")))
    ).filter(F.col("row").isNotNull())
    return chosen.select("source_hash", *[F.col(f"row.{c}").alias(c) for c in fields], "stale")


def with_analysis(images: DataFrame, usable: DataFrame, columns: list[str]) -> DataFrame:
    return images.join(usable.select("source_hash", *columns), "source_hash", "left")


def merge_analyses(current: DataFrame, incoming: DataFrame, failures: DataFrame) -> DataFrame:
    """Upsert by (hash, version): status, error and time come from the newest write of any kind, everything else from
    the newest success. At equal times an incoming success beats a stored row, and a failure beats both.

    ``failures`` carries source_hash, engine_version, status, error, created_at.
    """
    keys, event = ["source_hash", "engine_version"], ["status", "error", "created_at"]
    payload = [c for c in current.columns if c not in (*keys, *event)]
    rows = current.select(*keys, *event, F.lit(0).alias("__kind"), F.struct(*payload).alias("__payload")).unionByName(
        incoming.select(*keys, *event, F.lit(1).alias("__kind"), F.struct(*payload).alias("__payload"))
    ).unionByName(failures.select(*keys, *event, F.lit(2).alias("__kind")), allowMissingColumns=True)
    order = F.struct("created_at", "__kind")
    merged = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*event), order).alias("__event"),
        F.max_by("__payload", F.when(F.col("__kind") < 2, order)).alias("__payload"),
    )
    return merged.select(*[
        (F.col(c) if c in keys else F.col(f"__event.{c}") if c in event else F.col(f"__payload.{c}")).alias(c)
        for c in current.columns
    ])


def version_diff(analyses: DataFrame) -> DataFrame:
    """What changed between consecutive analyses of the same bytes."""
    watched = ["engine_version", "status", "shot_type", "garment_type"]
    out = previous_within(analyses, ["source_hash"], [F.col(c) for c in _RECENCY], watched)
    changed = F.array_compact(F.array(*[
        F.when(~F.col(c).eqNullSafe(F.col(f"prev_{c}")), F.lit(c)) for c in ("status", "shot_type", "garment_type")
    ]))
    return out.filter(F.col("prev_engine_version").isNotNull()).select(
        "source_hash", F.col("prev_engine_version").alias("from_version"),
        F.col("engine_version").alias("to_version"), changed.alias("changed"),
    )


def with_primary(products: DataFrame, images: DataFrame) -> DataFrame:
    """One image per product: the named primary, else the flagged one, else the first.

    The named image joins on its unique id and the fallback is a partial aggregate, so a product
    with very many images never concentrates in one task.
    """
    fields = [c for c in images.columns if c != "product_id"]
    preference = F.struct(~F.col("is_primary"), F.col("position"), F.col("created_at"), F.col("image_id"))
    fallback = images.groupBy("product_id").agg(F.min_by(F.struct(*fields), preference).alias("__fallback"))
    named = images.select(
        F.col("image_id").alias("primary_image_id"), "product_id", F.struct(*fields).alias("__named")
    )
    joined = products.join(fallback, "product_id").join(named, ["primary_image_id", "product_id"], "left")
    own = [c for c in products.columns if c not in fields]
    return joined.withColumn("__image", F.coalesce("__named", "__fallback")).select(
        *own, *[F.col(f"__image.{c}").alias(c) for c in fields]
    )


def creative_keys_for_import(creatives: DataFrame, images: DataFrame, import_id: str) -> DataFrame:
    wanted = images.filter(F.col("import_id") == import_id).select("image_id")
    return creatives.join(wanted, "image_id").select("storage_key")


def list_creatives(creatives: DataFrame, products: DataFrame, templates: DataFrame) -> DataFrame:
    """Creatives with product and template names; a missing name shows a dash or the id."""
    names = products.select("product_id", "product_name")
    labels = templates.select("template_id", F.col("name").alias("__label"))
    joined = creatives.join(names, "product_id", "left").join(bounded(labels), "template_id", "left")
    return joined.withColumn("product_name", F.coalesce("product_name", F.lit("—"))).withColumn(
        "template_name", F.coalesce("__label", "template_id")
    ).drop("__label")


def asset_pivot(derived: DataFrame) -> DataFrame:
    """One row per content hash with the key of each derived asset."""
    kinds = {"preview": "preview", "person_mask": "person_mask", "garment_mask": "garment_mask", "cutout": "cutout"}
    return derived.groupBy("source_hash").agg(*[
        F.max(F.when(F.col("kind") == kind, F.col("storage_key"))).alias(name) for name, kind in kinds.items()
    ])


def filter_products(
    products: DataFrame, import_id: str | None = None, category: str | None = None,
    folder_prefix: str | None = None, search: str | None = None,
) -> DataFrame:
    """Catalogue filters; text is matched without regard to ASCII case, ``%`` and ``_`` as wildcards."""
    out = products
    if import_id:
        out = out.filter(F.col("import_id") == import_id)
    if category:
        out = out.filter(F.col("category") == category)
    if folder_prefix:
        out = out.filter(F.col("folder_path").ilike(_like(folder_prefix) + "%"))
    if search:
        pattern = f"%{_like(search)}%"
        out = out.filter(F.col("product_name").ilike(pattern) | F.col("folder_path").ilike(pattern))
    return out


def _like(text: str) -> str:
    return text.replace("\\", "\\\\")


#: Rows a page may reach into a table by a plain top-k; deeper ones are found by rank or by an index of ranks.
SHALLOW = 10_000
MAX_PAGE, MAX_SAMPLE = 500, 12


def _checked(value: int, low: int, high: int, what: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{what} must be from {low} to {high}")
    return value


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, shallow: int = SHALLOW) -> DataFrame:
    """One page plus whether more rows follow. The order is total.

    A shallow page is a top-k. For a deep one rows are ranked over many tasks and those of the page are kept, so no task
    takes the rows before it; who pages on and on should use ``page_after``, or ``rank_index`` for jumps.
    """
    if offset + limit <= shallow:
        first = df.orderBy(*order).limit(offset + limit + 1)
        numbered = first.withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    else:
        numbered = rank_within(df, [], order, "__n", 0)
    window = numbered.where(F.col("__n").between(offset + 1, offset + limit + 1)).withColumn("__n", F.col("__n") - offset)
    more = F.max("__n").over(Window.partitionBy(F.lit(0))) > limit
    return window.withColumn("has_more", more).filter(F.col("__n") <= limit).drop("__n")


def _order(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.desc(k) if down else F.asc(k) for k, down in keys]


def _behind(keys: list[tuple[str, bool]], last: dict) -> Column:
    """Rows that come after ``last`` in the order ``keys`` of (column, descending); nulls first ascending, last descending."""
    hit, equal = F.lit(False), F.lit(True)
    for name, down in keys:
        column, value = F.col(name), last[name]
        if value is None:
            beyond = F.lit(False) if down else column.isNotNull()
        else:
            beyond = (column < F.lit(value)) | column.isNull() if down else column > F.lit(value)
        hit, equal = hit | (equal & beyond), equal & column.eqNullSafe(F.lit(value))
    # The leading key alone, once more: a plain comparison that reaches the statistics of the files.
    name, down = keys[0]
    if last[name] is None:
        return hit
    bound = (F.col(name) <= F.lit(last[name])) | F.col(name).isNull() if down else F.col(name) >= F.lit(last[name])
    return bound & hit


def page_after(df: DataFrame, keys: list[tuple[str, bool]], limit: int, last: dict | None = None) -> DataFrame:
    """The page behind the row ``last`` (the values of its keys): a filter and a top-k of ``limit`` rows, however deep."""
    return (df if last is None else df.where(_behind(keys, last))).orderBy(*_order(keys)).limit(limit)


def rank_index(df: DataFrame, keys: list[tuple[str, bool]], every: int) -> DataFrame:
    """The keys of each ``every``-th row with its rank: made once, over many tasks, for jumps to any page."""
    names = [k for k, _ in keys]
    ranked = rank_within(df.select(*names), [], _order(keys), "rank", 0)
    return ranked.where(F.col("rank") % every == 0).select("rank", *names)


def page_at(df: DataFrame, keys: list[tuple[str, bool]], index: DataFrame, limit: int, offset: int) -> DataFrame:
    """The page at ``offset`` by an index of ranks: one slice behind the nearest indexed row is read."""
    near = index.where(F.col("rank") <= offset).orderBy(F.desc("rank")).limit(1).collect()
    last, skipped = (near[0].asDict(), near[0]["rank"]) if near else (None, 0)
    return page_after(df, keys, offset - skipped + limit, last).withColumn(
        "__n", F.row_number().over(Window.orderBy(*_order(keys)))).where(F.col("__n") > offset - skipped).drop("__n")


def list_products(products: DataFrame, images: DataFrame, usable: DataFrame, limit: int = 60, offset: int = 0) -> DataFrame:
    """A page of products with the primary image and its analysis; joins touch the page only."""
    shown = page(products, [F.desc("created_at"), F.asc("product_id")], _checked(limit, 1, MAX_PAGE, "limit"), offset)
    keep = ["image_id", "product_id", "source_hash", "file_name", "is_primary", "position", "vision_status"]
    wanted = images.join(F.broadcast(shown.select("product_id")), "product_id", "left_semi")
    primary = with_primary(shown, wanted.select(*keep, F.col("created_at").alias("created_at")))
    summary = usable.select("source_hash", "shot_type", "garment_type", "overall_confidence", "stale")
    hashes = F.broadcast(primary.select("source_hash").distinct())
    return primary.join(summary.join(hashes, "source_hash", "left_semi"), "source_hash", "left")


def product_detail(product_id: str, images: DataFrame, usable: DataFrame, assets: DataFrame) -> DataFrame:
    """Every image of one product with its analysis and derived assets."""
    own = images.filter(F.col("product_id") == product_id)
    summary = usable.select("source_hash", "shot_type", "garment_type", "overall_confidence", "stale")
    return own.join(summary, "source_hash", "left").join(assets, "source_hash", "left").orderBy("position")


def diverse_sample(
    images: DataFrame, usable: DataFrame, n: int = 6, pinned: str | None = None, product: str | None = None
) -> DataFrame:
    """Images that show a template off: the pinned one, one per shot type, then the most confident.

    With ``product`` the result is simply that product's analysed images in order.
    """
    fields = ["image_id", "product_id", "source_hash", "arrival_order", "shot_type", "overall_confidence"]
    analysed = images.filter(F.col("vision_status") == "ready")
    if product:
        own = analysed.filter(F.col("product_id") == product).withColumn("arrival_order", F.col("position"))
        return own.join(usable.select("source_hash", "shot_type", "overall_confidence"), "source_hash").select(*fields)
    _checked(n, 1, MAX_SAMPLE, "n")
    pool = images if pinned else analysed
    order = F.struct("created_at", "image_id")
    pool = pool.withColumn("arrival_order", order).join(
        usable.select("source_hash", "shot_type", "overall_confidence"), "source_hash"
    )
    is_pinned = F.lit(False) if pinned is None else F.col("image_id") == pinned
    eligible = pool.filter(is_pinned | (F.col("vision_status") == "ready")).withColumn("__pinned", is_pinned)
    # Earliest per shot type, the pinned image standing for its own type: at most nine rows.
    firsts = eligible.groupBy("shot_type").agg(
        F.min_by("image_id", F.struct(~F.col("__pinned"), F.col("arrival_order"))).alias("__first")
    )
    marked = eligible.join(F.broadcast(firsts), "shot_type").withColumn(
        "__stage", F.when(F.col("__pinned"), 0).when(F.col("image_id") == F.col("__first"), 1).otherwise(2)
    )
    rank = [
        F.asc("__stage"), F.desc(F.when(F.col("__stage") == 2, F.col("overall_confidence"))), F.asc("arrival_order"),
    ]
    return marked.orderBy(*rank).limit(n).select(*fields, F.col("__stage").alias("stage"))


def head_frameable(shot_type: Column) -> Column:
    return shot_type.isin(*vocab.HEAD_FRAMEABLE_SHOTS)
