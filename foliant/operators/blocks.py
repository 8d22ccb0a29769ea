"""Content blocks of a page: typing, projection, formula numbers, text of content items, prompts and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X

# Block type of each layout label; other labels have none.
BLOCK_TYPES = {
    "abstract": "text", "algorithm": "code", "aside_text": "aside_text", "content": "text", "doc_title": "title", "footer": "footer", "footer_image": "footer",
    "footnote": "page_footnote", "formula_number": "formula_number", "header": "header", "header_image": "header", "number": "page_number", "paragraph_title": "title",
    "reference_content": "ref_text", "text": "text", "vertical_text": "text", "figure_title": "image_caption", "vision_footnote": "image_footnote", "image": "image",
    "chart": "chart", "seal": "image", "table": "table", "display_formula": "equation",
}
# Block types whose content is never extracted, or only with image analysis.
ALWAYS_SKIPPED = ["list", "equation_block", "image_block"]
IMAGE_TYPES = ["image", "chart"]
NOT_EXTRACTED = ["text", "title", "header", "footer", "page_number", "page_footnote", "ref_text", "table_caption", "image_caption", "table_footnote", "image_footnote", "code_caption", "phonetic"]
# Fields of a content item in the order of its text.
SCALARS = ["text", "content", "code_body", "table_body"]
LISTS = ["list_items", "table_caption", "table_footnote", "image_caption", "image_footnote", "chart_caption", "chart_footnote", "code_caption"]


def block_type(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in BLOCK_TYPES.items() for x in pair])[label]


def build_blocks(detections: DataFrame, page_w: Column, page_h: Column) -> DataFrame:
    """Detections with a block type and a box that is not empty on the page; the box in the unit square, angle, seals marked."""
    out = detections.withColumns({"type": block_type(F.col("label")), "unit": G.to_unit(G.box(*(F.col(k) for k in ("xmin", "ymin", "xmax", "ymax"))), page_w, page_h)})
    out = out.where(F.col("type").isNotNull() & F.col("unit").isNotNull())
    return out.withColumns({"sub_type": F.when(F.col("label") == "seal", "seal"), "angle": G.norm_angle(F.col("angle")) if "angle" in detections.columns else F.lit(0)})


def skip_extract(kind: Column, image_analysis: bool = False, not_extracted: list[str] | None = None) -> Column:
    skipped = set(ALWAYS_SKIPPED) | set(() if image_analysis else IMAGE_TYPES) | set(NOT_EXTRACTED if not_extracted is None else not_extracted)
    return kind.isin(*sorted(skipped))


def item_text(items: DataFrame) -> Column:
    """The text of a content item: its scalar fields (markup as text), then its lists; blanks trimmed, empty ones left out."""
    have = set(items.columns)
    parts = []
    for name in SCALARS:
        if name in have:
            own = X.trim_all(F.coalesce(F.col(name), F.lit("")))
            parts.append(F.array(X.html_to_text(own) if name.endswith("_body") else own))
    parts += [F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: X.trim_all(F.coalesce(x, F.lit("")))) for name in LISTS if name in have]
    return F.array_join(F.filter(F.flatten(F.array(*parts)), lambda x: x != ""), "\n")


def attach_numbers(blocks: DataFrame) -> DataFrame:
    """Rows (page, idx, type, content): a formula number is put as a tag on the equation before it, or on that after it
    unless another number follows there; a number that finds no equation with content is text. One window over the page."""
    w = Window.partitionBy("page").orderBy("idx")
    number, before, after, then = F.col("type") == "formula_number", F.lag("type").over(w), F.lead("type").over(w), F.lead("type", 2).over(w)
    formula = X.isolated_formula(F.coalesce("content", F.lit("")))
    whole = blocks.withColumns({"formula": formula, "tag": X.formula_tag(F.coalesce("content", F.lit("")))})
    back = number & F.coalesce(before == "equation", F.lit(False))
    forth = number & ~back & F.coalesce(after == "equation", F.lit(False)) & F.coalesce(then != "formula_number", F.lit(True))
    target = F.when(back, F.lag("formula").over(w)).when(forth, F.lead("formula").over(w))
    whole = whole.withColumns({"back": back, "forth": forth, "target": target})
    used = number & F.coalesce(F.col("target") != "", F.lit(False))
    whole = whole.withColumn("used", used)
    # an equation takes the number before it first: numbers come in order; at most one on each side
    from_before = F.coalesce(F.lag("used").over(w) & F.lag("forth").over(w), F.lit(False))
    from_after = F.coalesce(F.lead("used").over(w) & F.lead("back").over(w), F.lit(False))
    tagged = F.concat(F.col("formula"), F.when(from_before, F.concat(F.lit("\\tag{"), F.lag("tag").over(w), F.lit("}"))).otherwise(""), F.when(from_after, F.concat(F.lit("\\tag{"), F.lead("tag").over(w), F.lit("}"))).otherwise(""))
    out = whole.withColumn("content", F.when((F.col("type") == "equation") & (from_before | from_after), tagged).otherwise(F.col("content")))
    out = out.withColumn("type", F.when(F.col("type") == "formula_number", "text").otherwise(F.col("type"))).where("not used")
    return out.drop("formula", "tag", "back", "forth", "target", "used")


# The steps of a job, how far each stands, and the exit code of each end.
PROGRESS = {"queued": 0.0, "layout": 0.15, "orient": 0.3, "extract": 0.6, "merge": 0.85, "export": 0.95, "completed": 1.0, "failed": 1.0, "cancelled": 1.0}
EXIT_CODES = {"completed": 0, "failed": 1, "cancelled": 2}


def _mapped(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def progress(status: Column) -> Column:
    return F.coalesce(_mapped(PROGRESS, status), F.lit(0.0))


def exit_code(status: Column) -> Column:
    return F.coalesce(_mapped(EXIT_CODES, status), F.lit(1))


def sampling(kind: Column) -> Column:
    """Penalties by block type."""
    layout = kind == "[layout]"
    return F.struct(F.when(layout, 0.0).otherwise(1.0).alias("presence"), F.when(layout, 0.0).when(kind == "table", 0.005).otherwise(0.05).alias("frequency"))


def markdown_length(c: Column) -> Column:
    """Code points of the trimmed text, and whether it is so short (under 80) that a warning is due."""
    n = F.length(X.trim_all(c))
    return F.struct(n.alias("chars"), (n < 80).alias("short"))


def merge_sidecar(page: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Sidecar items behind the page's own, the fields of either kept."""
    return page.unionByName(sidecar, allowMissingColumns=True)
