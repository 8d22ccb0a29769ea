"""Where a model or a caller's own code plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonx
from ..functions import text as X


def model_udf(load: Callable[[], object], infer: Callable[[object, list], list], result: T.DataType):
    """A vectorised UDF of one column whose model is loaded once for each worker's run over a partition."""
    kind = pa.struct([]) if isinstance(result, T.StructType) and not result.fields else None

    @F.arrow_udf(result)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for b in batches:
            yield pa.array(infer(model, b.to_pylist()), kind or _arrow(result))

    return run


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def extract_with(blocks: DataFrame, load: Callable[[], object], infer: Callable[[object, list], list], skip: list[str] | None = None) -> DataFrame:
    """Content of the blocks (type, crop) from a model, but for types that are skipped."""
    from .blocks import skip_extract

    model = model_udf(load, infer, T.StringType())
    skipped = skip_extract(F.col("type"), not_extracted=skip)
    # the model sees null where a block is skipped: a UDF also runs on rows that `when` leaves out
    return blocks.withColumn("content", model(F.when(~skipped, F.col("crop"))))


def first_position(scores: list[float], banned: set[int]) -> tuple[int, float]:
    """Place and probability of the best score that is not banned, the first on a tie; NaN never wins."""
    import math

    best, at = -math.inf, -1
    for i, s in enumerate(scores):
        if i not in banned and not math.isnan(s) and s > best:
            best, at = s, i
    if at < 0:
        return -1, 0.0
    top = max(s for s in scores if not math.isnan(s))
    return at, math.exp(best - top) / sum(math.exp(s - top) for s in scores if not math.isnan(s))


@F.udtf(returnType="row int, col int, row_span int, col_span int, text string")
class GridCells:
    """Table function: the cells of the tables in a text of markup."""

    def eval(self, markup: str):
        from .tables import grid_of

        for _, r, c, down, right, text in grid_of(markup or ""):
            yield r, c, down, right, text


def register(spark: SparkSession) -> None:
    """Functions under SQL names: nfc, casefold_text, json_error, grid_cells."""
    spark.udf.register("nfc", X.nfc)
    spark.udf.register("casefold_text", X.casefold)
    spark.udf.register("json_error", jsonx.json_error)
    spark.udtf.register("grid_cells", GridCells)


# Characters of the codes that stand for images inside tables.
CODE = "[ACDGHKTWXYZ2345678]{4}"


def image_tokens(c, tags):
    """Codes in brackets replaced by what a map gives for them; unknown codes stay."""
    found = F.regexp_extract_all(c, F.lit(rf"\[({CODE})\]"), 1)
    return F.aggregate(F.array_distinct(found), c, lambda acc, k: F.replace(acc, F.concat(F.lit("["), k, F.lit("]")), F.coalesce(F.get(F.array(tags[k]), 0), F.concat(F.lit("["), k, F.lit("]")))))
