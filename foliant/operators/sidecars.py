"""Documents beside each other: the model's and the middle stage's own JSON, joined by the stem of their names; and streams of
packets of which single ones are damaged.

`<stem>_model.json` holds a list of pages, each a list of items; `<stem>_middle.json` an object with the pages' blocks.
Numbers that are floats keep their point. Of a content list `<stem>_content_list.json` the confidence is that of all scores in
whichever of the two documents there are.

Packets are decoded one by one; a damaged one is left out and counted, and a clip fails only if nothing of it is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import walked_scores
from ..functions.text import image_targets, is_local_target
from .layout import let

SUFFIXES = ("content_list", "middle", "model")


def _by_page(rows: DataFrame, stem: str, item: Column) -> DataFrame:
    """(stem, pages): for each stem its items (page, idx, item) in order, an array for each page. Rows meet once, by stem; pages are cut
    out of a stem's row where the page number changes."""
    own = rows.groupBy(stem).agg(F.array_sort(F.collect_list(F.struct("page", "idx", item.alias("item")))).alias("items"))
    first = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | ~F.get(a, i)["page"].eqNullSafe(F.get(a, i - 1)["page"]))
    cut = lambda a, starts: F.transform(starts, lambda at, k: F.slice(a, at + 1, F.coalesce(F.get(starts, k + 1), F.size(a)) - at))
    return own.select(stem, let(F.col("items"), lambda a: let(first(a), lambda starts: cut(a, starts))).alias("pages"))


def model_documents(items: DataFrame, stem: str = "stem") -> DataFrame:
    """(path, json): items (stem, page, idx, type, bbox, angle, content, score) to a document for each stem, pages in order."""
    item = F.struct("type", F.col("bbox").cast("array<double>").alias("bbox"), F.col("angle").cast("int").alias("angle"), "content", F.col("score").cast("double").alias("score"))
    whole = _by_page(items, stem, item)
    return whole.select(F.concat(F.col(stem), F.lit("_model.json")).alias("path"), F.to_json(F.transform("pages", lambda p: F.transform(p, lambda x: x["item"]))).alias("json"))


def middle_documents(blocks: DataFrame, stem: str = "stem") -> DataFrame:
    """(path, json): blocks (stem, page, idx, type, text, confidence) to a document for each stem."""
    block = F.struct("type", "text", F.col("confidence").cast("double").alias("confidence"))
    whole = _by_page(blocks, stem, block)
    info = F.transform("pages", lambda p: F.struct(F.get(p, 0)["page"].alias("page_idx"), F.transform(p, lambda x: x["item"]).alias("para_blocks")))
    return whole.select(F.concat(F.col(stem), F.lit("_middle.json")).alias("path"), F.to_json(F.struct(info.alias("pdf_info"))).alias("json"))


def stemmed(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with `stem` (the folder included) and `kind`, one of SUFFIXES; others are left out."""
    pattern = rf"^(.*)_({'|'.join(SUFFIXES)})\.json$"
    out = files.withColumns({"stem": F.regexp_extract(path, pattern, 1), "kind": F.regexp_extract(path, pattern, 2)})
    return out.where("kind <> ''")


def confidence_by_stem(files: DataFrame) -> DataFrame:
    """For each content list of files (path, json): stem, n and mean of the scores in its middle and model documents;
    0 and null where there are none."""
    own = stemmed(files)
    scores = walked_scores(own.where("kind <> 'content_list'"), "stem", "json").select(F.col("id").alias("stem"), "score", F.lit(False).alias("listed"))
    lists = own.where("kind = 'content_list'").select("stem", F.lit(None).cast("double").alias("score"), F.lit(True).alias("listed"))
    # lists and scores meet in one aggregate: half of it is done before the shuffle, and nothing is sorted
    both = lists.unionByName(scores).groupBy("stem").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.max("listed").alias("listed"))
    return both.where("listed").select("stem", "n", "mean")


def decoded_packets(packets: DataFrame, samples: Column) -> tuple[DataFrame, DataFrame]:
    """Frames (clip, seq, samples) of the packets (clip, seq, payload) that decode, and for each clip how many were `kept` and
    `skipped`, with an `error` if nothing is left. `samples` is null for a damaged packet, an empty array for one without sound."""
    rows = packets.withColumn("samples", samples)
    good = rows.where("samples IS NOT NULL")
    told = rows.groupBy("clip").agg(F.count("samples").alias("kept"), F.count_if(F.col("samples").isNull()).alias("skipped"), F.coalesce(F.sum(F.when(F.col("samples").isNotNull(), F.size("samples"))), F.lit(0)).alias("n"))
    told = told.select("clip", "kept", "skipped", F.when(F.col("n") == 0, "no sound is left").alias("error"))
    return good.select("clip", "seq", "samples"), told


def pcm16(payload: Column) -> Column:
    """Samples of little-endian 16-bit PCM given in hexadecimal; null if it is damaged: no hexadecimal, or half a sample."""
    sound = payload.rlike("^([0-9A-Fa-f]{4})*$")
    words = F.filter(F.regexp_extract_all(payload, F.lit("[0-9A-Fa-f]{4}"), 0), lambda w: w != "")
    value = lambda w: F.conv(F.concat(F.right(w, F.lit(2)), F.left(w, F.lit(2))), 16, 10).cast("int")
    return F.when(sound, F.transform(words, lambda w: (value(w) - F.when(value(w) >= 32768, 65536).otherwise(0)) / 32768.0))


def present_images(texts: DataFrame, files: DataFrame, base: str, id: str = "id", text: str = "text") -> DataFrame:
    """Texts (id, text) whose relative image targets become file URIs under `base` where `files` (name, relative to base) has
    them; targets that are missing, and those with a scheme, stay as they are. A text's targets meet the files by a join."""
    target = F.explode(F.array_distinct(F.filter(image_targets(F.col(text)), lambda t: is_local_target(t) & ~t.startswith("/"))))
    asked = texts.select(F.col(id).alias("id_"), target.alias("name"))
    there = asked.join(files.select("name").distinct(), "name", "left_semi").groupBy("id_").agg(F.collect_set("name").alias("names_"))
    out = texts.join(there, F.col(id) == F.col("id_"), "left")
    folder = base.rstrip("/") + "/"
    # each target ends with its bracket or a title after a blank, so one name is never found within another's
    link = lambda done, n, end: F.replace(done, F.concat(F.lit("]("), n, F.lit(end)), F.concat(F.lit(f"](file://{folder}"), n, F.lit(end)))
    made = F.aggregate(F.coalesce("names_", F.array().cast("array<string>")), F.col(text), lambda done, n: link(link(done, n, ")"), n, " "))
    return out.withColumn(text, made).drop("id_", "names_")
