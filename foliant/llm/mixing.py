"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Token counts of the cells (source, language, topic) are raked in turn to the target share of each
margin; after ITERATIONS rounds the cells' shares follow all three. A document of a cell is then
kept with chance min(1, s * wanted / available); s is calibrated so that the kept tokens add up to
`fraction` of the corpus although no cell can give more than it has.

One aggregation with map-side combining makes the cells, whose number is that of distinct
(source, language, topic) and not of documents, so a hot source is one row for each task. Raking
runs on the cells in one partition: no shuffle in any round. The chances come back by a broadcast
of the cells up to BROADCAST_CELLS, else by a join on the three keys.

Whether a document is kept depends on its id and the seed only: equal at any partitioning and
after any lost executor.

Cases: a null source or language is a value of its own ('(none)'); a null or empty text has 0
tokens and topic 'empty'; a null doc_id is replaced by the text's digest; repeated rows get equal
answers; cells without tokens get chance 0 unless nothing has tokens; an empty table gives an
empty result. Extra columns are carried through `sample` and not read; `mixed` replaces columns named mix_*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words_native

ITERATIONS = 12
CALIBRATIONS = 8
#: Target share of a value: its token share to this power, scaled to 1. 1 leaves the mix, 0 levels it.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
FRACTION = 0.5
SEED = "mix-1"
BROADCAST_CELLS = 100_000
MARGINS = ["source", "lang", "topic"]


def surface_topic(text: Column) -> Column:
    """What kind of text it is, by its characters: empty, symbols, figures or prose."""
    n = F.length(text)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when(100 * F.regexp_count(text, F.lit("[#*$%&|<>]")) > 5 * n, "symbols")
        .when(100 * F.regexp_count(text, F.lit("[0-9]")) > 2 * n, "figures")
        .otherwise("prose")
    )


def keyed(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """docs with the margins as mix_source, mix_lang, mix_topic."""
    none = F.lit("(none)")
    topic = surface_topic(F.col("text")) if topic is None else topic
    return docs.withColumns({"mix_source": F.coalesce("source", none), "mix_lang": F.coalesce("lang", none), "mix_topic": F.coalesce(topic, none)})


def _share(value: str, targets: dict | float, tokens: str) -> Column:
    """Target share of the value in column `value`, from a power or from given shares."""
    if isinstance(targets, dict):
        given = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))])
        own = F.coalesce(given[F.col(value)], F.lit(0.0))
    else:
        own = F.pow(F.sum(tokens).over(Window.partitionBy(value)), F.lit(float(targets)))
    return own


def rake(cells: DataFrame, targets: dict[str, dict | float] | None = None, fraction: float = FRACTION, iterations: int = ITERATIONS) -> DataFrame:
    """cells (mix_source, mix_lang, mix_topic, tokens) with `share` (raked) and `chance`."""
    targets = targets or TEMPER
    everything = Window.partitionBy(F.lit(0))
    cells = cells.coalesce(1).withColumn("tokens", F.col("tokens").cast("double"))
    for m in MARGINS:
        cells = cells.withColumn(f"own_{m}", _share(f"mix_{m}", targets[m], "tokens"))
        # each value counts once: its cells share it by their tokens
        within = F.sum("tokens").over(Window.partitionBy(f"mix_{m}"))
        cells = cells.withColumn(f"part_{m}", F.when(within > 0, F.col(f"own_{m}") * F.col("tokens") / within).otherwise(0.0))
        cells = cells.withColumn(f"want_{m}", F.col(f"own_{m}") / F.sum(f"part_{m}").over(everything)).drop(f"own_{m}", f"part_{m}")
    total = F.sum("tokens").over(everything)
    cells = cells.withColumn("all_tokens", total).withColumn("share", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0))
    for _ in range(iterations):
        for m in MARGINS:
            now = F.sum("share").over(Window.partitionBy(f"mix_{m}"))
            cells = cells.withColumn("share", F.when(now > 0, F.col("share") * F.col(f"want_{m}") / now).otherwise(0.0))
    cells = cells.withColumn("rate", F.when(F.col("tokens") > 0, F.col("share") * fraction * F.col("all_tokens") / F.col("tokens")).otherwise(0.0)).withColumn("s", F.lit(1.0))
    for _ in range(CALIBRATIONS):
        full = F.col("s") * F.col("rate") >= 1
        held = F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).over(everything)
        free = F.sum(F.when(full, 0.0).otherwise(F.col("rate") * F.col("tokens"))).over(everything)
        cells = cells.withColumns({"held": held, "free": free}).withColumn("s", F.when(F.col("free") > 0, F.greatest(F.lit(0.0), fraction * F.col("all_tokens") - F.col("held")) / F.col("free")).otherwise(F.col("s")))
    chance = F.when(F.col("all_tokens") == 0, F.lit(float(fraction))).otherwise(F.least(F.lit(1.0), F.col("s") * F.col("rate")))
    return cells.select("mix_source", "mix_lang", "mix_topic", "tokens", "share", chance.alias("chance"))


def draw(seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the document's id (or text) and the seed alone."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)


def mixed(docs: DataFrame, targets: dict | None = None, fraction: float = FRACTION, topic: Column | None = None, seed: str = SEED) -> DataFrame:
    """All columns of docs, and mix_source, mix_lang, mix_topic, mix_chance, mix_kept."""
    rows = keyed(docs, topic)
    keys = ["mix_source", "mix_lang", "mix_topic"]
    cells = stored(rows.groupBy(*keys).agg(F.sum(words_native(F.col("text"))).alias("tokens")), "cells")
    chances = stored(rake(cells, targets, fraction), "chances").select(*keys, F.col("chance").alias("mix_chance"))
    few = F.broadcast(chances) if chances.count() <= BROADCAST_CELLS else chances
    return rows.join(few, keys, "left").withColumn("mix_kept", draw(seed) < F.col("mix_chance"))


def sample(docs: DataFrame, **how) -> DataFrame:
    """The documents drawn, with their own columns whatever their names."""
    return mixed(docs.select(F.struct("*").alias("mix_row"), "doc_id", "text", "source", "lang"), **how).where("mix_kept").select("mix_row.*")


def oracle(iterations: int = ITERATIONS) -> str:
    """The same in DuckDB's SQL, round by round."""
    steps = [
        """docs AS (SELECT doc_id, text, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty'
       WHEN 100 * len(regexp_extract_all(text, '[#*$%&|<>]')) > 5 * length(text) THEN 'symbols'
       WHEN 100 * len(regexp_extract_all(text, '[0-9]')) > 2 * length(text) THEN 'figures' ELSE 'prose' END AS topic,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents)""",
        "c0 AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM docs GROUP BY ALL)",
    ]
    for i, m in enumerate(MARGINS):
        steps.append(f"c{i}a AS (SELECT *, pow(sum(tokens) OVER (PARTITION BY {m}), {TEMPER[m]}) AS own, sum(tokens) OVER (PARTITION BY {m}) AS within_ FROM c{i})")
        steps.append(f"c{i + 1} AS (SELECT * EXCLUDE (own, within_), own / sum(CASE WHEN within_ > 0 THEN own * tokens / within_ ELSE 0 END) OVER () AS want_{m} FROM c{i}a)")
    steps.append("r0 AS (SELECT *, sum(tokens) OVER () AS all_tokens, tokens / sum(tokens) OVER () AS share FROM c3)")
    k = 0
    for _ in range(iterations):
        for m in MARGINS:
            steps.append(f"r{k + 1} AS (SELECT * REPLACE (CASE WHEN sum(share) OVER (PARTITION BY {m}) > 0 THEN share * want_{m} / sum(share) OVER (PARTITION BY {m}) ELSE 0 END AS share) FROM r{k})")
            k += 1
    steps.append(f"s0 AS (SELECT *, CASE WHEN tokens > 0 THEN share * {FRACTION} * all_tokens / tokens ELSE 0 END AS rate, CAST(1 AS DOUBLE) AS s FROM r{k})")
    for j in range(CALIBRATIONS):
        steps.append(f"s{j}a AS (SELECT *, sum(CASE WHEN s * rate >= 1 THEN tokens ELSE 0 END) OVER () AS held, sum(CASE WHEN s * rate >= 1 THEN 0 ELSE rate * tokens END) OVER () AS free FROM s{j})")
        steps.append(f"s{j + 1} AS (SELECT * EXCLUDE (held, free) REPLACE (CASE WHEN free > 0 THEN greatest(0, {FRACTION} * all_tokens - held) / free ELSE s END AS s) FROM s{j}a)")
    steps.append(f"chance AS (SELECT source, lang, topic, CASE WHEN all_tokens = 0 THEN {FRACTION} ELSE least(1.0, s * rate) END AS chance FROM s{CALIBRATIONS})")
    return (
        "WITH "
        + ",\n".join(steps)
        + f""" SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(chance, 6) AS chance,
  CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'text:' || md5(coalesce(d.text, '')))), 1, 12) AS BIGINT) AS DOUBLE) / {float(16**12)} < chance AS kept
FROM docs d JOIN chance USING (source, lang, topic)"""
    )
