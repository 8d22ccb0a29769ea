"""The pipeline's stages in order, each held against a plain computation on its own input, and the whole run."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import langid, mixing, quality, queries
from tests.llm.test_corpus_ops import brute_components
from tests.llm.test_text_ops import brute_statistics, plain_kneser_ney

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.when(F.col("doc_id") >= 0, "kept") for c in ("extra", "language", "quality", "mix_source", "mix_kept", "cls", "row")})
    none = [None] * 7
    odd = spark.createDataFrame([(900_001, None, None, None, None, *none), (900_002, "12 34", "en", "s", 5, *none), (900_003, "\n".join(r["text"] for r in docs.where("lang = 'en'").collect()), "en", "s", 5, *none)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 3"))
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == columns and out.where("doc_id < 900000 and (extra <> 'kept' or mix_source <> 'kept' or language <> 'kept')").count() == 0
        kept = [r["doc_id"] for r in out.collect()]
        assert set(kept) <= set(before)
        if name == "language_id":
            assert {900_001, 900_002}.isdisjoint(kept) and len(set(kept)) >= len(before) - 3
        if name == "quality_rules":
            assert all(quality.statistics(before[d])[0][0] >= 50 for d in kept)
        if name == "near_dedup":
            assert len(kept) == len(set(kept)) == len({" ".join(before[d].lower().split()) for d in kept})
        if name == "source_mixing":
            assert 0 < len(kept) < len(before)
        seen.append(name)
        docs = out
    library = Tokenizer.from_file(queries.tokenizer_path())
    rows = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert len(rows) == docs.count()
    for r in docs.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert rows[r["doc_id"]]["n_tokens"] == len(ids) and rows[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert [*seen, "bpe_encoding"] == [n for n, _ in corpus_pipeline.STAGES]


def plain_language_id(spark, rows):
    """Costs by a Kneser-Ney model of dictionaries; what is usual for a language comes from the fitted model."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    learned = [(t, lang) for d, t, lang, _ in rows if t is not None and lang is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    cost = {lang: plain_kneser_ney([t for t, own in learned if own == lang]) for lang in model.langs}
    kept = []
    for row in rows:
        text = row[1] or ""
        if not any(c.isalpha() for c in text):
            continue
        n = len(re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip()) + 1
        means = [cost[lang](text) / n for lang in model.langs]
        k = int(np.argmin(means))
        excess = means[k] - model.mean[k]
        if not (excess > langid.REJECT_NATS and excess > langid.REJECT_Z * model.spread[k] / math.sqrt(n)):
            kept.append(row)
    return kept


def plain_quality(spark, rows, labels):
    """Counts by brute force, trees walked node by node."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    forest = quality.train(docs, labels)
    kept = []
    for row in rows:
        n, *_, repeats = brute_statistics(row[1])[:5]
        if n < 50 or 100 * repeats > 50 * n:
            continue
        x, margin = quality.statistics(row[1])[1], forest.base
        for at in forest.roots.tolist():
            while forest.left[at] != at:
                at = int(forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at])
            margin += float(forest.value[at])
        if 1 / (1 + math.exp(-margin)) >= quality.KEEP_FROM:
            kept.append(row)
    return kept


def plain_mixing(rows):
    """Proportional fitting over a dictionary of cells."""

    def topic(t):
        if not t:
            return "empty"
        if 100 * len(re.findall("[#*$%&|<>]", t)) > 5 * len(t):
            return "symbols"
        return "figures" if 100 * len(re.findall("[0-9]", t)) > 2 * len(t) else "prose"

    cell_of = lambda r: (r[3] or "(none)", r[2] or "(none)", topic(r[1]))
    tokens = defaultdict(float)
    for r in rows:
        tokens[cell_of(r)] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    total, share, want = sum(tokens.values()), {}, []
    for k, m in enumerate(mixing.MARGINS):
        own = defaultdict(float)
        for c, n in tokens.items():
            own[c[k]] += n
        own = {v: n ** mixing.TEMPER[m] for v, n in own.items()}
        want.append({v: n / sum(own.values()) for v, n in own.items()})
    share = {c: n / total for c, n in tokens.items()}
    for _ in range(mixing.ITERATIONS):
        for k in range(3):
            now = defaultdict(float)
            for c, s in share.items():
                now[c[k]] += s
            share = {c: s * want[k][c[k]] / now[c[k]] if now[c[k]] else 0.0 for c, s in share.items()}
    rate = {c: share[c] * mixing.FRACTION * total / n if n else 0.0 for c, n in tokens.items()}
    scale = 1.0
    for _ in range(mixing.CALIBRATIONS):
        held = sum(n for c, n in tokens.items() if scale * rate[c] >= 1)
        free = sum(rate[c] * n for c, n in tokens.items() if scale * rate[c] < 1)
        scale = max(0.0, mixing.FRACTION * total - held) / free if free else scale
    draw = lambda d: int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:12], 16) / 16**12
    return [r for r in rows if draw(r[0]) < min(1.0, scale * rate[cell_of(r)])]


def test_every_stage_by_plain_computation(spark, tmp_path):
    """Kept ids of each stage, and the whole run's digests, from dictionaries and loops."""
    from tokenizers import Tokenizer

    rng = random.Random(9)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    for k, (_, text, lang, source) in enumerate(rng.sample(rows, 25)):  # near copies around the threshold
        words = text.split(" ")
        for at in rng.sample(range(len(words)), min(len(words), max(1, len(words) // rng.choice([200, 60, 25])))):
            words[at] = f"w{at}"
        rows.append((800_000 + k, " ".join(words), lang, source))
    noise = lambda: "".join(chr(rng.choice([*range(0x3B1, 0x3C9), 0x20])) for _ in range(900))
    rows += [(900_001, None, None, None), (900_002, "12 34", "en", "s"), (900_003, noise(), None, "s"), (900_004, noise(), None, "t"), (900_005, "qx " * 400, "en", "s")]
    sf = str(tmp_path / "sf")
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    def components(now):
        least = {d: c for d, _, c in brute_components([(d, t) for d, t, *_ in now])}
        return [r for r in now if least[r[0]] == r[0]]

    plain = {"language_id": lambda now: plain_language_id(spark, now), "quality_rules": lambda now: plain_quality(spark, now, labels), "near_dedup": components, "source_mixing": plain_mixing}
    now = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = plain[name](now)
        got = stage(spark, spark.createDataFrame(now, schema), sf)
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(r[0] for r in want), name
        assert len(want) < len(now), name
        now = want
    library = Tokenizer.from_file(queries.tokenizer_path())
    ids = {r[0]: library.encode(r[1], add_special_tokens=False).ids for r in now}
    want = {d: (len(k), hashlib.sha256(",".join(map(str, k)).encode()).hexdigest(), hashlib.sha256(library.decode(k, skip_special_tokens=False).encode()).hexdigest()) for d, k in ids.items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_run_and_empty_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(out.columns)
    want = [tuple(r[names.index(c)] for c in out.columns) for r in res.fetchall()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in out.collect())
