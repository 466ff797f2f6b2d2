"""The stages of the pipeline against the operators' brute force, on a small planted corpus."""

import random

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from wattfleet.llm import quality as Q

WORDS = "the of and to in a is that for it as was with be by on not he this are or his from at which but have an they you were".split()


def prose(rng, n):
    made = [rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice("bcdeilnorstu") for _ in range(rng.randint(4, 8))) for _ in range(n)]
    return "\n".join(" ".join(made[i : i + 20]) + "." for i in range(0, n, 20))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = [prose(rng, 200) for _ in range(40)]
    passage = prose(rng, 40)
    texts = good + [good[0], None, "", "short", "spam spam " * 200, good[1].replace("\n", " ") + " extra", prose(rng, 60) + "\n" + passage,
                    good[2].split("\n")[0] + "\n" + prose(rng, 100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema if f.name not in ("doc_id", "text")]
    docs = rows.select(F.col("id").cast(base.schema["doc_id"].dataType).alias("doc_id"), F.col("t").alias("text"), *others).select(*base.columns)
    place = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(f"{place}/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(1).withColumn("text", F.lit(passage))
    bench.write.parquet(f"{place}/benchmark.parquet")
    return str(place), texts


def test_stages(spark, folder):
    place, texts = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES[:-1]:
        found = stage(spark, docs, place)
        assert found.columns == docs.columns, name
        docs = C.stored(found, name)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in Q.quality(spark.read.parquet(f"{place}/documents.parquet")).where("kept").collect()}
    assert set(seen["quality_rules"]) == kept
    assert not kept & {41, 42, 43, 44} and kept >= set(range(40))
    # The copy loses all its lines; the line that another document holds goes from the later one only.
    lines = seen["line_dedup"]
    assert 40 not in lines and all(lines[i] == texts[i] for i in range(40))
    assert texts[2].split("\n")[0] not in (lines.get(47) or "").split("\n")
    assert set(range(40)) <= set(seen["simhash_near_dedup"])
    clean = seen["benchmark_decontamination"]
    assert 46 in seen["simhash_near_dedup"] and 46 not in clean
    assert set(clean) == set(seen["simhash_near_dedup"]) - {46}


def test_run_packs_what_is_left(spark, folder):
    place, _ = folder
    pieces = C.run(spark, place).collect()
    assert {r.doc_id for r in pieces} >= set(range(40))
    for doc in {r.doc_id for r in pieces}:
        mine = sorted((r.start, r.length) for r in pieces if r.doc_id == doc)
        total = next(r.doc_tokens for r in pieces if r.doc_id == doc)
        assert mine[0][0] == 0 and sum(n for _, n in mine) == total
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
    filled = {}
    for r in pieces:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 4096


def test_empty_documents(spark, folder, tmp_path):
    place, _ = folder
    spark.read.parquet(f"{place}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{place}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
