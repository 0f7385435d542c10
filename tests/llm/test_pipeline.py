"""The pipeline's stages in order over a small folder of tables."""

import random

import corpus_pipeline
from worklens.llm import simhash, substring
from worklens.llm.exact_dedup import lower_az
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, good, n=60):
    w = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return " ".join(x + "." * (k % 9 == 8) for k, x in enumerate(w)) if good else " ".join(x.upper() + "!!" for x in w)


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    rows = [(i, text(rng, i % 5 != 0)) for i in range(200)]
    passage = " ".join(text(rng, True, 70).split(" "))
    rows += [(300, rows[1][1].upper()), (301, rows[2][1] + " "), (302, rows[3][1] + " " + passage + "."), (303, passage + ". " + rows[4][1]), (304, None), (305, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "best-fit packing":
            assert [f for f in docs.schema.simpleString()] and docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        docs.write.parquet(f"{tmp_path}/out{len(kept)}")
        docs = spark.read.parquet(f"{tmp_path}/out{len(kept)}")
        kept.append({r[0]: r for r in docs.collect()} if name != "best-fit packing" else docs.collect())
    good, exact, near, cut, packed = kept
    assert all((i in good) == (i % 5 != 0) for i in range(200))
    assert 300 in exact and 301 in exact and 1 not in exact and 2 in exact
    assert len({r.text for r in docs.sparkSession.createDataFrame(list(exact.values())).select(lower_az(F.col("text")).alias("text")).collect()}) == len(exact)
    assert 2 in near and 301 not in near and set(near) <= set(exact)
    assert len(near) == simhash.simhash_groups(spark.createDataFrame(list(exact.values()), DOCS)).select("component_id").distinct().count()
    assert set(cut) == set(near)
    assert sum(passage[100:200] in (r.text or "") for r in cut.values()) == 1
    assert all(r.text == near[i].text for i, r in cut.items() if i < 300 and i not in (3, 4))
    assert len(substring.lines_of("a. b\nc")) == 2
    assert {r.doc_id for r in packed} == set(cut)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
