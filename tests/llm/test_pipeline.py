"""The pipeline's stages, each against its operator's brute force on what the stage before left."""

from collections import Counter

from cases import plain
from test_near_dup import brute
from test_rows import brute_lines, check_packing

import corpus_pipeline
from wonted.llm import quality
from wonted.llm.common import read

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs, seen = read(spark, FOLDER, "documents"), {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        place = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(place)
        docs = spark.read.parquet(place)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    rows = {name: [tuple(r) for r in df.collect()] for name, df in seen.items()}

    machine = quality.fit(before, read(spark, FOLDER, "labels"))
    passed = quality.scored(before, machine).filter(f"score >= {quality.THRESHOLD}").drop("score")
    assert sorted(rows["quality"], key=repr) == plain(passed) and 0.7 * 200 < len(rows["quality"]) < 200

    want = sorted((i, kept) for i, _, _, kept in brute_lines(rows["quality"]))
    assert sorted(r[:2] for r in rows["line_dedup"]) == want and all(r[4] == len(r[1]) for r in rows["line_dedup"])

    group = {i: c for i, _, c in brute(rows["line_dedup"], 80)}
    assert sorted(rows["near_dup"]) == sorted(r for r in rows["line_dedup"] if group[r[0]] == r[0])

    times = Counter(rows["mixing"])
    assert set(times) <= set(rows["near_dup"]) and max(times.values()) <= 2
    share = sum(len(r[1].encode().split()) for r in rows["mixing"]) / sum(len(r[1].encode().split()) for r in rows["near_dup"])
    assert 1.45 < share < 1.55

    check_packing(rows["mixing"], seen["packing"].collect(), 2048)


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
