"""The pipeline's stages, each against its operator's plain meaning."""

import random

from pyspark.sql import functions as F
from test_small import brute_components, brute_windows, text

import corpus_pipeline
from ruleweave.llm import packing
from ruleweave.llm.scratch import cut


def test_pipeline(spark, docs, tmp_path):
    r = random.Random(9)
    bad = ["nasty", "vile", "rotten"]
    some, marks = [], []
    for i in range(240):
        t = text(50, r)
        if i % 6 == 0:
            w = t.split()
            for b in bad:
                w.insert(r.randrange(40), b)
            t = " ".join(w)
        some.append((i, t))
        marks.append((i, int(i % 6 == 0)))
    some += [(300 + i, some[1][1] + (" more" if i % 2 else "")) for i in range(6)] + [(310, some[1][1])] * 2
    benchmark = [(1, text(40, r)), (2, text(12, r))]
    some += [(400, f"{text(20, r)} {benchmark[0][1]}"), (401, f"{benchmark[1][1]} {text(60, r)}"), (402, None), (None, text(30, r))]
    folder = str(tmp_path)
    docs(some).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = cut(stage(spark, now, folder), name)
        kept[name] = now
        if name != "packing":
            assert now.columns == docs(some).columns
    ids = {n: [(x.doc_id, x.text) for x in d.collect()] for n, d in kept.items() if n != "packing"}
    toxic = {i for i, y in marks if y}
    left = {i for i, _ in ids["toxicity"]}
    assert len(toxic & left) <= 2 and len({i for i, _ in some} - toxic - left) <= 2
    assert {i for i, _ in ids["language"]} == left - {402}
    wanted = {c for d, _, c in brute_components(ids["language"], 80) if d is not None} | ({None} & {i for i, _ in ids["language"]})
    assert sorted(ids["near_duplicates"], key=str) == sorted({x for x in ids["language"] if x[0] in wanted}, key=str)
    clean = [d for d, _, _, _, _, hit in brute_windows(ids["near_duplicates"], benchmark) if not hit]
    assert sorted(map(str, clean)) == sorted(str(i) for i, _ in ids["decontamination"])
    assert 400 not in clean and 401 not in clean
    assert {x.doc_id for x in kept["packing"].collect()} == set(clean)
    assert packing.sequences(kept["packing"]).count() == kept["packing"].select("sequence_id").distinct().count()


def test_stages_on_empty_tables(spark, docs, tmp_path):
    """Without labels, items or learnable languages nothing is dropped but repeated texts; without documents nothing comes out."""
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    some = docs([(None, "a b c"), (None, "a b c"), (None, "a b d"), (1, None), (2, "x y")]).withColumn("lang", F.lit(None).cast("string"))
    kept = {"toxicity": 5, "language": 5, "near_duplicates": 4, "decontamination": 5, "packing": 5}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, some, folder).count() == kept[name], name
        assert stage(spark, some.where("false"), folder).count() == 0, name
