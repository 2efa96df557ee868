"""Large documents cut by byte ranges, keyed streams, resumable appends, and exact quantiles of hot groups."""

import glob
import json
import os
import random
import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyframe.operators import scoring
from relyframe.sources import documents, tables
from relyframe.streaming import incremental


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def nested(seed, n=120):
    """A document with nested elements, escapes, braces in strings, empty and missing arrays, and elements larger than a range."""
    r = random.Random(seed)
    hard = ["plain", "}{", 'quote " and }', "back\\slash", "\\\\", '\\"}', "é}日本", "[", "]]}", "line\nend}", "", '{"a": [1, 2]}']
    one = lambda k: {"id": k, "s": r.choice(hard), "n": {"deep": [{"x": [r.choice(hard)]}, {}, []]}, "l": [r.choice(hard) for _ in range(r.randint(0, 4))]}
    return {
        "info": {"version": "}", "parts": [{"id": -1}]}, "none": [], "first": [one(k) for k in range(n)], "flag": True, "long": [{"id": 0, "s": "x}" * 4000}, {"id": 1, "s": "{" * 3000}],
        "name}": [one(k) for k in range(7)], "nothing": None, "last": [one(k) for k in range(n // 3)], "end": [],
    }


def write(path, doc, **how):
    with open(path, "w") as f:
        json.dump(doc, f, **how)
    return path


@pytest.mark.parametrize("width, how", [("1000000", {}), ("4k", {"indent": 1}), ("700", {"ensure_ascii": False}), ("400", {}), ("2100", {"separators": (",", ":")})])
def test_elements_of_a_document(spark, width, how):
    doc = nested(len(width))
    path = write(f"{folder()}/d.json", doc, **how)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        elements, names = documents.read_sections(spark, path)
        got = {}
        for r in elements.collect():
            got.setdefault(r.section, {})[r.ord] = json.loads(r.text)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for name in ("first", "long", "name}", "last"):
        assert got[name] == dict(enumerate(doc[name])), name
    assert {"none", "end", *got} <= names and "nothing" not in names


def test_several_documents_and_broken_ones(spark):
    place = folder()
    for k in range(3):
        write(f"{place}/{k}.json", {"a": [{"id": k, "of": i} for i in range(5)]})
    elements, names = documents.read_sections(spark, place)
    assert names == {"a"}
    assert sorted((json.loads(r.text)["id"], r.ord) for r in elements.collect()) == [(k, i) for k in range(3) for i in range(5)]
    with open(f"{place}/0.json", "w") as f:
        f.write('{"a": [{"id": 1}, {"id": ')
    with pytest.raises(ValueError):
        documents.read_sections(spark, place)


def test_a_large_document_is_read_by_many_tasks(spark):
    videos = [{"id": k, "file_names": [f"{k}/{i}.jpg" for i in range(20)], "location_id": k % 7, "video_creation_datetime": "2001"} for k in range(3000)]
    marks = [{"id": k, "video_id": k % 3000, "category_id": k % 5, "segmentations": [None, {"size": [2, 2], "counts": "}04"}], "areas": [None, 4]} for k in range(6000)]
    path = write(f"{folder()}/big.json", {"videos": videos, "annotations": marks, "categories": [{"id": 1, "name": "x"}], "video_np_pairs": []})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert documents._fragments(spark, path).rdd.getNumPartitions() >= os.path.getsize(path) // 140_000 >= 10
        got = tables.read_annotations(spark, path, "train")
        assert {k: t.count() for k, t in got.items()} == {"videos": 3000, "annotations": 6000, "categories": 1, "pairs": 0}
        assert [r.id for r in got["videos"].orderBy("ord").collect()] == [str(k) for k in range(3000)]
        row = got["annotations"].filter("ord = 4321").first()
        assert (row.id, row.video_id, row.segmentations[1].counts, row.areas) == ("4321", "1321", "}04", [None, 4.0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    with pytest.raises(ValueError):
        tables.read_annotations(spark, write(f"{folder()}/no.json", {"videos": []}), "train")


def entry(score, masks):
    return {"score": score, "segmentations": [{"size": [1, 1], "counts": "1"} if m else None for m in masks]}


def test_a_probe_delivered_twice_counts_once(spark):
    source, made, state = folder(), f"{folder()}/t", f"{folder()}/c"
    put = lambda name, doc: (os.makedirs(os.path.dirname(f"{source}/{name}"), exist_ok=True), write(f"{source}/{name}", doc))
    run = lambda: incremental.ingest_predictions(spark, f"{source}/*/", made, state, "a").awaitTermination()
    put("one/v1_c.json", [entry(0.9, [1, 0]), entry(0.2, [1, 1])])
    put("one/v2_c.json", [])
    run()
    put("two/v1_c.json", [entry(0.9, [1, 0]), entry(0.2, [1, 1])])  # the same probe under another name
    put("two/v3_d.json", [entry(0.7, [1])])
    put("three/v3_d.json", [entry(0.7, [1])])
    run()
    run()
    os.remove(f"{source}/two/v1_c.json")
    shutil.rmtree(f"{source}/three")
    rows = tables.prediction_rows(tables.read_predictions(spark, f"{source}/*/", "a")).withColumn("probe", F.concat_ws(":", "video_id", "category_id"))
    batch = scoring.confidence_cells(rows, 0.5, ["category_id"]).collect()
    assert sorted(incremental.confidence_of(spark, made, 0.5).collect()) == sorted(batch) and len(batch) == 2


def test_a_dead_append_neither_loses_nor_doubles(spark):
    path, schema = f"{folder()}/log", "k long, part string, v double"
    rows = spark.range(40).select(F.col("id").alias("k"), F.lit("x").alias("part"), F.rand(1).alias("v")).union(spark.createDataFrame([(None, "x", 1.0), (None, "y", 2.0)], schema)).repartition(4)
    tables.append_once(rows.filter("k < 10"), path, ["k", "part"])
    dies = F.udf(lambda k: k if k is None or k < 35 else 1 // 0, "long")
    with pytest.raises(Exception, match="(?i)zero"):
        tables.append_once(rows.repartition(8, "k").withColumn("k", dies("k")), path, ["k", "part"])
    # As if the process had died behind its data, and before its commit.
    os.makedirs(f"{path}/data/dead")
    rows.write.mode("overwrite").parquet(f"{path}/data/dead")
    assert tables.committed(spark, path, schema).count() == 10
    for _ in range(2):
        tables.append_once(rows, path, ["k", "part"])
    got = tables.committed(spark, path, schema)
    assert got.count() == 42 and got.select("k", "part").distinct().count() == 42
    assert len(glob.glob(f"{path}/data/*")) == len(glob.glob(f"{path}/commits/[!.]*")) == 3


@pytest.mark.parametrize("most, parts", [(65_536, 4_096), (5, 4), (0, 2)])
@pytest.mark.parametrize("share", [0.5, 0.0, 1.0, 0.37])
def test_exact_quantiles_of_groups(spark, monkeypatch, most, parts, share):
    monkeypatch.setattr(scoring, "GROUP_VALUES", most)
    monkeypatch.setattr(scoring, "RANGE_PARTS", parts)
    r = np.random.default_rng(5)
    rows = [("hot", None, float(v)) for v in r.normal(size=200)] + [("tied", "a", float(v)) for v in r.integers(0, 3, 60)] + [("wide", "a", v) for v in (-1e308, 1e308, 0.0, 1e-300, -0.0, 5.0)]
    rows += [(None, "b", 3.0), ("hot", "b", None), ("two", "b", 1.0), ("two", "b", 2.0)]
    counts = spark.createDataFrame(rows, "g string, h string, x double").groupBy("g", "h", "x").agg(F.count("*").alias("n"))
    got = {(q.g, q.h): q.quantile for q in scoring.grouped_quantile(counts, ["g", "h"], "x", share).collect()}
    want = {}
    for g, h, x in rows:
        if x is not None:
            want.setdefault((g, h), []).append(x)
    assert set(got) == set(want)
    for k, own in want.items():
        assert got[k] == pytest.approx(np.quantile(own, share), rel=1e-12)
