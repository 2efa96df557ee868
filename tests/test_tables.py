"""Scalars, sources, caps, partitions, aggregates and masks on planted values."""

import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyframe.functions import scalars as S
from relyframe.operators import caps, masks, nearest, partition, scoring, tracks
from relyframe.plans import studies
from relyframe.sources import tables
from relyframe.streaming import incremental


def one(spark, column, sql="select 1"):
    return spark.sql(sql).select(column.alias("x")).first().x


def rle(mask):
    """Run-length text of a mask, for tests only."""
    flat = np.asarray(mask, bool).T.ravel()
    runs, value = [], False
    for v in flat:
        if v != value or not runs:
            runs += [0] if v == value else ([0, 0] if not runs else [0])
            value = v
        runs[-1] += 1
    out = []
    for k, r in enumerate(runs):
        x = r - runs[k - 2] if k > 2 else r
        while True:
            c, x = x & 31, x >> 5
            more = x != (-1 if c & 16 else 0)
            out.append(chr((c | 32 if more else c) + 48))
            if not more:
                break
    return "".join(out)


def test_scalars(spark):
    sql = "select array(0,1,2,3,4,5,6,7,8,9) v, array(null,'a','b',null,'c','d') s, array('a','','c') p, array('a','b','c') q"
    assert one(spark, S.sample_evenly(F.col("v"), 3), sql) == [0, 4, 9] and one(spark, S.sample_evenly(F.col("v"), 0), sql) == list(range(10))
    assert one(spark, S.sample_stride(F.col("v"), 4), sql) == [0, 2, 4, 6]
    assert one(spark, S.present_frames(F.col("s")), sql) == [1, 2, 4, 5]
    assert one(spark, S.tree_distance(F.col("p"), F.col("q")), sql) == 2 and one(spark, S.tree_distance(F.col("q"), F.col("q")), sql) == 0
    assert one(spark, S.tree_distance(F.col("p"), F.col("p")), sql) == 2
    text = "select ' Zebra_(equus_quagga)' n, 'NaN ' m, cast(null as string) z, '12 May 2019 20200' d"
    assert one(spark, S.normal_class_name(F.col("n")), text) == "zebra" and one(spark, S.is_real(F.col("m")), text) is False
    assert one(spark, S.is_real(F.col("z")), text) is False and one(spark, S.year_text(F.col("d")), text) == "2019" and one(spark, S.year_text(F.col("z")), text) == ""
    assert one(spark, S.prompt_text(F.lit("generic"), F.col("n"), F.col("m")), text) == "animal" and one(spark, S.prompt_text(F.lit("x"), F.lit(""), F.lit("s")), text) == "s"
    assert one(spark, S.l2_normal(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and one(spark, S.l2_normal(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, S.gained(F.lit(0.4), 0.1, 3.0)) == 1.0 and one(spark, S.gained(F.lit(0.05), 0.1, 3.0)) is None
    assert one(spark, S.full_path([F.lit("a"), F.lit(None).cast("string")])) is None and one(spark, S.weight(F.lit(-1))) == 0.0


@pytest.fixture(scope="module")
def annotation_file():
    doc = {
        "videos": [{"id": 1, "file_names": ["f0", "f1"], "location_id": "site", "video_creation_datetime": "2019-05-01"}, {"id": 2, "file_names": [], "location_id": "nan", "video_creation_datetime": None}],
        "annotations": [{"id": 5, "video_id": 1, "category_id": 7, "segmentations": [None, {"size": [2, 2], "counts": "x"}], "bboxes": [None, [0, 0, 1, 1]], "areas": [0, 3.0]}, {"id": 6, "video_id": 1, "category_id": 7, "segmentations": [{"size": [2, 2], "counts": "x"}, {"size": [2, 2], "counts": "y"}], "areas": [1, 1]}],
        "categories": [{"id": 7, "name": "zebra", "Kingdom": "Animalia", "Species": "nan"}, {"id": 8, "name": None, "Species": "Canis"}],
        "video_np_pairs": [{"id": 0, "video_id": 1, "category_id": 7, "noun_phrase": "a zebra", "num_masklets": 2}, {"id": 1, "video_id": 1, "category_id": 8, "noun_phrase": "", "num_masklets": 0}, {"id": 2, "video_id": 99, "category_id": 7, "num_masklets": 1}],
    }
    path = f"{tempfile.mkdtemp(prefix='spark-')}/a.json"
    with open(path, "w") as f:
        json.dump(doc, f, indent=1)
    return path


def test_annotations_become_tables(spark, annotation_file):
    t = tables.read_annotations(spark, annotation_file, "train")
    probes = {(r.video_id, r.category_id): r for r in tables.probes(t).collect()}
    assert set(probes) == {("1", "7"), ("1", "8")} and probes["1", "8"].is_hard_negative and probes["1", "8"].species == "Canis"
    assert tables.probes(t, include_negatives=False).count() == 1
    frames = tables.masklet_frames(t["annotations"])
    support = scoring.probe_support(tables.probes(t), frames, ["video_id", "category_id"])
    assert {(r.category_id, r.n_frames, r.n_masklets) for r in support.collect()} == {("7", 2, 2), ("8", 0, 0)}
    assert tables.taxonomy_by_name(t["categories"]).filter("name = 'zebra'").first().taxonomy == {"Kingdom": "Animalia"}
    assert [r.category_id for r in tables.categories_with_masks(t["annotations"]).collect()] == ["7"]
    t["pairs"] = t["pairs"].limit(0)
    assert [(r.video_id, r.num_masklets) for r in tables.probes(t).collect()] == [("1", 1)]


def test_annotations_need_their_keys(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/b.json"
    with open(path, "w") as f:
        json.dump({"videos": []}, f)
    with pytest.raises(ValueError):
        tables.read_annotations(spark, path, "train")


@pytest.fixture(scope="module")
def prediction_folder():
    folder = tempfile.mkdtemp(prefix="spark-")
    seg = {"size": [1, 1], "counts": "1"}
    for name, entries in {"v1_c": [{"score": 0.9, "segmentations": [seg, None]}], "v2_c": [{"score": 0.3, "segmentations": [seg, seg]}], "v_3_d": []}.items():
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump(entries, f)
    return folder


def test_confidence_of_prediction_files(spark, prediction_folder):
    rows = tables.prediction_rows(tables.read_predictions(spark, prediction_folder, "a"))
    cells = scoring.confidence_cells(rows.withColumn("probe", F.col("video_id")), 0.5, ["category_id"])
    got = {r.category_id: tuple(round(x, 6) for x in r[1:]) for r in cells.collect()}
    assert got == {"c": (0.5, 0.6, 0.6, 0.75), "d": (0.0, 0.0, 0.0, 0.0)}
    made, state = f"{tempfile.mkdtemp(prefix='spark-')}/t", f"{tempfile.mkdtemp(prefix='spark-')}/c"
    for _ in range(2):
        incremental.ingest_predictions(spark, prediction_folder, made, state, "a").awaitTermination()
    again = {r.category_id: tuple(round(x, 6) for x in r[1:]) for r in incremental.confidence_of(spark, made, 0.5).collect()}
    assert again == got


def test_incremental_embedding(spark):
    source, made, state = (f"{tempfile.mkdtemp(prefix='spark-')}/{x}" for x in "smc")
    seen = tempfile.mkdtemp(prefix="spark-")

    def encoder(batches):
        for pdf in batches:
            for k in pdf["key"]:
                open(f"{seen}/{k}-{np.random.randint(1 << 30)}", "w").close()
            yield pdf.assign(x=pdf["key"] * 2.0, batch=0)[["key", "x"]]

    run = lambda: incremental.ingest_embeddings(spark, source, "key long", made, state, encoder, "key long, x double").awaitTermination()
    spark.range(5).withColumnRenamed("id", "key").write.parquet(source)
    run()
    run()
    import os

    assert len(os.listdir(seen)) == 5 and spark.read.parquet(made).count() == 5
    spark.range(3, 9).withColumnRenamed("id", "key").write.mode("append").parquet(source)
    run()
    assert len(os.listdir(seen)) == 9 and sorted(r.key for r in spark.read.parquet(made).collect()) == list(range(9))


def test_evaluator_spellings(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/r.json", "w") as f:
        json.dump({"dataset_results": {}, "video_np_results": [], "per_video": [{"video_id": 1, "category_id": 2, "bbox_DetA": 0.2, "DetA": 0.9, "mask_AssA": 0.5, "bbox_AssA": 0.1}]}, f)
    assert tuple(tables.read_evaluator(spark, folder).first()) == ("1", "2", 0.2, 0.5, None)
    assert tables.read_evaluator(spark, folder, prefer_bbox=True).first().pAssA == 0.1


def test_track_conversion_caps(spark):
    def seq(name, cats, frames=3):
        return {"seq_name": name, "dataset": "D", "width": 2, "height": 2, "fps": 1, "all_image_paths": [], "annotated_image_paths": [f"{k}.jpg" for k in range(frames)], "segmentations": [{str(i): {"rle": "x"} for i in range(len(cats))} for _ in range(frames)], "track_category_ids": {str(i): c for i, c in enumerate(cats)}}

    doc = {"categories": [{"id": 1, "name": "zebra"}, {"id": 2, "name": "Dog_(pet)"}, {"id": 3, "name": "person"}], "sequences": [seq("zeb_a", [1, 1]), seq("zeb_b", [1]), seq("dog_a", [2, 3]), seq("zeb_c", [1]), seq("short", [2], 1)]}
    path = f"{tempfile.mkdtemp(prefix='spark-')}/t.json"
    with open(path, "w") as f:
        json.dump(doc, f)
    wanted = spark.createDataFrame([("zebra",), ("dog",)], "class_name string")
    got = tables.convert_tracks(spark, path, wanted, max_frames=2, min_frames=2, per_category=2).collect()
    assert {r.location_id for r in got} == {"zeb_a", "zeb_b", "dog_a"} and len(got) == 4
    assert all(len(r.rles) == 2 for r in got) and got[0].frame_names[-1].endswith("2.jpg")


def test_class_taxonomy(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/c.csv"
    with open(path, "w") as f:
        f.write("name,Kingdom,Phylum,Class,Order,Family,Genus,Species\nZebra_(x),a,b,c,d,e,f,g\nhorse,a,b,c,d,e,f,h\nchicken,a,b,x,y,z,q,r\nblob,a,,,,,,\n")
    rows = tables.read_class_taxonomy(spark, path).withColumnRenamed("class_name", "category_id")
    got = {r.category_id: r.distance for r in nearest.taxonomic_distance(rows, rows, loso=True).collect()}
    assert got == {"zebra": 1.0, "horse": 1.0, "chicken": 5.0, "blob": None}
    kept = nearest.taxonomic_distance(rows, rows, loso=False).filter("distance = 0").count()
    assert kept == 3


def test_taxonomic_nothing_left(spark):
    rows = spark.createDataFrame([("a", list("1234567"))], "category_id string, path array<string>")
    assert nearest.taxonomic_distance(rows, rows, loso=True).first().distance is None
    other = spark.createDataFrame([("b", list("abcdefg"))], "category_id string, path array<string>")
    assert nearest.taxonomic_distance(rows, other, loso=True).first().distance == 7.0


def test_taxonomic_distance_without_broadcast(spark):
    from relyframe.plans import mapping

    paths = mapping.taxonomy(spark, "/root/testdata/sf0.001")
    found = nearest.taxonomic_distance(paths, paths, loso=True)
    assert found.count() > 0 and "BroadcastHashJoin" not in found._jdf.queryExecution().toString()


def test_taxonomic_several_paths(spark):
    rows = spark.createDataFrame([("a", list("1234567")), ("a", list("1234568")), ("b", list("12xxxxx")), ("c", None), (None, list("1234567"))], "category_id string, path array<string>")
    got = {r.category_id: r.distance for r in nearest.taxonomic_distance(rows, rows, loso=True).collect()}
    assert got == {"a": 5.0, "b": 5.0, "c": None, None: None} and nearest.taxonomic_distance(rows, rows, loso=True).count() == 4
    own = rows.filter("category_id = 'a'")
    assert [r.distance for r in nearest.taxonomic_distance(own, own, loso=True).collect()] == [None]
    assert [r.distance for r in nearest.taxonomic_distance(own, own, loso=False).collect()] == [0.0]


def test_temporal_gap(spark):
    cells = spark.createDataFrame([("a", "2003"), ("b", ""), ("c", "1990"), ("d", "2010")], "category_id string, time string")
    years = spark.createDataFrame([("2001",), ("2007",)], "year string")
    assert {r.category_id: r.temporal_gap for r in nearest.temporal_gap(cells, years).collect()} == {"a": 2.0, "c": 11.0, "d": 3.0}


def test_caps(spark):
    rows = [(i, "a", 1) for i in range(5)] + [(10 + i, "b", 2) for i in range(2)] + [(20 + i, "a", 0) for i in range(3)]
    probes = spark.createDataFrame(rows, "record_ord long, category_id string, num_masklets long")
    got = [r.category_id for r in caps.capped_probes(probes, 3).collect()]
    assert sorted(got) == ["a"] * 3 + ["b"] * 2 and caps.capped_probes(probes, 3, 4).count() == 4
    m = spark.createDataFrame([("a", 0, 0, [None]), ("a", 0, 1, ["m"]), ("a", 1, 0, ["m"])], "category_id string, record_ord long, masklet_ord long, segments array<string>")
    assert [r.masklet_ord for r in caps.capped_masklets(m, 1).collect()] == [0] and [r.masklet_ord for r in caps.capped_masklets(m, 1, need_mask=True).collect()] == [1]
    s = spark.createDataFrame([("a", 1, 5, 1), ("a", 2, 1, 1), ("a", 3, 5, 0), ("b", 4, 5, 1), ("a", 5, 5, 2)], "category_id string, record_ord long, n_frames long, n_masks long")
    wanted = spark.createDataFrame([("a",)], "category_id string")
    assert sorted(r.record_ord for r in caps.capped_sequences(s, wanted, 2, 3).collect()) == [1, 5]


def test_partition_firewall(spark):
    rows = [("v1", "a", "s1", "2001", "train", 1), ("v2", "b", "s2", "2002", "test", 2), ("v3", "b", "nan", "2002", "test", 0)]
    names = "video_id string, category_id string, location_id string, creation_datetime string, origin string, num_masklets long"
    probes = spark.createDataFrame(rows, names)
    ok = partition.location_partition(probes)
    assert {r["axis"]: r.n_both for r in partition.assert_no_leakage(ok, "location", False).collect()} == {"species": 0, "location": 0, "year": 0}
    shared = partition.location_partition(probes.withColumn("location_id", F.lit("same")))
    with pytest.raises(partition.LeakageError):
        partition.assert_no_leakage(shared, "location", False)
    with pytest.raises(partition.LeakageError):
        partition.assert_no_leakage(ok, "species", False)
    assert partition.side_of(probes, ok, "probe", ["test"]).count() == 1
    pooled = partition.pool({"train": probes, "test": probes})
    assert pooled.count() == 6 and pooled.filter("video_key = 'test:v1' and origin_rank = 1").count() == 1
    path = f"{tempfile.mkdtemp(prefix='spark-')}/p"
    partition.save(ok, path)
    assert partition.load(spark, path).count() == ok.count()
    assert [r.variant for r in partition.variants_missing(spark.createDataFrame([("x",), ("y",)], "variant string"), spark.createDataFrame([("x",)], "variant string")).collect()] == ["y"]


def test_merge_features(spark):
    cells = spark.createDataFrame([("a", "a", "s", "1"), ("a", "a", "t", "2"), ("b", "b", "s", "3")], "category_id string, species string, location_id string, time string")
    tax = spark.createDataFrame([("a", 2.0), ("b", 4.0)], "category_id string, taxonomic double")
    env = spark.createDataFrame([("s", 0.1), ("t", 0.9)], "location_id string, env double")
    got = studies.merge_features(cells, [tax], [env]).orderBy("time").collect()
    assert [(r.taxonomic, r.env) for r in got] == [(2.0, 0.1), (2.0, 0.9), (4.0, 0.1)]
    with pytest.raises(ValueError):
        studies.merge_features(cells, [tax.union(tax)])


def test_false_positive_rows(spark):
    neg = spark.createDataFrame([("v1", "a"), ("v2", "a"), ("v3", "b")], "probe string, category_id string")
    pred = spark.createDataFrame([("v1", [0.9, 0.1]), ("v2", [])], "probe string, scores array<double>")
    assert {(r.probe, r.fp, r.n_pred) for r in scoring.false_positives(neg, pred, 0.5).collect()} == {("v1", 1, 2), ("v2", 0, 0)}


def test_atc_threshold(spark):
    scores = spark.createDataFrame([(x / 10,) for x in range(1, 11)], "score double")
    value = lambda df, p: scoring.atc_threshold(df, p).first().threshold
    t = value(scores, 0.5)
    assert abs(scores.filter(F.col("score") >= t).count() / 10 - 0.5) < 0.15 and value(scores, 1.0) <= 0.1
    assert value(scores.limit(0), 0.5) == 0.5 and value(scores, None) == 0.5


def test_constant_columns_are_null(spark):
    rows = spark.createDataFrame([(1.0, float(i), 1.0) for i in range(5)], "x double, y double, w double")
    assert scoring.weighted_pearson(rows, "x", "y", "w").first().r is None
    assert all(r.r is None for r in scoring.correlations(rows, ["x"], ["y"]).collect())
    assert scoring.within_fraction(rows, "w", "x").first().fraction is None
    assert scoring.quantile_bins(rows, "x", "y").count() == 0


def test_masks(spark):
    mask = np.zeros((40, 30), bool)
    mask[10:15, 5:11] = True
    assert np.array_equal(masks.decode_mask(40, 30, rle(mask)), mask)
    big = np.random.default_rng(0).random((37, 53)) < 0.3
    assert np.array_equal(masks.decode_mask(37, 53, rle(big)), big)
    rows = spark.createDataFrame([(40, 30, rle(mask)), (40, 30, None), (4, 4, rle(np.zeros((4, 4), bool)))], "h int, w0 int, counts string")
    got = [tuple(r)[3:] for r in masks.with_metrics(rows, F.col("h"), F.col("w0"), F.col("counts")).collect()]
    assert got == [(30, 5, 10, 6, 5), (0, None, None, None, None), (0, 0, 0, 0, 0)]


def test_scene_pass(spark):
    grey, red = np.full((20, 20, 3), 90, np.uint8), np.zeros((20, 20, 3), np.uint8)
    red[..., 0] = 200
    rows = [("k1", "s", 20, 20, bytearray(grey.tobytes())), ("k2", "s", 20, 20, bytearray(red.tobytes()))]
    pixels = spark.createDataFrame(rows, "key string, location_id string, height int, width int, rgb binary")
    got = {r.key: r for r in masks.scene_pass(pixels).collect()}
    assert got["k1"].is_achromatic and not got["k2"].is_achromatic and got["k1"].clutter == 0.0
    assert not masks.location_scene(masks.scene_pass(pixels)).first().is_night_ir


def test_log_area(spark):
    rows = [("a", "m1", 0, 0, 100), ("a", "m2", 1, 0, 400), ("b", "m3", 0, 0, 0)]
    frames = spark.createDataFrame(rows, "category_id string, ann_id string, record_ord long, masklet_ord long, area long")
    got = {r.category_id: r.log_area for r in masks.log_area(frames, frames, 1).collect()}
    assert abs(got["a"] - np.log1p(100)) < 1e-12 and got["b"] is None


def test_tracks(spark):
    rows = [(1, 0, "a", 0.9, [0.0, 0.0, 4.0, 4.0]), (1, 0, "b", 0.8, [0.5, 0.0, 4.5, 4.0]), (1, 0, "c", 0.7, [10.0, 10.0, 12.0, 12.0]), (1, 1, "d", 0.1, None)]
    det = spark.createDataFrame(rows, "video_id long, frame_idx int, det_id string, score double, box array<double>")
    assert sorted(r.det_id for r in tracks.suppress(det, 0.5).collect()) == ["a", "c"]
    emb = [(1, 0, "a", [1.0, 0.0]), (1, 0, "b", [0.0, 1.0]), (1, 1, "c", [0.1, 1.0]), (1, 1, "d", [1.0, 0.1]), (1, 2, "e", [-1.0, -1.0]), (2, 0, "f", [1.0, 1.0])]
    got = {r.det_id: r.track_id for r in tracks.link(spark.createDataFrame(emb, "video_id long, frame_idx int, det_id string, embed array<double>"), 0.9).collect()}
    assert got["a"] == got["d"] == 0 and got["b"] == got["c"] == 1 and got["e"] == 2 and got["f"] == 0
    seen = spark.createDataFrame([(1, 7, 1, 0.2, "m"), (1, 7, 3, 0.3, "n"), (1, 8, 0, 0.05, "o")], "video_id long, track_id long, frame_idx int, score double, rle string")
    (row,) = tracks.assemble(seen, 4, 0.1, 2.0).collect()
    assert row.score == 0.6 and row.segmentations == [None, "m", None, "n"]
    with pytest.raises(Exception, match="out of range"):
        tracks.assemble(seen, 2).collect()


def brute_links(rows, threshold):
    """det_id: track, by trying every assignment of each frame."""
    from itertools import groupby, permutations

    out = {}
    for _, video in groupby(sorted(rows, key=lambda r: r[:3]), lambda r: r[0]):
        running = []
        for _, frame in groupby(video, lambda r: r[1]):
            frame = list(frame)
            x = [np.array(r[3]) / np.linalg.norm(r[3]) for r in frame]
            places = list(range(len(running))) + [None] * max(0, len(x) - len(running))
            score = lambda way: sum(x[k] @ running[t] for k, t in enumerate(way) if t is not None)
            best = max(permutations(places, len(x)), key=score)
            for k, t in enumerate(best):
                if t is None or x[k] @ running[t] < threshold:
                    t = len(running)
                    running.append(None)
                running[t] = x[k]
                out[frame[k][2]] = t
    return out


def test_link_is_the_best_assignment_over_cut_chunks(spark, monkeypatch):
    rng, rows = np.random.default_rng(5), []
    for video in range(40):
        for frame in range(rng.integers(1, 7)):
            rows += [(video, int(frame), f"{video}:{frame}:{k}", rng.normal(size=2 + video % 2).tolist()) for k in range(rng.integers(1, 4))]
    want = brute_links([r for r in rows if r[0] != 17], 0.8)
    rows = [r for r in rows if r[0] != 17]
    det = spark.createDataFrame(rows, "video_id long, frame_idx int, det_id string, embed array<double>")
    try:
        for batch, chunk in ((1, 1), (3, 7), (10_000, 65_536)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            monkeypatch.setattr(tracks, "CHUNK_ROWS", chunk)
            got = {r.det_id: r.track_id for r in tracks.link(det, 0.8).collect()}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_link_keeps_rows_that_cannot_be_linked(spark):
    big = 2**60 + 1
    rows = [(None, 0, "a", [1.0, 0.0]), (big, None, "b", [1.0, 0.0]), (big, 0, "c", None), (big, 0, "d", [1.0, 0.0]), (big, 1, "e", [1.0, 0.1])]
    det = spark.createDataFrame(rows, "video_id long, frame_idx int, det_id string, embed array<double>")
    got = {r.det_id: (r.video_id, r.track_id) for r in tracks.link(det, 0.9).collect()}
    assert got == {"a": (None, None), "b": (big, None), "c": (big, None), "d": (big, 0), "e": (big, 0)}


def test_link_takes_many_videos_at_once(spark):
    import time

    # 120,000 videos of two frames; frame by frame in Python, they took minutes.
    det = spark.range(240_000).selectExpr("id div 2 AS video_id", "cast(id % 2 AS int) AS frame_idx", "cast(id AS string) AS det_id", "array(cast(id % 2 AS double), 1.0D) AS embed")
    began = time.time()
    assert tracks.link(det, 0.5).filter("track_id = 0").count() == 240_000 and time.time() - began < 30


def test_fetch_list_and_images(spark):
    videos = spark.createDataFrame([("s1", ["a", "b"]), ("s2", ["a"])], "source string, file_names array<string>")
    have = spark.createDataFrame([("s1", "a")], "source string, file_name string")
    assert {tuple(r) for r in tables.frames_to_fetch(videos, have).collect()} == {("s1", "b"), ("s2", "a")}


def test_quantiles_are_exact_with_hot_values(spark):
    import numpy as np

    values = [3.0] * 400 + [float(k % 37) / 3 for k in range(501)] + [None] * 7
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    shares = [0.0, 0.025, 1 / 3, 0.5, 0.71, 1.0]
    want = np.quantile([v for v in values if v is not None], shares)
    assert np.allclose(scoring.quantiles(rows, "v", shares), want, rtol=0, atol=1e-12)
    assert scoring.quantiles(rows.filter("v is null"), "v", [0.5]) is None


def test_numbering_spans_ranges(spark):
    from relyframe.plans import association

    rows = spark.range(1000).selectExpr("concat('k', lpad(cast(id * 7919 % 1000 as string), 4, '0')) as key")
    got = {r.key: r.g for r in association.numbered(rows, "key").collect()}
    assert got == {f"k{k:04d}": k for k in range(1000)}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from relyframe.sources.scratch import scratch_path

    settings = {"spark.master": "spark://host:7077"}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d)))
    with pytest.raises(ValueError):
        scratch_path(cluster)
    settings["spark.checkpoint.dir"] = "hdfs://shared/x/"
    assert scratch_path(cluster).startswith("hdfs://shared/x/table-")
