"""Sources and sinks: nested annotation, prediction, evaluator and track documents as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.functions.scalars import LEVELS, clean_taxonomy, display_name, is_real, normal_class_name, sample_evenly
from relyframe.sources.documents import read_sections

_RLE = "struct<size:array<int>,counts:string>"
_CATEGORY = "struct<id:string,name:string," + ",".join(f"{level}:string" for level in LEVELS) + ">"
ANNOTATION_SCHEMA = {
    "videos": "struct<id:string,file_names:array<string>,location_id:string,video_creation_datetime:string>",
    "annotations": "struct<id:string,video_id:string,category_id:string,height:int,width:int,noun_phrase:string,"
    f"segmentations:array<{_RLE}>,bboxes:array<array<double>>,areas:array<double>>",
    "categories": _CATEGORY,
    "video_np_pairs": "struct<id:string,video_id:string,category_id:string,noun_phrase:string,num_masklets:bigint>",
}
_ENTRY = f"array<struct<score:double,segmentations:array<{_RLE}>>>"
#: Spellings of each metric, in the order of preference; mask first.
METRIC_NAMES = {m: (f"mask_{m[1:]}", f"bbox_{m[1:]}", m, m[1:]) for m in ("pDetA", "pAssA", "pHOTA")}
TRACK_SCHEMA = {
    "sequences": "struct<seq_name:string,dataset:string,width:int,height:int,fps:double,all_image_paths:array<string>,"
    "annotated_image_paths:array<string>,segmentations:array<map<string,struct<rle:string>>>,track_category_ids:map<string,int>>",
    "categories": "struct<id:int,name:string>",
}


def read_annotations(spark: SparkSession, path: str, origin: str) -> dict[str, DataFrame]:
    """Tables videos, annotations, categories and pairs of an annotation document, with their order in the file.

    The document is cut into elements by byte ranges, once for all tables, so its size is no task's. Raises ValueError if
    ``videos`` or ``annotations`` is missing.
    """
    elements, names = read_sections(spark, path)
    if not {"videos", "annotations"} <= names:
        raise ValueError("an annotation document needs videos and annotations")
    return {out: section_rows(elements, name, ANNOTATION_SCHEMA[name]).select(F.lit(origin).alias("origin"), "ord", "r.*") for out, name in (("videos", "videos"), ("annotations", "annotations"), ("categories", "categories"), ("pairs", "video_np_pairs"))}


def section_rows(elements: DataFrame, name: str, schema: str) -> DataFrame:
    """(ord, r): the parsed elements of one section."""
    return elements.filter(F.col("section") == name).select("ord", F.from_json("text", schema).alias("r"))


def taxonomy(categories: DataFrame) -> DataFrame:
    """(id, name, taxonomy) of the categories with any real level."""
    levels = clean_taxonomy({level: F.col(level) for level in LEVELS})
    return categories.select("id", display_name(F.col("name"), F.col("Species")).alias("name"), levels.alias("taxonomy"), "ord").filter("taxonomy is not null")


def taxonomy_by_name(categories: DataFrame) -> DataFrame:
    """(name, taxonomy): the first of each display name."""
    return taxonomy(categories).groupBy("name").agg(F.min_by("taxonomy", "ord").alias("taxonomy"))


def probes(tables: dict[str, DataFrame], include_negatives: bool = True) -> DataFrame:
    """Probes (video, category) with ``record_ord``: the pairs, or without pairs the annotated (video, category) once each.

    Pairs of unknown videos are dropped; zero masklets mark a hard negative.
    """
    videos = tables["videos"].select(F.col("id").alias("video_id"), "file_names", "location_id", F.col("video_creation_datetime").alias("creation_datetime"), "origin")
    names = tables["categories"].select(F.col("id").alias("category_id"), display_name(F.col("name"), F.col("Species")).alias("species"))
    keyed = tables["pairs"]
    if not keyed.limit(1).count():
        once = tables["annotations"].groupBy("video_id", "category_id").agg(F.min("ord").alias("ord"))
        keyed = once.withColumns({"noun_phrase": F.lit(None).cast("string"), "num_masklets": F.lit(1).cast("long")})
    rows = keyed.select("video_id", "category_id", "noun_phrase", "num_masklets", F.col("ord").cast("long").alias("record_ord"))
    rows = rows.join(videos, "video_id").join(names, "category_id", "left").withColumn("is_hard_negative", F.col("num_masklets") == 0)
    return rows if include_negatives else rows.filter("not is_hard_negative")


def masklet_frames(annotations: DataFrame) -> DataFrame:
    """A row a masklet and frame: origin, ann_id, video_id, category_id, frame_idx, present, rle, area."""
    each = annotations.select("origin", F.col("id").alias("ann_id"), "video_id", "category_id", F.col("ord").alias("masklet_ord"), "areas", F.posexplode_outer("segmentations").alias("frame_idx", "rle"))
    return each.withColumn("present", F.col("rle").isNotNull()).withColumn("area", F.get("areas", F.col("frame_idx"))).drop("areas")


def categories_with_masks(annotations: DataFrame) -> DataFrame:
    return annotations.filter(F.exists("segmentations", lambda s: s.isNotNull())).select("category_id").distinct()


def read_predictions(spark: SparkSession, path: str, tracker: str, stream: bool = False) -> DataFrame:
    """One row a prediction file ``{video}_{category}.json``: tracker, video_id, category_id, entries.

    A file that holds ``[]`` ran and found nothing, and keeps its row; a missing file has none.
    """
    if stream:
        raw = spark.readStream.schema("value string").option("wholetext", True).format("text").load(path)
    else:
        raw = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return raw.select(
        F.lit(tracker).alias("tracker"),
        F.regexp_extract(name, "^(.*)_([^_]*)$", 1).alias("video_id"),
        F.regexp_extract(name, "^(.*)_([^_]*)$", 2).alias("category_id"),
        F.from_json("value", _ENTRY).alias("entries"),
    )


def probe_rows(files: DataFrame) -> DataFrame:
    """(tracker, video_id, category_id, covered, total, scores): a row a prediction file, with its masklets' scores."""
    lengths = F.transform("entries", lambda e: F.coalesce(F.size(e.segmentations), F.lit(0)))
    seen = F.transform("entries", lambda e: F.filter(F.transform(e.segmentations, lambda s, i: F.when(s.isNotNull(), i)), lambda i: i.isNotNull()))
    total = F.coalesce(F.array_max(lengths), F.lit(0))
    covered = F.size(F.array_distinct(F.flatten(F.filter(seen, lambda s: s.isNotNull()))))
    scores = F.transform("entries", lambda e: F.when(e.isNotNull(), F.coalesce(e.score, F.lit(0.0))))
    return files.select("tracker", "video_id", "category_id", covered.alias("covered"), total.alias("total"), scores.alias("scores"))


def prediction_rows(files: DataFrame) -> DataFrame:
    """A row a predicted masklet (one with a null score for an empty file), with covered and total frames of its probe."""
    return probe_rows(files).select("tracker", "video_id", "category_id", "covered", "total", F.explode_outer("scores").alias("score"))


def read_evaluator(spark: SparkSession, path: str, prefer_bbox: bool = False) -> DataFrame:
    """(video_id, category_id, pDetA, pAssA, pHOTA): per metric the first spelling with a value."""
    names = sorted({n for spellings in METRIC_NAMES.values() for n in spellings})
    entry = "array<struct<video_id:string,category_id:string," + ",".join(f"{n}:double" for n in names) + ">>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<video_np_results:{entry},per_video:{entry},results:{entry}>").alias("r"))
    return evaluator_metrics(raw.select(F.explode(_first_filled("r.video_np_results", "r.per_video", "r.results")).alias("e")).select("e.*"), prefer_bbox)


def _first_filled(*names: str) -> Column:
    return F.coalesce(*(F.when(F.size(n) > 0, F.col(n)) for n in names))


def evaluator_metrics(entries: DataFrame, prefer_bbox: bool = False) -> DataFrame:
    def value(spellings: tuple[str, ...]) -> Column:
        mask, bbox, *rest = spellings
        ordered = [bbox, mask, *rest] if prefer_bbox else [mask, bbox, *rest]
        return F.coalesce(*(F.col(n) for n in ordered if n in entries.columns))

    return entries.select("video_id", "category_id", *(value(s).alias(m) for m, s in METRIC_NAMES.items()))


def read_class_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(class_name, path) of a CSV with a name and the levels; names are normalized, incomplete rows have a null path."""
    rows = spark.read.option("header", True).csv(path)
    complete = F.array(*(F.col(level) for level in LEVELS))
    return rows.select(normal_class_name(F.col("name")).alias("class_name"), F.when(F.forall(complete, is_real), complete).alias("path"))


def convert_tracks(spark: SparkSession, path: str, wanted: DataFrame, max_frames: int, min_frames: int, per_category: int) -> DataFrame:
    """(video_name, seq_ord, category_id, track_id, frame_names, rles): masklets of a map-of-tracks document.

    Only classes in ``wanted`` (class_name) are kept, with evenly capped frames, enough of them, any mask, and the
    first ``per_category`` sequences of a category in file order.
    """
    from relyframe.operators.caps import first_n

    elements, _ = read_sections(spark, path)
    classes = section_rows(elements, "categories", TRACK_SCHEMA["categories"]).select("r.*").select(F.col("id").alias("category_id"), "name", normal_class_name(F.col("name")).alias("class_name"))
    classes = classes.join(wanted.select("class_name").distinct(), "class_name", "left_semi")
    seq = section_rows(elements, "sequences", TRACK_SCHEMA["sequences"]).select(F.col("ord").alias("seq_ord"), "r.*")
    every = F.sequence(F.lit(0), F.size("annotated_image_paths") - 1)
    kept = F.when(F.size("annotated_image_paths") > 0, sample_evenly(every, max_frames))
    seq = seq.withColumn("kept", kept).filter(F.size("kept") >= min_frames)
    tracks = seq.select(
        "seq_ord", F.concat_ws("__", "dataset", "seq_name").alias("video_name"), F.col("seq_name").alias("location_id"), "kept", "annotated_image_paths",
        "segmentations", "height", "width", F.explode("track_category_ids").alias("track_id", "category_id"),
    )
    tracks = tracks.join(classes.select("category_id", F.col("name").alias("noun_phrase")), "category_id")
    tracks = tracks.withColumn("rles", F.transform("kept", lambda i: F.get(F.transform("segmentations", lambda m: F.nullif(m[F.col("track_id")].rle, F.lit(""))), i)))
    tracks = tracks.filter(F.exists("rles", lambda r: r.isNotNull()))
    firsts = first_n(tracks.select("category_id", "seq_ord").distinct(), ["category_id"], ["seq_ord"], per_category)
    return tracks.join(firsts, ["category_id", "seq_ord"], "left_semi").select(
        "video_name", "location_id", "seq_ord", "category_id", "noun_phrase", "track_id", "height", "width",
        F.transform("kept", lambda i: F.concat_ws("/", "video_name", F.get("annotated_image_paths", i))).alias("frame_names"), "rles",
    )


def category_entries(pairs: DataFrame, names: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, name, path) of the categories that pairs have, in the order of ids; a null path where the taxonomy has none."""
    used = pairs.select(F.col("category_id").alias("id")).distinct()
    return used.join(names.select("id", "name"), "id").join(paths.select("id", "path"), "id", "left").orderBy("id")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(name, height, width, rgb) of image files; files that can't be decoded are dropped."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(F.col("image.origin").alias("name"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("bgr"))


def frames_to_fetch(videos: DataFrame, present: DataFrame) -> DataFrame:
    """(source, file_name) of frames that no listing has yet."""
    wanted = videos.select("source", F.explode("file_names").alias("file_name")).distinct()
    return wanted.join(present.select("source", "file_name"), ["source", "file_name"], "left_anti")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(key), key, "left_anti")


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the finished runs of ``append_once``; none before the first."""
    system, root = _folder(spark, f"{path}/commits")
    runs = [f.getPath().getName() for f in system.listStatus(root)] if system.exists(root) else []
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/{run}" for run in runs))


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def append_once(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys no finished run has; a run counts as a whole or not at all.

    A run writes its rows to a folder of its own, and then an empty file of its name into the commit log, which is the one
    step that makes them visible. A run that dies leaves a folder that nobody reads and that the next run deletes, so running
    again neither loses nor doubles a key. All rows of a key must be in one call; one writer at a time.
    """
    spark, schema = rows.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    done = committed(spark, path, schema).select(*keys).distinct()
    (system, data), (_, log) = _folder(spark, f"{path}/data"), _folder(spark, f"{path}/commits")
    known = {f.getPath().getName() for f in system.listStatus(log)} if system.exists(log) else set()
    for f in system.listStatus(data) if system.exists(data) else ():
        if f.getPath().getName() not in known:
            system.delete(f.getPath(), True)
    run = uuid.uuid4().hex
    same = [rows[k].eqNullSafe(done[k]) for k in keys]
    rows.join(done, same, "left_anti").write.parquet(f"{path}/data/{run}")
    system.create(_folder(spark, f"{path}/commits/{run}")[1], False).close()


def write_long(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Results as Parquet, or on request CSV or JSON."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)
