"""Track post-processing: suppression per frame, linking per video, assembly per track."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Detections that a task links at once.
CHUNK_ROWS = 65_536


def suppress(detections: DataFrame, iou: float = 0.5) -> DataFrame:
    """Detections (video_id, frame_idx, det_id, score, box) that survive greedy suppression by falling score.

    Boxes are (x0, y0, x1, y1); rows without one are dropped. A group is one frame's top detections, folded in order.
    """
    kept_cols = [c for c in detections.columns if c not in ("video_id", "frame_idx")]
    row = F.struct((-F.col("score")).alias("_rank"), "det_id", F.struct(*kept_cols).alias("row"))
    frames = detections.filter("box is not null").groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])

    def overlap(a: Column, b: Column) -> Column:
        side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
        shared = side(0, 2) * side(1, 3)
        return shared / F.greatest(size(a) + size(b) - shared, F.lit(1e-12))

    first = F.slice("rows", F.lit(1), F.lit(1))
    survive = F.aggregate(
        F.slice("rows", F.lit(2), F.size("rows")),
        first,
        lambda acc, r: F.when(F.exists(acc, lambda k: overlap(k.row.box, r.row.box) > iou), acc).otherwise(F.concat(acc, F.array(r))),
    )
    return frames.select("video_id", "frame_idx", F.explode(survive).alias("s")).select("video_id", "frame_idx", "s.row.*").select(*detections.columns)


def _assign(similarity: np.ndarray) -> np.ndarray:
    """For many frames of one shape (frame, row, column), the column of each row in the assignment with the greatest sum; -1
    without one. Where the rows' best columns differ, they are it (and what augmenting paths would give, also for ties).
    """
    frames, n, m = similarity.shape
    if n > m:
        columns, rows = _assign(similarity.swapaxes(1, 2)), np.full((frames, n), -1)
        np.put_along_axis(rows, columns, np.arange(m)[None, :], 1)
        return rows
    out = similarity.argmax(2)
    ordered = np.sort(out, 1)
    if (hard := (ordered[:, 1:] == ordered[:, :-1]).any(1)).any():
        out[hard] = _augmented(similarity[hard])
    return out


def _augmented(similarity: np.ndarray) -> np.ndarray:
    """The same by shortest augmenting paths, for no more rows than columns. All frames take a step at once."""
    frames, n, m = similarity.shape
    cost = np.pad(-similarity, ((0, 0), (1, 0), (1, 0)))  # column 0 holds the row that looks for one
    u, v, match = np.zeros((frames, n + 1)), np.zeros((frames, m + 1)), np.zeros((frames, m + 1), int)
    for i in range(1, n + 1):
        match[:, 0] = i
        least, used, way = np.full((frames, m + 1), np.inf), np.zeros((frames, m + 1), bool), np.zeros((frames, m + 1), int)
        at, live = np.zeros(frames, int), np.arange(frames)
        while live.size:
            used[live, at[live]] = True
            row, taken = match[live, at[live]], used[live]
            reduced = cost[live, row] - u[live, row][:, None] - v[live]
            better = ~taken & (reduced < least[live])
            least[live] = np.where(better, reduced, least[live])
            way[live] = np.where(better, at[live][:, None], way[live])
            at[live] = np.where(taken, np.inf, least[live]).argmin(1)
            step = least[live, at[live]]
            k, column = np.nonzero(taken)
            u[live[k], match[live[k], column]] += step[k]
            v[live] -= np.where(taken, step[:, None], 0)
            least[live] -= np.where(taken, 0, step[:, None])
            live = live[match[live, at[live]] != 0]
        live = np.arange(frames)
        while live.size:
            before = way[live, at[live]]
            match[live, at[live]] = match[live, before]
            at[live] = before
            live = live[before != 0]
    k, column = np.nonzero(match[:, 1:])
    out = np.empty((frames, n), int)
    out[k, match[k, column + 1] - 1] = column
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(frame, row, column) of unit vectors (frame, row, i) and (frame, column, i), added in the order of i, so equal vectors tie."""
    out = np.zeros((len(a), a.shape[1], b.shape[1]))
    for p, q in zip(a.transpose(2, 0, 1), np.ascontiguousarray(b.transpose(2, 0, 1)), strict=True):
        out += p[:, :, None] * q[:, None, :]
    return out


def _link_rows(new_video: np.ndarray, new_frame: np.ndarray, x: np.ndarray, running: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Track ids of rows in the order of videos and frames, and the running tracks of the last video.

    new_video, new_frame: whether a row begins one. running: the first video's tracks so far. The k-th frames of all videos are
    linked together, by shape.
    """
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    first = np.flatnonzero(new_frame)
    size, owner = np.diff(first, append=len(x)), np.cumsum(new_video)[first] - 1
    begin = np.flatnonzero(new_video)
    turn = np.arange(len(first)) - np.searchsorted(first, begin)[owner]
    # A video has no more tracks than rows, so its tracks have places in one array; those of the first come before.
    tracks, offset = np.concatenate([running, np.empty_like(x)]), begin + np.where(begin > 0, len(running), 0)
    count, ids = np.zeros(len(begin), int), np.empty(len(x), int)
    count[0] = len(running)
    order = np.argsort(turn, kind="stable")
    for these in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
        shapes = size[these] * (len(tracks) + 1) + count[owner[these]]
        by_shape = np.argsort(shapes, kind="stable")
        for at in np.split(these[by_shape], np.flatnonzero(np.diff(shapes[by_shape])) + 1) if len(these) > 1 else [these]:
            own, n = owner[at], size[at[0]]
            m, rows = count[own[0]], first[at][:, None] + np.arange(n)
            got = x[rows]
            column, near = np.full(rows.shape, -1), np.zeros(rows.shape, bool)
            if m:
                similar = _cosines(got, tracks[offset[own][:, None] + np.arange(m)])
                similar = np.where(np.isfinite(similar), similar, -2.0)
                column = _assign(similar)
                near = (column >= 0) & (np.take_along_axis(similar, np.maximum(column, 0)[:, :, None], 2)[:, :, 0] >= threshold)
            ids[rows] = given = np.where(near, column, m + np.cumsum(~near, 1) - 1)
            tracks[offset[own][:, None] + given] = got
            count[own] += (~near).sum(1)
    return ids, tracks[offset[-1] : offset[-1] + count[-1]].copy()


def link(detections: DataFrame, threshold: float) -> DataFrame:
    """Detections (video_id, frame_idx, det_id, embed) with ``track_id``: per frame the assignment to running tracks with
    the greatest summed cosine; pairs below the threshold start tracks of their own; a track keeps its last vector.

    Linking is sequential inside a video and parallel over videos. A task reads its videos in order and links many at once, with
    CHUNK_ROWS detections and the running tracks of one video in memory. Rows without a video, frame or vector have no track.
    """
    schema = StructType([*detections.schema.fields, StructField("track_id", LongType())])

    def begins(rows: pa.Table, key: str) -> np.ndarray:
        """Whether a row has another key than the one before."""
        values = rows[key].combine_chunks()
        return np.concatenate([[True], pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)])

    def linked(rows: pa.Table, running: np.ndarray, goes_on: bool) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's ids; running: of the video whose last frames were in the chunk before, if goes_on."""
        vectors = rows["embed"].combine_chunks()
        new_video = begins(rows, "video_id")
        flat, n = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        if (np.diff(n)[~new_video[1:]] != 0).any() or goes_on and running.shape[1] != n[0]:
            raise ValueError("the vectors of a video differ in length")
        wide = int(n.max())
        x = np.zeros((len(n), wide))
        x[np.arange(wide) < n[:, None]] = flat
        before = np.zeros((len(running) if goes_on else 0, wide))
        if goes_on:
            before[:, : running.shape[1]] = running
        ids, running = _link_rows(new_video, new_video | begins(rows, "frame_idx"), x, before, threshold)
        return ids, running[:, : n[-1]]

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
        """Tables, and whether their rows can be linked; those have whole frames, and are of about CHUNK_ROWS or one frame."""
        waiting, n = [], 0
        for batch in batches:
            whole = pc.and_(pc.and_(batch["video_id"].is_valid(), batch["frame_idx"].is_valid()), batch["embed"].is_valid())
            if whole.true_count < len(batch):
                yield pa.Table.from_batches([batch.filter(pc.invert(whole))]), False
                batch = batch.filter(whole)
            if len(batch):
                waiting.append(batch)
                n += len(batch)
            if n >= CHUNK_ROWS:
                rows = pa.Table.from_batches(waiting)
                cut = int(np.flatnonzero(begins(rows, "video_id") | begins(rows, "frame_idx"))[-1])
                if cut:
                    yield rows.slice(0, cut), True
                waiting, n = rows.slice(cut).to_batches(), len(rows) - cut if cut else 0
        if waiting:
            yield pa.Table.from_batches(waiting), True

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = None, np.empty((0, 0))
        for rows, can_link in chunks(batches):
            ids = pa.nulls(len(rows), pa.int64())
            if can_link:
                found, running = linked(rows, running, last is not None and rows["video_id"][0] == last)
                ids, last = pa.array(found), rows["video_id"][-1]
            yield from rows.append_column("track_id", ids).to_batches()

    dealt = detections.repartition("video_id").sortWithinPartitions("video_id", "frame_idx", "det_id", "embed")
    return dealt.mapInArrow(task, schema)


def assemble(detections: DataFrame, n_frames: int, threshold: float = 0.0, gain: float = 1.0) -> DataFrame:
    """(video_id, track_id, score, segmentations): one masklet a track, padded with nulls to n_frames.

    The score is the greatest over frames, tested before the gain; a frame out of range is an error.
    """
    checked = F.when(F.col("frame_idx").between(0, n_frames - 1), F.col("frame_idx")).otherwise(F.raise_error(F.lit("frame index out of range")).cast("int"))
    rows = detections.withColumn("frame_idx", checked)
    each = rows.groupBy("video_id", "track_id").agg(F.max("score").alias("raw"), F.sort_array(F.collect_list(F.struct("frame_idx", "rle"))).alias("seen"))
    each = each.filter(F.col("raw") >= threshold)
    # The first of a frame's rows counts; each is put behind as many nulls as frames lie between it and the one before.
    once = F.filter("seen", lambda s, k: (k == 0) | (F.get("seen", k - 1).frame_idx != s.frame_idx))
    each = each.withColumn("seen", once)
    none = lambda n: F.array_repeat(F.lit(None).cast(rows.schema["rle"].dataType), n.cast("int"))
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get("seen", k - 1).frame_idx)
    filled = F.flatten(F.transform("seen", lambda s, k: F.concat(none(s.frame_idx - before(k) - 1), F.array(s.rle))))
    padded = F.concat(filled, none(F.lit(n_frames - 1) - F.element_at("seen", -1).frame_idx))
    return each.select("video_id", "track_id", F.least(F.col("raw") * gain, F.lit(1.0)).alias("score"), padded.alias("segmentations"))
