"""Count windows, transcripts and message assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions import text
from reelspark.functions.text import clock
from reelspark.operators.segment import effective_frames


def in_order(order: str, text: Column, between: str) -> Column:
    """Texts of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), between)


def windows(texts: DataFrame, size: int, reduce: Callable[[Column], Column], key: str = "key", order: str = "ord") -> DataFrame:
    """(key, ord, text): consecutive texts in windows of ``size``, each reduced; a key with at most ``size`` texts keeps them.

    ``reduce`` makes a text of a window's numbered body, for example by calling a model in a pandas UDF.
    """
    by = W.partitionBy(key)
    rows = texts.select(key, order, "text", F.row_number().over(by.orderBy(order)).alias("rn"), F.count("*").over(by).alias("n"))
    head = F.concat(F.lit("--- Segment "), F.col("rn"), F.lit(" ---\n"), F.col("text"))
    many = rows.where(F.col("n") > size).groupBy(key, F.floor((F.col("rn") - 1) / size).cast("int").alias("w")).agg(in_order("rn", head, "\n\n").alias("body"))
    reduced = many.select(key, F.col("w").alias("ord"), reduce(F.col("body")).alias("text"))
    return reduced.unionByName(rows.where(F.col("n") <= size).select(key, (F.col("rn") - 1).alias("ord"), "text"))


def consolidated(texts: DataFrame, size: int, prompt: str, reduce: Callable[[Column], Column], key: str = "key", order: str = "ord") -> DataFrame:
    """(key, body): the final prompt over the windows, or over the segments where there were few."""
    counts = texts.groupBy(key).agg(F.count("*").alias("all"))
    parts = windows(texts, size, reduce, key, order).join(counts, key)
    label = F.when(F.count("*").over(W.partitionBy(key)) < F.col("all"), "Window").otherwise("Segment")
    parts = parts.withColumn("label", label)
    head = F.concat(F.lit("--- "), F.col("label"), F.lit(" "), F.col("ord") + 1, F.lit(" ---\n"), F.col("text"))
    return parts.groupBy(key).agg(F.concat(F.lit(prompt + "\n\n"), in_order("ord", head, "\n\n")).alias("body"))


def assembled(summary: Column, descriptions: Column) -> Column:
    """A run's output: the summary, if any, and the descriptions."""
    return F.when(summary.isNull(), descriptions).otherwise(F.concat(F.lit("=== Consolidated Summary ===\n\n"), summary, F.lit("\n\n=== Per-Segment Descriptions ===\n\n"), descriptions))


CHUNK = "struct<text:string,timestamp:string,timestamps:string>"


def transcript_parts(units: DataFrame, keys: tuple[str, ...] = ("media",)) -> DataFrame:
    """Chunks of recognised speech at absolute times: (keys, segment_index, chunk, text, start_s, end_s).

    ``units``: keys, segment_index, start, result (JSON: an object with chunks or text, or a string).
    Times are null where the chunk has not both; such a chunk gives text but no segment.
    """
    base = F.coalesce(F.col("start").cast("double"), F.lit(0.0))
    chunks = F.from_json(F.get_json_object("result", "$.chunks"), f"array<{CHUNK}>")
    plain = F.coalesce(F.get_json_object("result", "$.text"), F.when(F.col("result").startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), "result", F.lit("}")), "$.x")))
    whole = F.when(plain.isNotNull(), F.array(F.struct(plain.alias("text"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("timestamps"))))
    rows = units.select(*keys, "segment_index", base.alias("base"), F.posexplode(F.when(F.size(chunks) > 0, chunks).otherwise(whole)).alias("chunk", "c")).where("c.text <> ''")
    ts = F.coalesce("c.timestamp", "c.timestamps")
    listed = F.from_json(ts, "array<double>")
    start = F.when(ts.startswith("["), F.get(listed, F.lit(0))).otherwise(F.get_json_object(ts, "$.start").cast("double"))
    end = F.when(ts.startswith("["), F.get(listed, F.lit(1))).otherwise(F.get_json_object(ts, "$.end").cast("double"))
    timed = start.isNotNull() & end.isNotNull()
    return rows.select(*keys, "segment_index", "chunk", F.trim("c.text").alias("text"), F.when(timed, F.col("base") + start).alias("start_s"), F.when(timed, F.col("base") + end).alias("end_s"))


def raw_text(parts: DataFrame, key: str = "media") -> DataFrame:
    """(key, raw): all texts in order."""
    order = F.struct("segment_index", "chunk")
    return parts.withColumn("_o", order).groupBy(key).agg(F.trim(in_order("_o", F.col("text"), " ")).alias("raw"))


def rendered(segments: DataFrame, key: str = "media", order: str = "ord") -> DataFrame:
    """(key, listing): numbered segments with their times; numbers of segments without times stay unused.

    ``segments``: key, order, start_s, end_s, text, raw (the text without times, may be blank).
    """
    rows = segments.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(order)))
    text = F.trim(F.coalesce("text", F.lit("")))
    entry = F.concat(F.col("rn").cast("string"), F.lit("\n"), clock(F.col("start_s")), F.lit(" --> "), clock(F.col("end_s")), F.when(text != "", F.concat(F.lit("\n"), text)).otherwise(F.lit("")), F.lit("\n"))
    shown = F.when(F.col("start_s").isNotNull() & F.col("end_s").isNotNull(), F.struct("rn", entry.alias("t")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["t"]), "\n")
    raw = F.trim(F.coalesce(F.first("raw"), F.lit("")))
    head = F.when(raw != "", F.concat(F.lit("Raw transcript (no timestamps):\n"), raw, F.lit("\n\n"))).otherwise(F.lit(""))
    return rows.groupBy(key).agg(F.regexp_replace(F.concat(head, F.lit("Transcript with timestamps:\n"), body), r"\s+$", "").alias("listing"))


def messages(videos: DataFrame, segments: DataFrame, key: str = "media") -> DataFrame:
    """(key, system, video, nframes, total_pixels, texts): the chat message about each video.

    ``videos``: key, path, width, height, fps, num_frames, nframes, total_pixels, spf, prompt, system,
    more, transcript, video_only. ``segments``: key, ord, start_s, end_s, text; one without both
    times is left out but counts in the numbers of the others. A message of ``video_only`` names
    neither frames nor pixels.
    """
    told = segments.withColumn("_no", F.row_number().over(W.partitionBy(key).orderBy("ord"))).where("start_s is not null and end_s is not null").join(videos.select(key, F.col("fps").alias("_fps"), F.col("num_frames").alias("_frames")), key)
    first, last = text.frame_range(F.col("start_s"), F.col("end_s"), F.coalesce("_fps", F.lit(0.0)), F.col("_frames"))
    shown = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "<no text>").otherwise(F.trim("text"))
    line = F.concat(F.lit("Segment "), F.col("_no"), F.lit(": "), text.clock(F.col("start_s")), F.lit(" – "), text.clock(F.col("end_s")), F.lit(" (frames "), first, F.lit("–"), last, F.lit(")\n"), shown)
    lines = told.select(key, "_no", line.alias("_line")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_line"))), lambda x: x["_line"]).alias("_lines"))
    both = videos.join(lines, key, "left")
    shown_only = lambda x: F.when(~F.col("video_only"), x)
    frames = effective_frames(F.col("nframes"), F.col("num_frames"), F.col("fps"), F.col("spf"))
    pixels = F.when(F.col("total_pixels") > 0, F.col("total_pixels")).otherwise(F.col("width") * F.col("height"))
    texts = text.message_texts(F.col("transcript"), F.coalesce("_lines", F.array().cast("array<string>")), F.col("prompt"), F.col("more"))
    return both.select(key, F.when(F.col("system") != "", F.col("system")).alias("system"), F.col("path").alias("video"), shown_only(frames).alias("nframes"), shown_only(pixels).alias("total_pixels"), texts.alias("texts"))
