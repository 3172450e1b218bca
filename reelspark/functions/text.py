"""Text, time and naming expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """H:MM:SS.mmm; negative is 0, milliseconds are rounded half to even and not carried."""
    s = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(s).cast("long")
    ms = F.bround((s - whole) * 1000, 0).cast("long")
    return F.format_string("%d:%02d:%02d.%03d", (whole / 3600).cast("long"), (whole % 3600 / 60).cast("long"), whole % 60, ms)


def clock_short(seconds: Column) -> Column:
    """HH:MM:SS, truncated."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), (s % 3600 / 60).cast("long"), s % 60)


def video_id(url: Column) -> Column:
    """The id in a watch, short, live or short-host address; null in any other."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    filled = lambda x: F.when(x != "", x)
    watch = filled(F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1))
    by_path = filled(F.regexp_extract(path, r"^/(?:shorts|live)/([^/]+)", 1))
    short = filled(F.split_part(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit(1)))
    own = (host == "youtube.com") | host.endswith(".youtube.com")
    return F.when(host == "youtu.be", short).when(own & (path == "/watch"), watch).when(own, by_path)


def patch_size(model: Column) -> Column:
    return F.when(F.lower(model).contains("qwen3"), 32).otherwise(28)


def edge_pixels(edge: Column, model: Column) -> Column:
    p = patch_size(model)
    return edge * p * p


def expand_grid(t: Column, h: Column, w: Column) -> Column:
    """T rows of [1, H, W]."""
    return F.array_repeat(F.array(F.lit(1).cast("long"), h.cast("long"), w.cast("long")), t.cast("int"))


def after_reasoning(text: Column, mark: str = "</think>") -> Column:
    """What follows the first closing mark, without leading white space; the text itself if there is none."""
    at = F.instr(text, F.lit(mark))
    return F.when(at > 0, F.regexp_replace(F.substring(text, at + len(mark), F.length(text)), r"^\s+", "")).otherwise(text)


def error_texts(body: Column) -> Column:
    """The strings in a JSON payload at any depth, in order, without the names of fields; any other text is one string."""
    quoted = r'"((?:[^"\\]|\\.)*)"(\s*:)?'
    string = lambda x: F.get(F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>"), F.lit(0))
    found = F.zip_with(F.regexp_extract_all(body, F.lit(quoted), F.lit(1)), F.regexp_extract_all(body, F.lit(quoted), F.lit(2)), lambda x, name: F.when(name == "", string(x)))
    values = F.filter(found, lambda x: x.isNotNull())
    return F.when(body.isNull(), F.array().cast("array<string>")).when(F.ltrim(body).rlike(r"^[{\[]"), values).otherwise(F.array(body))


def flat_errors(parts: Column) -> Column:
    """Distinct non-null strings in order, one to a line, in lower case."""
    return F.lower(F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), "\n"))


# What a message holds when an answer is worth another try.
_TOKENS = ("token count",), ("truncation='max_length'", 'truncation="max_length"'), ("image", "video")
_PROCESSOR = ("failed to apply qwen",), ("processor",), ("image",)


def worth_retrying(message: Column) -> Column:
    """Whether a flattened error is one that a smaller input can mend."""
    def every(groups: tuple[tuple[str, ...], ...]) -> Column:
        return functools.reduce(Column.__and__, (functools.reduce(Column.__or__, (message.contains(x) for x in group)) for group in groups))

    return every(_TOKENS) | every(_PROCESSOR)


def halvings(n: Column) -> Column:
    """n, n // 2, n // 4, ... down to 1."""
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")))
    return F.transform(steps, lambda k: F.floor(F.greatest(n, F.lit(1)) / F.pow(F.lit(2.0), k)).cast("int"))


def source_stem(stem: Column) -> Column:
    """The stem an augmented image was made from: without ``_orig`` at its end, or cut at its last ``_aug``."""
    return F.when(stem.endswith("_orig"), F.regexp_replace(stem, "_orig$", "")).otherwise(F.regexp_replace(stem, "^(.*)_aug.*$", "$1"))


def person_segment(person: Column, segment: Column) -> Column:
    return F.format_string("person_%02d/seg_%03d", person, segment)


def output_dir(name: Column, prefix: str = "desc-vllm-") -> Column:
    return F.concat(F.lit(prefix), F.replace(name, F.lit("/"), F.lit("_")))


def message_texts(transcript: Column, lines: Column, prompt: Column, more: Column) -> Column:
    """The text parts of a message that are there, in order: transcript, listed segments, prompt, request to go on."""
    # The wording around them.
    heard = F.lit("Here is an automatic transcription of the video's audio track. Use it together with the visual frames to better understand the scene, dialogue, speakers, and any on-screen text they mention:\n\n")
    listed = F.lit("Timestamp-aligned audio segments with approximate frame ranges:\n")
    further = F.lit("Continue describing the video in more detail, focusing on any aspects you haven't mentioned yet.")
    full = lambda x: x.isNotNull() & (x != "")
    parts = F.array(F.when(full(transcript), F.concat(heard, transcript)), F.when(F.size(lines) > 0, F.concat(listed, F.array_join(lines, "\n"))), F.when(full(prompt), prompt), F.when(more, further))
    return F.filter(parts, lambda x: x.isNotNull())


def resized(width: Column, height: Column, edge: int) -> list[Column]:
    """Width and height scaled so that the longest edge is at most ``edge``."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))
    return [(width * scale).cast("int"), (height * scale).cast("int")]


def frame_range(start: Column, end: Column, fps: Column, frames: Column) -> list[Column]:
    """First and last frame of an interval of seconds, inside the video."""
    fps = F.when(fps > 0, fps).otherwise(F.lit(30.0))
    a = F.bround(F.greatest(F.lit(0.0), start) * fps, 0).cast("int")
    b = F.bround(F.greatest(start, end) * fps, 0).cast("int")
    inside = lambda x: F.least(x, frames - 1)
    first = F.when(frames > 0, inside(F.greatest(F.lit(0), a))).otherwise(a)
    return [first, F.when(frames > 0, inside(F.greatest(first, b))).otherwise(b)]


def model_family(path: Column) -> Column:
    """The family of a swap model by its file's stem, the most specific name first."""
    stem, kind = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]+$", "")), None
    for name in ("uniface", "hyperswap", "blendswap", "simswap"):  # fixed values
        kind = F.when(stem.contains(name), name) if kind is None else kind.when(stem.contains(name), name)
    return kind.otherwise("inswapper")


def tensor_role(shape: Column) -> Column:
    """What an input of a model takes, by its shape."""
    return F.when(F.size(shape) == 2, "embedding").when(F.size(shape) == 4, F.when(F.get(shape, F.lit(1)) == 3, "image").otherwise("embedding")).otherwise("unknown")
