"""Text and time-code expressions, all JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that takes no time to speak.
_SILENT_PATTERN = r"(?U)[\s，。！？、,.!?;；:：\"'“”‘’（）()\[\]【】]"


def _pad(value: Column, width: int) -> Column:
    return F.when(F.length(value.cast("string")) >= width, value.cast("string")).otherwise(
        F.lpad(value.cast("string"), width, "0")
    )


def _clock(ms: Column) -> tuple[Column, Column, Column, Column]:
    total = F.greatest(ms, F.lit(0)).cast("bigint")
    seconds = F.floor(total / 1_000)
    return F.floor(seconds / 3_600), F.floor(seconds / 60) % 60, seconds % 60, total % 1_000


def parse_srt_time(text: Column) -> Column:
    """``H:M:S,mmm`` or ``H:M:S.mmm`` to milliseconds; a short fraction is padded on the right."""
    parts = F.split(F.replace(F.trim(text), F.lit("."), F.lit(",")), "[:,]", 4)
    hour, minute, second = (F.element_at(parts, i).cast("bigint") for i in (1, 2, 3))
    fraction = F.rpad(F.substring(F.element_at(parts, 4), 1, 3), 3, "0").cast("bigint")
    return ((hour * 60 + minute) * 60 + second) * 1_000 + fraction


def format_srt_time(ms: Column) -> Column:
    """Milliseconds to ``HH:MM:SS,mmm``; negative times become zero."""
    hour, minute, second, fraction = _clock(ms)
    return F.concat(_pad(hour, 2), F.lit(":"), _pad(minute, 2), F.lit(":"), _pad(second, 2), F.lit(","), _pad(fraction, 3))


def format_lrc_time(ms: Column) -> Column:
    """``[MM:S.ss]``; the seconds are not padded."""
    minutes = F.floor(ms / 60_000)
    hundredths = F.floor((ms % 60_000) / 10 + 0.5)
    seconds = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), _pad(hundredths % 100, 2))
    return F.concat(F.lit("["), _pad(minutes, 2), F.lit(":"), seconds, F.lit("]"))


def format_ass_time(ms: Column) -> Column:
    """``H:MM:SS.cc`` with truncated hundredths."""
    hour, minute, second, fraction = _clock(ms)
    return F.concat(
        hour.cast("string"), F.lit(":"), _pad(minute, 2), F.lit(":"), _pad(second, 2), F.lit("."), _pad(F.floor(fraction / 10), 2)
    )


def parse_ass_time(text: Column) -> Column:
    parts = F.split(text, "[:.]")
    hour, minute, second, hundredth = (F.element_at(parts, i).cast("bigint") for i in (1, 2, 3, 4))
    return ((hour * 60 + minute) * 60 + second) * 1_000 + hundredth * 10


def keep_alnum(text: Column) -> Column:
    """Lower-cased letters and digits only; the caller composes compatibility forms first where needed."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def norm_words(text: Column) -> Column:
    """Lower case, word characters only; the underscore stays."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}_]+", "")


def text_units(text: Column) -> Column:
    """Length without blanks and silent punctuation, at least one."""
    return F.greatest(F.lit(1), F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), _SILENT_PATTERN, ""))).cast("bigint")


def char_len(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")).cast("bigint")


def tts_ms(text: Column, chars_per_second: float, min_ms: int) -> Column:
    """Estimated speaking time in milliseconds, half up."""
    spoken = text_units(text) * 1_000 / F.lit(max(0.1, chars_per_second))
    return F.floor(F.greatest(F.lit(float(min_ms)), spoken) + 0.5).cast("bigint")


def media_shot_id(prefix: str, number: Column) -> Column:
    width = 6 if prefix == "movie_shot" else 3
    return F.format_string(f"{prefix}_%0{width}d", number)


def strip_fence(text: Column) -> Column:
    """Body of a fenced code block if there is one, cut to the outermost braces."""
    blanks = F.lit(" \n\r\t")
    raw = F.trim(F.coalesce(text, F.lit("")), blanks)
    # What stands between the first two fence marks, without the name of the language.
    parts = F.split(raw, "```", 3)
    inside = F.element_at(parts, 2)
    named = F.lower(F.substring(inside, 1, 4)) == "json"
    bare = F.trim(F.when(named, F.substring(inside, 5, F.char_length(inside))).otherwise(inside), blanks)
    body = F.when(F.size(parts) == 3, bare).otherwise(raw)
    opened = F.instr(body, "{")
    closed = F.char_length(body) - F.instr(F.reverse(body), "}") + 1
    has = (F.instr(body, "{") > 0) & (F.instr(body, "}") > 0) & (closed > opened)
    return F.when(body.startswith("{") | ~has, body).otherwise(body.substr(opened, closed - opened + 1))


def repair_backslashes(text: Column) -> Column:
    """Double the last backslash of an odd run that is followed by a character JSON cannot escape."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\(?![\"\\/bfnrtu])(?=[\s\S])", r"$1\\\\")
