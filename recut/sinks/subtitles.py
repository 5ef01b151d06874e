"""Subtitle tables as files and nested documents.

``*_blocks`` render one text per row, so a long media file needs no task to hold all of it;
``join_blocks`` assembles one string per file where a single document is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recut.functions.text import format_ass_time, format_lrc_time, format_srt_time
from recut.operators.ordered import TIME_SLICE_MS, position, scan
from recut.sources.subtitles import plain, strip

# Fixed layout names of bilingual dialogue files.
LAYOUTS = ("译文在上", "原文在上", "仅原文", "仅译文")


def _spoken(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def srt_blocks(entries: DataFrame, keys: Sequence[str], order: Sequence[str], *, gaps: bool = True, width: float = TIME_SLICE_MS) -> DataFrame:
    """Numbered SRT blocks.  With ``gaps`` blank entries use up a number, else they are left out first."""
    rows = entries if gaps else entries.where(_spoken(F.col("text")) != "")
    numbered = scan(rows, keys, order, [position("block_no")], width=width).where(_spoken(F.col("text")) != "")
    clock = F.concat_ws(" --> ", format_srt_time(F.col("start_ms")), format_srt_time(F.col("end_ms")))
    return numbered.select(*keys, "block_no", F.concat_ws("\n", F.col("block_no").cast("string"), clock, _spoken(F.col("text")), F.lit("")).alias("block"))


def lrc_blocks(entries: DataFrame, keys: Sequence[str], order: Sequence[str], *, width: float = TIME_SLICE_MS) -> DataFrame:
    numbered = scan(entries, keys, order, [position("block_no")], width=width)
    return numbered.select(*keys, "block_no", F.concat(format_lrc_time(F.col("start_ms")), F.col("text")).alias("block"))


def txt_blocks(entries: DataFrame, keys: Sequence[str], order: Sequence[str], *, width: float = TIME_SLICE_MS) -> DataFrame:
    numbered = scan(entries, keys, order, [position("block_no")], width=width)
    return numbered.select(*keys, "block_no", F.col("text").alias("block"))


def bilingual_rows(entries: DataFrame, keys: Sequence[str], order: Sequence[str], *, width: float = TIME_SLICE_MS) -> DataFrame:
    """Original and translation of every entry, split at the line break, numbered from one."""
    numbered = scan(entries, keys, order, [position("block_no")], width=width)
    parts = F.split("text", "\n", 2)
    return numbered.select(
        *keys, "block_no", F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"),
        F.element_at(parts, 1).alias("original_subtitle"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("translated_subtitle"),
    )


def bilingual_documents(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON map of ordinal to segment per file."""
    entry = F.struct("start_time", "end_time", "original_subtitle", "translated_subtitle")
    pairs = F.array_sort(F.collect_list(F.struct("block_no", entry.alias("v"))))
    mapping = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p.block_no.cast("string"), p.v)))
    return rows.groupBy(*keys).agg(F.to_json(mapping).alias("content"))


def ass_blocks(entries: DataFrame, keys: Sequence[str], order: Sequence[str], layout: str, *, width: float = TIME_SLICE_MS) -> DataFrame:
    """Dialogue lines; the layout decides which of the two languages show, and in which order."""
    numbered = scan(entries, keys, order, [position("entry_no")], width=width)
    parts = F.split("text", "\n", 2)
    first, second = F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    line = lambda style, text: F.struct(F.lit(style).alias("style"), text.alias("text"))
    none = F.array().cast("array<struct<style:string,text:string>>")
    translated = second != ""
    shown = {
        LAYOUTS[0]: F.when(translated, F.array(line("Secondary", first), line("Default", second))).otherwise(none),
        LAYOUTS[1]: F.when(translated, F.array(line("Secondary", second), line("Default", first))).otherwise(none),
        LAYOUTS[2]: F.array(line("Default", first)),
        LAYOUTS[3]: F.when(translated, F.array(line("Default", second))).otherwise(none),
    }[layout]
    lines = F.when(F.contains("text", F.lit("\n")), shown).otherwise(F.array(line("Default", F.col("text"))))
    rows = numbered.select(*keys, "entry_no", "start_ms", "end_ms", F.posexplode(lines).alias("line_no", "__l"))
    return rows.select(
        *keys, (F.col("entry_no") * 2 + F.col("line_no") - 1).alias("block_no"),
        F.concat(F.lit("Dialogue: 0,"), format_ass_time(F.col("start_ms")), F.lit(","), format_ass_time(F.col("end_ms")), F.lit(","), F.col("__l.style"), F.lit(",,0,0,0,,"), F.col("__l.text")).alias("block"),
    )


def join_blocks(blocks: DataFrame, keys: Sequence[str], separator: str = "\n") -> DataFrame:
    """One document per file."""
    rows = F.array_sort(F.collect_list(F.struct("block_no", "block")))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r.block), separator).alias("content"))


# Sections and fields an event file must open with.
ASS_INFO = {"ScriptType": "v4.00+", "PlayResX": "1280", "PlayResY": "720"}
ASS_STYLE_FIELDS = (
    "Name", "Fontname", "Fontsize", "PrimaryColour", "SecondaryColour", "OutlineColour", "BackColour", "Bold", "Italic", "Underline", "StrikeOut",
    "ScaleX", "ScaleY", "Spacing", "Angle", "BorderStyle", "Outline", "Shadow", "Alignment", "MarginL", "MarginR", "MarginV", "Encoding",
)
ASS_EVENT_FIELDS = ("Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text")
WHITE, RED, BLACK = "&H00FFFFFF", "&H000000FF", "&H00000000"


def ass_head(font: str = "Arial", size: int = 66, second_size: int = 40) -> str:
    """Script info, the two styles of the layouts, and the head of the events."""
    look = ("-1", "0", "0", "0", "100", "100", "0", "0", "1", "2", "0", "2", "10", "10", "10", "1")
    styles = [",".join((name, font, str(points), WHITE, RED, BLACK, BLACK, *look)) for name, points in (("Default", size), ("Secondary", second_size))]
    sections = (
        ["[Script Info]", *(f"{k}: {v}" for k, v in ASS_INFO.items()), ""],
        ["[V4+ Styles]", "Format: " + ", ".join(ASS_STYLE_FIELDS), *(f"Style: {s}" for s in styles), ""],
        ["[Events]", "Format: " + ", ".join(ASS_EVENT_FIELDS), ""],
    )
    return "\n".join(line for section in sections for line in section)


def ass_documents(blocks: DataFrame, keys: Sequence[str], head: str | None = None) -> DataFrame:
    """Whole event files: head and dialogue lines."""
    opened = F.lit(ass_head() if head is None else head)
    return join_blocks(blocks, keys).withColumn("content", F.concat(opened, "content"))


def compress_srt(files: DataFrame) -> DataFrame:
    """One ``[start-end] text`` line per block with its timing among the first three lines."""
    blocks = files.select("path", F.posexplode(F.split(plain(F.col("content")), "\n\n")).alias("__pos", "__block"))
    lined = blocks.withColumn("__lines", F.filter(F.transform(F.split("__block", "\n"), strip), lambda x: x != ""))
    heads = F.transform(F.slice("__lines", 1, 3), lambda x: F.contains(x, F.lit("-->")))
    timed = lined.withColumn("__at", F.array_position(heads, True).cast("int")).where(F.col("__at") > 0)
    sides = F.split(F.element_at("__lines", F.col("__at")), "-->")
    joined = F.array_join(F.slice("__lines", F.col("__at") + 1, F.size("__lines")), " ")
    text = F.regexp_replace(strip(F.regexp_replace(joined, r"\s+", " ")), "<[^>]+>", "")
    return timed.select(
        "path", (F.col("__pos") + 1).cast("bigint").alias("block_no"), text.alias("__t"),
        F.concat(F.lit("["), strip(F.element_at(sides, 1)), F.lit("-"), strip(F.element_at(sides, 2)), F.lit("] "), text).alias("block"),
    ).where("__t <> ''").drop("__t")


def write_blocks(blocks: DataFrame, keys: Sequence[str], path: str) -> None:
    """Text files per key; range partitioning keeps a file's parts in order and splits long ones."""
    spread = blocks.repartitionByRange(*keys, "block_no").sortWithinPartitions(*keys, "block_no")
    spread.select(*keys, F.col("block").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def stage_documents(rows: DataFrame, keys: Sequence[str], order: Sequence[str], field: str) -> DataFrame:
    """One JSON document per project holding its rows in order; keys keep their column order."""
    order = list(order)
    body = [c for c in rows.columns if c not in keys]
    items = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("__o"), F.struct(*body).alias("__r"))))
    return rows.groupBy(*keys).agg(F.to_json(F.struct(F.transform(items, lambda i: i["__r"]).alias(field)), {"ignoreNullFields": "false"}).alias("content"))


def write_stage(documents: DataFrame, keys: Sequence[str], path: str) -> None:
    documents.select(*keys, F.col("content").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)
