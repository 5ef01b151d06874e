"""The shot breakdown: what is written on the way, and texts of clips in one time bucket, in several, and of repeated clips."""

from __future__ import annotations

import random

from recut.operators import breakdown as bd
from recut.operators import narration
from recut.operators.intervals import best_overlap
from recut.operators.narration import subtitle_text

P = ["project_id"]


def _subs(spark, rng, count=300):
    rows = [(n % 2, rng.randint(1, 60), s := rng.randint(0, 500_000), s + rng.randint(0, 3_000), rng.choice(["a", " b ", "", f"t{n}"])) for n in range(count)]
    return rows, spark.createDataFrame(rows, "project_id bigint, sub_no bigint, sub_start_ms bigint, sub_end_ms bigint, text string")


def _by_hand(ranges, subs):
    rows = []
    for p, item, s, e, texts in ranges:
        own = " ".join(t.strip() for t in texts if t.strip())
        met = sorted((n, a, b, t.strip()) for q, n, a, b, t in subs if q == p and t.strip() and s < b and a < e and e > s and b > a)
        rows.append((p, item, s, own or " ".join(m[3] for m in met)))
    return sorted(rows)


def test_texts_leave_their_bucket_joined(spark, monkeypatch):
    rng = random.Random(3)
    subs, table = _subs(spark, rng)
    schema = "project_id bigint, item_no bigint, start_ms bigint, end_ms bigint, texts array<string>"
    ranges = [(i % 2, i, s := rng.randint(0, 480_000), s + rng.choice([-5, 0, 800, 20_000, 150_000]), rng.choice([[], [" "], [f" x{i} ", "y"]])) for i in range(80)]
    written = []
    monkeypatch.setattr(narration, "cut_lineage", lambda df: written.append(df) or df)
    got = subtitle_text(spark.createDataFrame(ranges, schema), table, P, [*P, "item_no"], embedded="texts")
    assert sorted((r.project_id, r.item_no, r.start_ms, r.subtitle_text) for r in got.collect()) == _by_hand(ranges, subs)
    assert written and "subtitle" not in str(written[0].columns) and written[0].columns[-1] == "__found"  # texts, no lists of rows


def test_texts_of_repeated_ranges(spark):
    """All rows of a key share what any of them meets."""
    rng = random.Random(4)
    subs, table = _subs(spark, rng)
    ranges = [(0, 1, 10_000, 30_000, []), (0, 1, 200_000, 230_000, []), (0, 2, 5_000, 9_000, ["own"]), (0, 2, 5_000, 400_000, [])]
    got = subtitle_text(
        spark.createDataFrame(ranges, "project_id bigint, item_no bigint, start_ms bigint, end_ms bigint, texts array<string>"), table, P, [*P, "item_no"], embedded="texts"
    ).collect()
    both = [(n, a, b, t.strip()) for _, _, s, e, _ in ranges[:2] for q, n, a, b, t in subs if q == 0 and t.strip() and s < b and a < e and b > a]
    assert [r.subtitle_text for r in got if r.item_no == 1] == [" ".join(m[3] for m in sorted(both))] * 2
    assert "own" in [r.subtitle_text for r in got if r.item_no == 2]


def test_facts_of_the_best_range(spark):
    clips = spark.createDataFrame([(0, 7, 1, 0, 100), (0, 7, 2, 500, 600)], "project_id bigint, seg_no bigint, clip_no bigint, start_ms bigint, end_ms bigint")
    ranges = spark.createDataFrame(
        [(0, 7, 1, 0, 40, "one"), (0, 7, 2, 30, 100, "two"), (0, 7, 2, 30, 90, "again"), (0, 8, 1, 500, 600, "other")],
        "project_id bigint, seg_no bigint, range_pos bigint, range_start_ms bigint, range_end_ms bigint, said string",
    )
    rows = best_overlap(clips, ranges, [*P, "seg_no"], [*P, "clip_no"], facts=["said"]).collect()
    assert sorted((r.clip_no, r.range_pos, r.shared_ms, r.said) for r in rows if r.clip_no == 1) == [(1, 2, 70, "again"), (1, 2, 70, "two")]
    assert [(r.range_pos, r.shared_ms, r.said) for r in rows if r.clip_no == 2] == [(None, 0, None)]


def test_only_items_go_through_the_scan_of_a_project(spark, monkeypatch):
    """Clips of many items, placed over several slices of items, each length carried by one row an item."""
    items = spark.range(30).selectExpr(
        "id % 2 as project_id", "id as item_no", "id as seg_no", "'n' as narration", "'voiceover' as audio_mode", "0 as ost", "0L as tts_ms", "0L as ref_start_ms", "100L as ref_end_ms"
    )
    clips = spark.range(90).selectExpr(
        "id div 3 % 2 as project_id", "id div 3 as item_no", "id % 3 + 1 as clip_no", "id * 10 as start_ms", "id * 10 + 40 + id as end_ms", "true as keep_original_audio",
        "cast(null as bigint) as source_ref_shot", "'original' as allocation",
    )
    none = spark.createDataFrame([], "project_id bigint, seg_no bigint, range_pos bigint, range_start_ms bigint, range_end_ms bigint, audio_action string, audio_role string, texts array<string>")
    shots = spark.createDataFrame([], "project_id bigint, shot_no bigint, start_ms bigint, end_ms bigint")
    subs = spark.createDataFrame([], "project_id bigint, sub_no bigint, start_ms bigint, end_ms bigint, text string")
    scanned, scan = [], bd.scan
    monkeypatch.setattr(bd, "scan", lambda df, keys, *a, **k: scanned.append((list(keys), df.count())) or scan(df, keys, *a, **k))
    audio = items.select("project_id", "item_no").limit(0).selectExpr("*", "1L as audio_ms")
    rows = bd.shot_breakdown(items, clips, audio, none, shots, subs, subs, P, width=7).collect()
    assert [n for keys, n in scanned if keys == P] == [30]
    want = {}
    for p in (0, 1):
        at = 0
        for i in range(90):
            if i // 3 % 2 == p:
                want[i // 3, i % 3 + 1] = (at, at := at + 40 + i)
    assert {(r.item_no, r.clip_no): (r.timeline_start_ms, r.timeline_end_ms) for r in rows} == want


def test_script_follows_from_written_ranges(spark, tmp_path):
    """Ranges are numbered once; the units of a script are read from them."""
    from recut.queries import timeline as queries
    from recut.queries.registry import Tables

    spark.range(12).selectExpr(
        "id div 3 as l_orderkey", "id as l_partkey", "id % 4 as l_suppkey", "cast(id % 3 as int) as l_linenumber", "double(5) as l_quantity", "double(id) as l_extendedprice",
        "'N' as l_returnflag", "'O' as l_linestatus",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(4).selectExpr("id as o_orderkey", "'F' as o_orderstatus", "'1-URGENT' as o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    _, ranges, units = queries._written_script(Tables(spark, str(tmp_path)))
    assert all("Window" not in df._jdf.queryExecution().executedPlan().toString() for df in (ranges, units))
    assert ranges.count() == 12 and units.count() == 6
