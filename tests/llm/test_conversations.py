import pytest

from lorebase.llm import conversations as C

SCHEMA = "event_id long, session_id string, type string, role string, timestamp string, content string, channel string, at string, pos int"


def events(spark, rows):
    """(event_id, session, type, timestamp, content) with clashing extra columns."""
    return spark.createDataFrame([(e, s, t, None, ts, c, "clash", "clash", -1) for e, s, t, ts, c in rows], SCHEMA)


def kept(spark, rows):
    return sorted((r["channel"], r["pos"], r["event_id"]) for r in C.rebuild(events(spark, rows)).collect())


def test_order_offsets_and_equal_instants(spark):
    rows = [(3, "s", "assistant", "2026-01-01T02:00:01+02:00", "b"), (1, "s", "USER", "2026-01-01 00:00:00", "a"), (5, "s", "user", "1767225602000", "c"), (9, "s", "Assistant", "2026-01-01T00:00:03Z", "d"), (7, "s", "assistant", "2026-01-01T00:00:03Z", "e")]
    assert kept(spark, rows) == [("s", 1, 1), ("s", 2, 3), ("s", 3, 5), ("s", 4, 7), ("s", 5, 9)]


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "s", "user", "2026-01-01T00:00:00Z", "a")],
        [(1, "s", "assistant", "2026-01-01T00:00:00Z", "a"), (2, "s", "user", "2026-01-01T00:00:01Z", "b"), (3, "s", "assistant", "2026-01-01T00:00:02Z", "c")],
        [(1, "s", "user", "2026-01-01T00:00:00Z", "a"), (2, "s", "user", "2026-01-01T00:00:01Z", "b"), (3, "s", "assistant", "2026-01-01T00:00:02Z", "c")],
        [(1, "s", "user", "2026-13-01T00:00:00Z", "a"), (2, "s", "assistant", "2026-01-01T00:00:01Z", "b")],
        [(1, "s", "user", None, "a"), (2, "s", "assistant", "2026-01-01T00:00:01Z", "b")],
        [(1, "s", "user", "2026-01-01T00:00:00Z", "a"), (2, "s", "assistant", "2026-01-01T00:00:01Z", "b"), (3, "s", "assistant", "2026-01-01T00:00:02Z", '[{"type": "te')],
        [(1, "s", "user", "2026-01-01T00:00:00Z", None), (2, "s", "assistant", "2026-01-01T00:00:01Z", "  ")],
        [(1, None, "user", "2026-01-01T00:00:00Z", "a"), (2, None, "assistant", "2026-01-01T00:00:01Z", "b")],
        [(None, "s", "user", "2026-01-01T00:00:00Z", "a"), (None, "s", "assistant", "2026-01-01T00:00:01Z", "b")],
        [],
    ],
)
def test_dropped(spark, rows):
    assert kept(spark, rows) == []


def test_visible_text_and_repeated_deliveries(spark):
    ok = '[{"type": "tool_use", "name": "x"}, {"type": "text", "text": "hi"}]'
    rows = [(1, "s", "user", "2026-01-01T00:00:00Z", "q"), (1, "s", "user", "2026-01-01T00:00:00Z", "q"), (8, "s", "user", "2026-01-01T00:00:00Z", "q"), (2, "s", "assistant", "2026-01-01T00:00:01Z", ok), (3, "s", "user", "2026-01-01T00:00:02Z", "<ctx>cwd</ctx>"), (4, "s", "user", "2026-01-01T00:00:03Z", '[{"type": "tool_result", "content": "x"}]'), (5, "s", "system", "nonsense", "z"), (6, "s", "user", "2026-01-01T00:00:04Z", "<b>x</b> and <b>y</b>"), (7, "s", "assistant", "2026-01-01T00:00:05Z", "z")]
    assert kept(spark, rows) == [("s", 1, 1), ("s", 2, 2), ("s", 3, 6), ("s", 4, 7)]


def test_one_session_holds_most_rows(spark):
    rows = [(i, "hot", "user" if i % 2 == 0 else "assistant", str(1767225600000 + i // 3 * 1000), f"m{i}") for i in range(3000)]
    rows += [(10_000 + i, f"s{i // 2}", "user" if i % 2 == 0 else "assistant", "2026-01-01T00:00:00Z", "x") for i in range(100)]
    got = kept(spark, rows)
    assert [(p, e) for s, p, e in got if s == "hot"] == [(i + 1, i) for i in range(3000)] and len(got) == 3100


def test_split_at_silence(spark):
    rows = [(i, "s", "user" if i % 2 == 0 else "assistant", str(1767225600000 + i * 1000 + (i // 40) * 864_000_000), f"m{i}") for i in range(200)]
    got = C.rebuild(events(spark, rows), split=True).collect()
    assert {r["segment"] for r in got} == {0, 1, 2, 3, 4} and all(r["pos"] == r["event_id"] % 40 + 1 for r in got)


def talk(channel, first_event, start_ms, turns, pause_s=20):
    return [(first_event + i, channel, "user" if i % 2 == 0 else "assistant", str(start_ms + (i * pause_s + i % 7) * 1000), f"m{first_event + i}") for i in range(turns)]


def test_gap_lies_in_the_valley(spark):
    rows, event = [], 0
    for s in range(30):
        for part in range(3):  # pauses of two to three hours between the parts of a session
            rows += talk(f"s{s}", event, 1767225600000 + s * 1000 + part * (9_000_000 + s * 60_000), 12)
            event += 12
    ordered = C.ordered_fragments(C.parsed_events(events(spark, rows), C.F.col("session_id")), ["channel"], ["at", "event_id"])
    gap = C.calibrated_gap(ordered)
    assert 1800 <= gap < 8000
    got = C.rebuild(events(spark, rows), split=True).collect()
    assert len(got) == len(rows) and {(r["channel"], r["segment"]) for r in got} == {(f"s{s}", p) for s in range(30) for p in range(3)}
    assert all(r["pos"] == r["event_id"] % 12 + 1 for r in got)


def test_no_pauses_no_cut(spark):
    rows = [r for s in range(5) for r in talk(f"s{s}", 100 * s, 1767225600000, 40, pause_s=600)]
    assert {r["segment"] for r in C.rebuild(events(spark, rows), split=True).collect()} == {0}
    assert C.valley({}, 43) is None and C.valley({10: 100, 12: 90, 60: 8}, 43) is not None and C.valley({10: 100, 12: 90}, 43) is None


def test_a_cut_only_drops_its_own_part(spark):
    rows = talk("s", 0, 1767225600000, 10) + talk("s", 100, 1767325600000, 11) + talk("s", 200, 1767425600000, 10)
    assert {r["segment"] for r in C.rebuild(events(spark, rows), split=True).collect()} == {0, 2}
    rows.append((999, "s", "user", "no time", "x"))
    assert C.rebuild(events(spark, rows), split=True).count() == 0


def test_split_channel_that_holds_most_rows(spark):
    rows = [r for d in range(20) for r in talk("hot", d * 200, 1767225600000 + d * 86_400_000, 150)] + talk("other", 90_000, 1767225600000, 10)
    got = C.rebuild(events(spark, rows), split=True).collect()
    assert len(got) == 3010 and all((r["segment"], r["pos"]) == (r["event_id"] // 200, r["event_id"] % 200 + 1) for r in got if r["channel"] == "hot")


def test_rows_without_session_go_by_folder(spark):
    rows = spark.createDataFrame([(i, None if i > 1 else "s", "user" if i % 2 == 0 else "assistant", None, str(1767225600000 + i * 1000), "x", cwd) for i, cwd in enumerate(["/a", None, "/a", "/a", None, None])] + [(2, None, "user", None, "1767225602000", "x", None)], "event_id long, session_id string, type string, role string, timestamp string, content string, cwd string")
    got = sorted((r["channel"], r["event_id"]) for r in C.rebuild(rows, C.participants(), split=True).collect())
    assert got == [("folder /a", 2), ("folder /a", 3), ("session s", 0), ("session s", 1)]
