from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rankweave.operators import quota
from rankweave.plans import fixtures as fx
from rankweave.plans import queries as Q
from rankweave.plans.search import web_search
from rankweave.streaming import counters, epochs, requests, rotation

SF001 = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp, event_type string"
START = datetime(2024, 5, 1, 23, 57, tzinfo=timezone.utc)


def calls(rows):
    """(event_id, seconds after START, key) as rows of the log."""
    return [(i, START + timedelta(seconds=s), k) for i, s, k in rows]


class Log:
    """A folder of parquet files, a file for each batch."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)

    def add(self, rows):
        self.spark.createDataFrame(calls(rows), SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return counters.call_stream(self.spark, self.path, "*.parquet", SCHEMA)


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path / "log")


def reports(spark, log, tmp_path):
    counters.run_reports(counters.interval_reports(log.stream()), str(tmp_path / "t"), str(tmp_path / "c"))
    found = counters.interval_report(spark, str(tmp_path / "t"))
    return sorted((r["interval_start"][8:16], r["key"], r["n"], r["day_total"]) for r in found.collect())


def test_idle_keys_report_every_interval_and_totals_restart_at_midnight(spark, log, tmp_path):
    log.add([(1, 0, "a"), (2, 10, "a"), (3, 70, "b"), (4, 200, "a"), (5, 420, "b")])
    # the watermark is 420 - 60 s: six intervals are over; b is known from the second on
    assert reports(spark, log, tmp_path) == [
        ("01 23:57", "a", 2, 2), ("01 23:58", "a", 0, 2), ("01 23:58", "b", 1, 1), ("01 23:59", "a", 0, 2), ("01 23:59", "b", 0, 1),
        ("02 00:00", "a", 1, 1), ("02 00:00", "b", 0, 0), ("02 00:01", "a", 0, 1), ("02 00:01", "b", 0, 0),
        ("02 00:02", "a", 0, 1), ("02 00:02", "b", 0, 0)]


def test_reports_go_on_after_a_restart_and_late_calls_are_dropped(spark, log, tmp_path):
    log.add([(1, 0, "a"), (2, 130, "a")])
    first = reports(spark, log, tmp_path)
    assert first == [("01 23:57", "a", 1, 1)]
    log.add([(3, 5, "a"), (4, 140, "a"), (5, 300, "b")])  # 3 comes after its interval was reported
    assert reports(spark, log, tmp_path) == first + [
        ("01 23:58", "a", 0, 1), ("01 23:59", "a", 2, 3), ("02 00:00", "a", 0, 0)]


def counted(spark, tmp_path):
    rows = counters.counts_table(spark, str(tmp_path / "t")).collect()
    return {(r["key"], r["start"].strftime("%d")): r["n"] for r in rows}


def run_counts(log, tmp_path):
    counters.run_to_table(counters.daily_counts(log.stream(), "60 days"), str(tmp_path / "t"), str(tmp_path / "c"))


def test_counters_go_on_after_a_restart_and_compaction(spark, log, tmp_path):
    log.add([(1, 0, "a"), (2, 10, "b"), (3, 400, "a")])
    run_counts(log, tmp_path)
    assert counted(spark, tmp_path) == {("a", "01"): 1, ("b", "01"): 1, ("a", "02"): 1}
    counters.compact_counts(spark, str(tmp_path / "t"))
    log.add([(4, 20, "a"), (5, 500, "c")])
    run_counts(log, tmp_path)
    want = {("a", "01"): 2, ("b", "01"): 1, ("a", "02"): 1, ("c", "02"): 1}
    assert counted(spark, tmp_path) == want
    counters.compact_counts(spark, str(tmp_path / "t"))
    counters.compact_counts(spark, str(tmp_path / "t"))
    assert counted(spark, tmp_path) == want
    assert epochs.compacted_upto(spark, str(tmp_path / "t")) >= 1


def test_a_run_killed_after_its_write_loses_nothing(spark, log, tmp_path, monkeypatch):
    log.add([(1, 0, "a"), (2, 10, "b")])
    run_counts(log, tmp_path)
    log.add([(3, 20, "a")])
    whole = epochs.write_epoch

    def killed(rows, table, epoch):
        whole(rows, table, epoch)
        raise RuntimeError("killed between write and commit")

    monkeypatch.setattr(epochs, "write_epoch", killed)
    with pytest.raises(Exception, match="killed"):
        run_counts(log, tmp_path)
    # the keys of the day that were not in the batch are still there
    assert counted(spark, tmp_path) == {("a", "01"): 2, ("b", "01"): 1}
    monkeypatch.setattr(epochs, "write_epoch", whole)
    log.add([(4, 30, "b")])
    run_counts(log, tmp_path)
    assert counted(spark, tmp_path) == {("a", "01"): 2, ("b", "01"): 2}


def test_a_compaction_without_its_mark_does_not_count(spark, log, tmp_path, monkeypatch):
    log.add([(1, 0, "a")])
    run_counts(log, tmp_path)
    table = str(tmp_path / "t")
    (tmp_path / "t" / "compacted" / "upto=0").mkdir(parents=True)  # killed while writing: half a folder, no mark
    assert counted(spark, tmp_path) == {("a", "01"): 1}
    counters.compact_counts(spark, table)
    assert counted(spark, tmp_path) == {("a", "01"): 1} and epochs.compacted_upto(spark, table) == 0


def test_table_never_written_is_empty(spark, tmp_path):
    assert counters.counts_table(spark, str(tmp_path / "none")).collect() == []


KEYS = [("k1", 0, 4, 0.5), ("k2", 1, 1, 1.0)]  # two calls, then one, then none


def rotated(spark, log, tmp_path):
    keys = spark.createDataFrame(KEYS, "key_name string, idx long, daily_limit long, threshold double")
    rotation.run_rotation(log.stream(), keys, str(tmp_path / "t"), str(tmp_path / "c"))
    found = rotation.rotation_table(spark, str(tmp_path / "t"))
    return keys, sorted((r["event_id"], r["day"], r["n"], r["key_name"]) for r in found.collect())


def batch(spark, rows, keys):
    df = spark.createDataFrame(calls(rows), SCHEMA).select("event_id", "ts")
    out = quota.quota_assign(df, keys)
    return sorted((r["event_id"], r["day"], r["n"], r["key_name"]) for r in out.collect())


def test_rotation_on_the_live_log_equals_the_batch_over_a_restart(spark, log, tmp_path):
    one = [(9, 40, "a"), (3, 0, "a"), (4, 1, "b"), (7, 40, "b"), (5, 130, "a"), (6, 299, "a")]
    two = [(20, 245, "a"), (21, 250, "c"), (22, 250, "a"), (23, 170, "a"), (24, 500, "a")]
    log.add(one)
    keys, first = rotated(spark, log, tmp_path)
    final = lambda rows, end: [r for r in rows if (r[1] // 60 + 1) * 60 <= end - 60]
    assert first == batch(spark, final(one, 299), keys) and len(first) == 5
    log.add(two)
    _, second = rotated(spark, log, tmp_path)
    # 23 came after its minute was let go
    kept = [r for r in one + two if r[0] != 23]
    assert second == batch(spark, final(kept, 500), keys)
    assert {r[3] for r in second} == {"k1", "k2", quota.QUOTA_EXCEEDED}
    assert rotated(spark, log, tmp_path)[1] == second


def test_rotation_holds_calls_in_windows_and_passes_over_those_without_time(spark, log, tmp_path):
    calls_of = lambda rows: [(i, None if s is None else START + timedelta(seconds=s), k) for i, s, k in rows]

    def add(rows):
        spark.createDataFrame(calls_of(rows), SCHEMA).coalesce(1).write.mode("append").parquet(log.path)

    add([(None, 3, "a"), (8, None, "a"), (2**60 + 1, 3, "a"), (5, 3, "b"), (5, 3, "b"), (6, 70, "a"), (7, 150, "a")])
    first = rows_of_rotation(spark, log, tmp_path)
    # the watermark is 150 - 60 s: the first minute is over; equal ids stay apart, a null id comes first
    assert [(r[0], r[2]) for r in first] == [(None, 1), (5, 2), (5, 3), (2**60 + 1, 4)]
    add([(9, 80, "a"), (10, 100, "a"), (11, 300, "a")])  # 9 is later than the watermark, though its minute is held
    assert [r[0] for r in rows_of_rotation(spark, log, tmp_path)[4:]] == [6, 10, 7]


def rows_of_rotation(spark, log, tmp_path):
    keys = spark.createDataFrame(KEYS, "key_name string, idx long, daily_limit long, threshold double")
    rotation.run_rotation(log.stream(), keys, str(tmp_path / "t"), str(tmp_path / "c"))
    found = rotation.rotation_table(spark, str(tmp_path / "t")).collect()
    return sorted(((r["event_id"], r["ts"], r["n"]) for r in found), key=lambda r: (r[1], r[2]))


def test_search_over_a_stream_of_requests_equals_the_batch(spark, tmp_path):
    asked = fx.requests_fx(spark, SF001).select("query_id", "query", "engines")
    folder = str(tmp_path / "requests")
    half = asked.agg(F.percentile_approx("query_id", 0.5)).first()[0]
    static = (fx.sources_fx(spark), fx.candidates_fx(spark, SF001), Q.pages_df(spark, SF001))
    options = {"max_results": 3, "keywords": fx.EXCLUDED_KEYWORDS, "outcomes": fx.outcomes_fx(spark, SF001)}

    def run():
        stream = requests.request_stream(spark, folder, "*.parquet", "query_id long, query string, engines string")
        requests.run_searches(stream, *static, str(tmp_path / "t"), str(tmp_path / "c"), **options)

    asked.where(F.col("query_id") <= half).coalesce(1).write.mode("append").parquet(folder)
    run()
    first = requests.answered_sections(spark, str(tmp_path / "t")).select("query_id").distinct().count()
    asked.where(F.col("query_id") > half).coalesce(1).write.mode("append").parquet(folder)
    run()
    want = web_search(asked, *static, **options)
    columns = ["query_id", "engine", "sec_pos", "rank", "doc_id", "url", "content"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(requests.answered_rows(spark, str(tmp_path / "t"))) == rows(want.rows)
    sections = ["query_id", "engine", "sec_pos", "status", "n_rows"]
    assert (sorted(map(str, requests.answered_sections(spark, str(tmp_path / "t")).select(*sections).collect()))
            == sorted(map(str, want.sections.select(*sections).collect())))
    assert 0 < first < asked.count()
