"""What the plans must look like at scale, whatever the rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from netsight.ml import evaluate, split
from netsight.operators import alerts as A
from netsight.operators import detect, hosts, rollup, throttle, timeline
from netsight.operators import packets as P
from netsight.plans import driver_tables as T
from netsight.plans import registry

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2024, 1, 30)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filter_and_columns_reach_the_scan(spark):
    text = plan(A.alerts_by_hour(T.alerts(spark, SF), as_of=AS_OF))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(ts,2024-01-29T00:00\)", text)
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text


@pytest.mark.parametrize("op", [A.top_sources, A.heaviest_floods, A.top_attack_pairs, A.recent_alerts])
def test_top_k_is_not_a_full_sort(spark, op):
    text = plan(op(T.alerts(spark, SF)))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_longest_packets_is_top_k(spark):
    assert "TakeOrderedAndProject" in plan(P.longest_packets(T.packets(spark, SF), as_of=AS_OF))


# A window or sort of all rows in one task would show as an exchange to a single partition.
@pytest.mark.parametrize("op", [A.rolling_type_count, A.scan_bursts, A.avg_alert_gap, A.alerts_per_minute])
def test_no_single_partition_over_alerts(spark, op):
    assert "SinglePartition" not in plan(op(T.alerts(spark, SF)))


def test_quiet_periods_order_only_span_summaries_in_one_task(spark):
    text = plan(A.quiet_periods(T.alerts(spark, SF)))
    single = text.split("Exchange SinglePartition")
    assert len(single) == 2 and "max_by" in single[1].splitlines()[1]


def test_hosts_are_never_one_window_partition(spark):
    stats = T.host_stats(spark, SF)
    for df in (hosts.rolling_packets(stats, as_of=AS_OF), hosts.new_source_spike(stats, as_of=AS_OF)):
        windows = re.findall(r"Window \[(?:sum|lag)[^\n]*?windowspecdefinition\(([^)]*)\)", plan(df))
        assert windows and all("_s" in w for w in windows)  # by _slot or _span as well as by host


def test_rolling_reads_its_input_once(spark):
    df = timeline.rolling_total(T.alerts(spark, SF), "ts", 600, F.lit(1))
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_rollup_combines_before_every_shuffle(spark):
    text = plan(rollup.host_stats(T.packets(spark, SF)))
    assert "Expand" not in text and text.count("partial_sum") >= 2 and "Python" not in text


def test_rollup_reads_its_packets_once(spark):
    df = rollup.host_stats(T.packets(spark, SF))
    df.collect()
    assert plan(df).split("== Initial Plan ==")[0].count("FileScan") == 1


def test_throttle_runs_in_the_jvm(spark):
    for keys in (throttle.SINGLE_KEY, ("alert_type", "src_ip")):
        text = plan(throttle.throttle(T.alerts(spark, SF), keys=keys))
        assert "Python" not in text and "Pandas" not in text


def test_flood_ranking_joins_on_the_salt(spark):
    text = plan(detect.syn_flood_alerts(T.packets(spark, SF)))
    joins = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin) \[([^]]*)\]", text)
    assert joins and all("_salt" in j for j in joins)


def test_no_cross_joins(spark):
    scores = T.class_scores(spark, SF)
    for df in (
        evaluate.confusion_matrix(scores), evaluate.roc_curve(scores), evaluate.auc(scores),
        *split.stratified_split(T.labelled_urls(spark, SF)),
        throttle.throttle(T.alerts(spark, SF), keys=throttle.SINGLE_KEY),
        detect.on_blocklist(T.packets(spark, SF), T.blocklist(spark, SF)),
    ):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(df))


def test_small_floods_are_not_spread_over_all_salts(spark):
    # One explode makes the copies of equal alerts; a list of all salts would be another.
    assert plan(detect.syn_flood_alerts(T.packets(spark, SF))).split("== Physical Plan ==")[-1].count("Generate explode") == 1


def test_the_sorted_csv_file_is_filtered_before_one_task_gets_it(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(registry.exports, "write_csv", lambda df, path: made.update({path.rsplit("/", 1)[1]: df}))
    registry._csv_folder(spark, SF)
    assert "Coalesce" not in plan(made["bad"]) and made["bad"].rdd.getNumPartitions() == 1
