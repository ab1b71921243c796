from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.operators import delivery

LOG = "line_no long, query_id string, ts long, stream string, block int"


def keyed(spark, lines):
    return delivery.keyed_lines(spark.createDataFrame(lines, LOG), "log", ts_col="ts")


def brute(lines):
    first, dropped = {}, set()
    for line, name, ts, *_ in sorted(lines, key=lambda x: x[0]):
        if name is None or ts is None:
            continue
        key = name.strip().lower(), ts // 1000
        if key in first and first[key] != line:
            dropped.add(line)
        first.setdefault(key, line)
    return dropped


def found(spark, lines, epochs=2):
    return {r.line_no for r in delivery.repeated_lines(keyed(spark, lines), epochs).collect()}


def test_copies_differ_in_case_and_space_but_not_in_second(spark):
    lines = [
        (1, "p:q1", 1000, "x", 1), (2, " P:Q1\t", 1999, "x", 1), (3, "p:q1", 2000, "x", 1), (4, None, 1000, None, None), (5, None, 1000, None, None),
        (6, "odd id", 5, "x", 1), (7, "ODD ID", 6, "x", 1), (8, "p:q01", 1000, "x", 1), (9, "p:q7", None, "x", 1), (10, "p:q7", None, "x", 1), (11, "", 1, "x", 1), (12, "  ", 2, "x", 1),
        (6, "odd id", 5, "x", 1),
    ]
    assert found(spark, lines) == {2, 7, 12} == brute(lines)


def test_no_lines(spark):
    lines = keyed(spark, [])
    new, seen = delivery.accept(lines, delivery.nothing_seen(spark))
    assert new.count() == seen.ranges.count() == seen.log.count() == delivery.repeated_lines(lines).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a:q1", "a:q2", "A:Q2", "b:q4096", "b:q4095", "x", " x", None]), st.integers(-1500, 3500)), max_size=25))
def test_equals_brute_force(spark, lines):
    rows = [(k, name, ts, "s", 0) for k, (name, ts) in enumerate(lines)]
    assert found(spark, rows) == brute(rows)


def take(df):
    return {tuple(r) for r in df.collect()}


def test_batches_accept_what_one_batch_accepts(spark):
    rng = random.Random(5)
    lines = [(k, f"{rng.choice('ab')}:q{rng.randint(4090, 4110)}" if rng.random() < 0.8 else rng.choice(["m", "n"]), rng.choice([1000, 1500, 9000]), "s", 0) for k in range(120)]
    whole, several = delivery.folded(keyed(spark, lines), 1), delivery.folded(keyed(spark, lines), 4)
    assert take(whole.log) == take(several.log) and take(whole.ranges) == take(several.ranges)
    assert {r.line_no for r in several.log.collect()} == {k for k in range(120)} - brute(lines)


def test_the_ranges_alone_decide_on_uncovered_numbers(spark):
    """A number outside of the ranges is accepted although the log has its key; one inside is looked up."""
    ranges = spark.createDataFrame([("log", "p", 0, 1, 5)], delivery.RANGES)
    log = spark.createDataFrame([("log", "p:q3", 1000, 1), ("log", "p:q7", 1000, 2), ("log", "odd", 1000, 3)], delivery.LOG)
    lines = keyed(spark, [(10, "p:q3", 1000, "x", 1), (11, "p:q3", 9000, "x", 1), (12, "p:q7", 1000, "x", 1), (13, "odd", 1000, "x", 1), (14, "p:q6", 1000, "x", 1)])
    new, seen = delivery.accept(lines, delivery.Seen(ranges, log))
    assert {r.line_no for r in new.collect()} == {11, 12, 14}
    assert {(r.lo, r.hi) for r in seen.ranges.collect()} == {(1, 7)}
    blind, _ = delivery.accept(lines, delivery.Seen(ranges.limit(0), log))  # without its ranges the same batch takes what was seen
    assert {r.line_no for r in blind.collect()} == {10, 11, 12, 14}


def test_ranges_are_disjoint_and_merged(spark):
    lines = [(k, f"p:q{n}", 1, "s", 0) for k, n in enumerate([1, 2, 3, 7, 8, 3, 5000])]
    assert sorted((r.lo, r.hi) for r in delivery.folded(keyed(spark, lines)).ranges.collect()) == [(1, 3), (7, 8), (5000, 5000)]
