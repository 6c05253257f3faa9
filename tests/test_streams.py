"""Streams cut into batches, restarted, and closed at the end of their input."""

import random
import statistics
import time
from datetime import datetime, timedelta

import pytest

from seguelake.session import scratch_path
from seguelake.streaming import feeds, state

SCHEMA = "event_id long, who long, ts timestamp_ntz, name string, person string"
START = datetime(2024, 5, 1)


def comments():
    draw = random.Random(8)
    rows, at = [], 0.0
    for i in range(150):
        at += draw.choice([1, 5, 20, 30, 50, 200]) * draw.random()
        rows.append((i, draw.randint(1, 2), START + timedelta(seconds=round(at, 3)), draw.choice(["ID", "", None, "Song A", "Song B"]), draw.choice([None, "ann", "bo", "cy"])))
    return rows


def merged(rows):
    """The grouping comment by comment."""
    out = []
    for who in sorted({r[1] for r in rows}):
        mine = sorted((r for r in rows if r[1] == who), key=lambda r: r[2])
        bursts = []
        for r in mine:
            if bursts and (r[2] - bursts[-1][-1][2]).total_seconds() <= 25:
                bursts[-1].append(r)
            else:
                bursts.append([r])
        kept = []
        for b in bursts:
            us = [round((r[2] - START) / timedelta(microseconds=1)) for r in b]
            middle = int(statistics.median(us))
            people = len({r[4] for r in b if r[4]}) or len(b)
            label = next((r[3] for r in b if r[3] and r[3] != "ID"), None)
            if kept and middle - kept[-1][2] < 45_000_000:
                k = kept[-1]
                kept[-1] = (who, k[1], k[2], k[3] + len(b), k[4] + people, k[5] or label)
            else:
                kept.append((who, us[0], middle, len(b), people, label))
        out += kept
    return sorted(out, key=str)


def steps(rows, limit):
    out = {}
    for who in {r[1] for r in rows}:
        names = [r[3] for r in sorted((r for r in rows if r[1] == who), key=lambda r: (r[2], r[0])) if r[3] is not None]
        edges = [(a, b) for a, b in zip(names, names[1:]) if a != b]
        out[str(who)] = (edges[::-1][:limit], sorted((n, names.count(n)) for n in set(names)))
    return out


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/talk.parquet")
    time.sleep(1.1)  # the file source goes by modification time


def bursts_of(spark, folder, end=True, **places):
    stream = feeds.replay(spark, folder, "talk", "ts", files_per_batch=1)
    feed = feeds.with_end(stream, "ts") if "marks" not in places else feeds.Feed(stream.unionByName(spark.readStream.schema(stream.schema).parquet(places["marks"])), places.pop("marks"))
    job = state.merged_bursts(feed.stream, "who", "ts", "person", "name", "event_id", delay="5 seconds")
    closing = (lambda: feeds.write_end(spark, stream.schema, feed.marks, "ts")) if end else None
    rows = feeds.drain(job, "append", end=closing, keyed=True, **places).collect()
    origin = round((START - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    return sorted(((int(r.key), r.start - origin, r.middle - origin, r.votes, r.people, r.label) for r in rows), key=str), feed


@pytest.mark.parametrize("cuts", [[], [50, 100]])
def test_bursts_do_not_depend_on_batches(spark, tmp_path, cuts):
    rows = comments()
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        write(spark, tmp_path, rows[a:b])
    assert bursts_of(spark, str(tmp_path))[0] == merged(rows)


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    rows = comments()
    write(spark, tmp_path, rows[:90])
    places = {"checkpoint": scratch_path(spark, "t"), "out": scratch_path(spark, "t")}
    before, feed = bursts_of(spark, str(tmp_path), end=False, **places)
    assert 0 < len(before) < len(merged(rows))
    write(spark, tmp_path, rows[90:])
    assert bursts_of(spark, str(tmp_path), marks=feed.marks, **places)[0] == merged(rows)


def test_recent_edges(spark, tmp_path):
    rows = comments()
    for a, b in ((0, 60), (60, 150)):
        write(spark, tmp_path, rows[a:b])
    stream = feeds.replay(spark, str(tmp_path), "talk", "ts", files_per_batch=1)
    feed = feeds.with_end(stream, "ts")
    job = state.recent_edges(feed.stream, "who", "ts", "name", "event_id", 4, "5 seconds")
    got = feeds.drain(job, "update", ["key"], lambda: feeds.write_end(spark, stream.schema, feed.marks, "ts"), keyed=True).collect()
    assert {r.key: ([tuple(e) for e in r.edges], [tuple(p) for p in r.plays]) for r in got} == steps(rows, 4)
