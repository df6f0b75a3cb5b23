"""Keyed state of listings and alert rounds, batch by batch."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

import pytest

from tallymart.streaming import changes

ADS = "listing_url string, price double, at timestamp"
PROBES = "listing_url string, status_code int, final_url string, error string, at timestamp"
ALERTS = "category string, run string, listing_id string, score double, run_at timestamp"
T0 = datetime(2026, 1, 1)


class Feed:
    """Files that a stream reads one a batch, in the order in which they are put there."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        folder.mkdir(parents=True)

    def put(self, *rows):
        self.n += 1
        names = [part.strip().split()[0] for part in self.schema.split(",")]
        text = "\n".join(json.dumps({k: v.isoformat(sep=" ") if isinstance(v, datetime) else v for k, v in zip(names, row, strict=True)}) for row in rows)
        path = self.folder / f"{self.n:05d}.json"
        path.write_text(text)
        os.utime(path, (1_700_000_000 + self.n,) * 2)  # the order in which a stream takes files

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder))


def drain(frame, tmp_path, schema):
    query = changes.run_to_files(frame, f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination()
    return query, frame.sparkSession.read.schema(schema).parquet(f"{tmp_path}/out").collect()


def test_new_cheaper_and_gone_once(spark, tmp_path):
    ads, probes = Feed(spark, tmp_path / "ads", ADS), Feed(spark, tmp_path / "probes", PROBES)
    day = lambda n: T0 + timedelta(days=n)
    ads.put(("m/a-1.htm", 100.0, day(0)), ("m/a-2.htm", 50.0, day(0)), ("m/a-1.htm", 90.0, day(0)), (None, 1.0, day(0)), ("m/a-3.htm", None, day(0)))
    probes.put(("m/a-9.htm", 404, None, None, day(0)))
    frame = lambda: changes.listing_changes(ads.stream(), probes.stream())
    _, rows = drain(frame(), tmp_path, changes.CHANGES)
    key = lambda r: (r.listing_url[-5:-4], r.change, r.old_price, r.new_price, r.days)
    first = [("1", "drop", 100.0, 90.0, None), ("1", "new", None, 100.0, None), ("2", "new", None, 50.0, None)]
    assert sorted(map(key, rows), key=str) == first
    ads.put(("m/a-1.htm", 95.0, day(1)), ("m/a-2.htm", 40.0, day(1)))
    probes.put(("m/a-1.htm", 500, None, None, day(2)), ("m/a-2.htm", 200, "m/b-7.htm", None, day(2)), ("m/a-1.htm", 404, None, "timeout", day(2)))
    ads.put(("m/a-2.htm", 30.0, day(3)), ("m/a-1.htm", 80.0, day(3)))
    probes.put(("m/a-1.htm", 410, None, None, day(4)), ("m/a-1.htm", 404, None, None, day(5)))
    _, rows = drain(frame(), tmp_path, changes.CHANGES)
    got = sorted(map(key, rows), key=str)
    assert [r for r in got if r[0] == "1"] == [("1", "drop", 100.0, 90.0, None), ("1", "drop", 90.0, 80.0, None), ("1", "new", None, 100.0, None), ("1", "sold", 80.0, None, 4.0)]
    assert [r[1] for r in got if r[0] == "2"] == ["drop", "drop", "new", "sold"]
    assert next(r for r in rows if r.change == "drop" and r.new_price == 90.0).drop_pct == pytest.approx(10.0)


def test_a_batch_touches_its_own_listings_alone(spark, tmp_path):
    """State grows with listings, what a batch updates does not."""
    ads = Feed(spark, tmp_path / "ads", ADS)
    for n in range(12):
        ads.put(*[(f"m/a-{n * 10 + k}.htm", 100.0, T0 + timedelta(hours=n)) for k in range(10)], ("m/a-0.htm", 99.0 - n, T0 + timedelta(hours=n, minutes=1)))
    query, rows = drain(changes.listing_changes(ads.stream()), tmp_path, changes.CHANGES)
    states = [p["stateOperators"][0] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, query.recentProgress) if p["stateOperators"] and p["numInputRows"]]
    assert len(states) == 12 and max(s["numRowsUpdated"] for s in states) <= 11
    assert sum(r.change == "new" for r in rows) == 120 and sum(r.change == "drop" for r in rows) == 12


def test_listings_share_calls_and_state_by_buckets(spark, tmp_path):
    """Hundreds of listings in four buckets: a batch updates four state rows, and each listing keeps its own price and age."""
    ads, probes = Feed(spark, tmp_path / "ads", ADS), Feed(spark, tmp_path / "probes", PROBES)
    url, want = "m/a-{}.htm".format, []
    for n in range(3):
        ads.put(*[(url(k), 100.0 - n * (k % 3), T0 + timedelta(days=n)) for k in range(n, 300)])
    probes.put(*[(url(k), 404 if k % 2 else 200, None, None, T0 + timedelta(days=9)) for k in range(400)])
    for k in range(300):
        want.append((url(k), "new", None, 100.0, None))
        want += [(url(k), "drop", 100.0 - (n - 1) * (k % 3), 100.0 - n * (k % 3), None) for n in (1, 2) if k % 3 and k >= n]
    ads_only, rows = drain(changes.listing_changes(ads.stream(), buckets=4), tmp_path / "ads_only", changes.CHANGES)
    tell = lambda rows: sorted(((r.listing_url, r.change, r.old_price, r.new_price, r.days) for r in rows), key=str)
    assert tell(rows) == sorted(want, key=str)
    states = [p["stateOperators"][0] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, ads_only.recentProgress) if p["stateOperators"] and p["numInputRows"]]
    assert len(states) == 3 and all(s["numRowsUpdated"] <= 4 and s["numRowsTotal"] <= 4 for s in states)
    _, rows = drain(changes.listing_changes(ads.stream(), probes.stream(), buckets=4), tmp_path / "both", changes.CHANGES)
    assert sorted(r.listing_url for r in rows if r.change == "new") == sorted(map(url, range(300)))
    assert sorted((r.listing_url, r.days) for r in rows if r.change == "sold") == sorted((url(k), 9.0) for k in range(1, 300, 2))


def test_one_round_of_alerts_a_run(spark, tmp_path):
    feed = Feed(spark, tmp_path / "alerts", ALERTS)
    at = lambda m: T0 + timedelta(minutes=m)
    feed.put(("tech", "r1", "a", 60.0, at(0)), ("tech", "r1", "b", 70.0, at(0)), ("auto", "r1", "c", 55.0, at(0)))
    feed.put(("tech", "r1", "a", 65.0, at(0.5)), ("tech", "r1", "d", 70.0, at(0.5)))
    frame = lambda: changes.alert_rounds(feed.stream(), delay_seconds=60, top=2)
    _, rows = drain(frame(), tmp_path, changes.ALERTS)
    assert rows == []  # the run is still open
    feed.put(("tech", "r2", "a", 80.0, at(10)))
    feed.put(("tech", "r1", "late", 99.0, at(0.5)), ("tech", "r2", "b", 60.0, at(10)))
    feed.put(("tech", "r3", "z", 1.0, at(30)))
    feed.put(("tech", "r3", "z", 1.0, at(30)))
    _, rows = drain(frame(), tmp_path, changes.ALERTS)
    got = sorted((r.category, r.run, r.nth, r.listing_id, r.score, r.alerts) for r in rows)
    assert got == [("auto", "r1", 1, "c", 55.0, 1), ("tech", "r1", 1, "b", 70.0, 3), ("tech", "r1", 2, "d", 70.0, 3), ("tech", "r2", 1, "a", 80.0, 2), ("tech", "r2", 2, "b", 60.0, 2)]
    before = spark.conf.get(changes._PROVIDER)
    with changes.keyed_state(spark):
        assert spark.conf.get(changes._PROVIDER) != before or "RocksDB" in before
    assert spark.conf.get(changes._PROVIDER) == before
