"""Tables that grow with the urls meet by merge joins, however small Spark takes them for."""

import re

import pytest

from weekloom.llm import urls


@pytest.fixture
def pages(spark):
    hosts = ("a.example.org", "b.example.com", "example.org", "x.net")
    rows = [(i, f"http://{hosts[i % 4]}/{('fr', 'de', 'es')[i % 3]}/{i // 2 * 7919}") for i in range(400)]
    return spark.createDataFrame([*rows, (None, None), (7, rows[7][1])], "page_id long, url string")


def broadcast_keys(df):
    """The key and the side of every broadcast join as it is planned, before any size is measured."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"BroadcastHashJoin \[(\w+)#[^\]]*\], \[[^\]]*\], \w+, (Build\w+)", plan)


def test_addresses_and_runs_are_not_broadcast(pages, monkeypatch):
    real, staged = urls.stage, []
    monkeypatch.setattr(urls, "stage", lambda df: staged.append(df) or real(df))
    plans = [urls.filtered(pages), *staged]
    found = [x for df in plans for x in broadcast_keys(df)]
    assert len(staged) > 2 and not [x for x in found if x[0] == "address" or x == ("run", "BuildLeft")]
    assert "SortMergeJoin [address" in plans[0]._jdf.queryExecution().executedPlan().toString()


def test_scores_are_the_same_by_either_join(pages):
    rows = urls.ruled(pages).selectExpr("concat(host, path) AS address", "action")
    addresses = rows.groupBy("address").pivot("action", ["allow", "block"]).count().na.fill(0)
    addresses = addresses.toDF("address", "allowed", "blocked")
    by_merge, by_broadcast = urls.scored(addresses, limit=0), urls.scored(addresses)
    assert by_merge.count() == addresses.count() == addresses.select("address").distinct().count()
    assert by_merge.exceptAll(by_broadcast).isEmpty() and by_broadcast.exceptAll(by_merge).isEmpty()
    assert not broadcast_keys(by_merge) and ("run", "BuildRight") in broadcast_keys(by_broadcast)
