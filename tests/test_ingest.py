"""Fetching and recording: pools, variants of a path, and runs that die at any step."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest as N
from tidemark.sources import captures as S
from tidemark.streaming import ingest as T


def pool(get, rows, each=4, per_host=4):
    return list(N._Pool(get, each, per_host).results(iter(rows)))


def test_a_thousand_failing_variants_of_a_path_are_one_round(monkeypatch):
    monkeypatch.setattr(N, "VARIANTS", 300)
    calls = []

    def get(url):
        calls.append(url)
        return (200, {}, b"x") if url in ("u1000", "other") else (404, {}, b"")

    tried = pool(get, [("h", "k", f"u{i}", "d") for i in range(1500)] + [("h", "l", "other", "e")])
    assert [c for c in calls if c != "other"] == [f"u{i}" for i in range(1001)]
    assert [r[0] for r in tried if r[4] is None] == ["u1000", "other"] or [r[0] for r in tried if r[4] is None] == ["other", "u1000"]
    assert len(tried) == 1002


@pytest.mark.parametrize(("each", "per_host", "hosts", "want"), [(4, 4, 1, 4), (6, 2, 1, 2), (6, 2, 5, 6), (1, 3, 2, 1)])
def test_requests_under_way_are_bounded_by_pool_and_host(each, per_host, hosts, want):
    lock, now, most, by_host = threading.Lock(), [0], [0], {}

    def get(url):
        host = url.split("/")[0]
        with lock:
            now[0] += 1
            by_host[host] = by_host.get(host, 0) + 1
            most[0] = max(most[0], now[0])
            assert by_host[host] <= per_host
        time.sleep(0.01)
        with lock:
            now[0] -= 1
            by_host[host] -= 1
        return 200, {}, b"x"

    tried = pool(get, [(f"h{i % hosts}", i, f"h{i % hosts}/{i}", "d") for i in range(60)], each, per_host)
    assert len(tried) == 60 and all(r[4] is None for r in tried) and most[0] <= want


def test_a_slow_host_does_not_hold_up_the_others():
    def get(url):
        time.sleep(0.3 if url.startswith("slow") else 0.001)
        return 200, {}, b"x"

    began = time.perf_counter()
    tried = pool(get, [("slow", "s", "slow", "d")] + [("f", i, f"f{i}", "d") for i in range(100)])
    assert len(tried) == 101 and tried[-1][0] == "slow" and time.perf_counter() - began < 2


def getter(folder):
    """Counts its calls in a folder; made here, so that workers get it by value."""

    def get(url):
        with open(f"{folder}/{url.replace('/', '_').replace('#', '+')}", "a") as f:
            f.write("x")
        return (404, {}, b"") if "gone" in url else (200, {"content-type": ""}, url.encode())

    return get


class Died(Exception):
    pass


STEPS = ["write_tree", "Versions.commit", "_dropped", "fetch"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
def test_a_run_that_dies_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step, after):
    lists, state, root, calls = (tmp_path / x for x in ("lists", "state", "root", "calls"))
    for x in (lists, calls):
        x.mkdir()
    urls = [f"http://a/{i}.js" for i in range(6)] + ["http://a/gone.js", "http://a/0.js#2"]
    (lists / "one.txt").write_text("\n".join(urls))
    owner, name = (T.Versions, "commit") if step == "Versions.commit" else (T, step)
    real = getattr(owner, name)

    def dying(*args, **more):
        if after:
            real(*args, **more)
        raise Died

    monkeypatch.setattr(owner, name, dying)
    with pytest.raises(Exception):
        T.ingest(spark, str(lists), str(state), str(root), getter(str(calls))).awaitTermination()
    monkeypatch.setattr(owner, name, real)
    T.ingest(spark, str(lists), str(state), str(root), getter(str(calls))).awaitTermination()
    assert {r.url for r in T.recorded(spark, str(state)).collect()} == set(urls) - {"http://a/gone.js"}
    assert {p.name: p.read_bytes() for p in (root / "http/a").iterdir()} == {f"{i}.js": f"http://a/{i}.js".encode() for i in range(6)}
    counts = {p.name: len(p.read_text()) for p in calls.iterdir() if "gone" not in p.name}
    assert set(counts.values()) == {1} and len(counts) == 6  # nothing is fetched twice
    assert not list((state / "fetched").iterdir()) and not (root / ".tidemark").exists()
    before = {p.name: len(p.read_text()) for p in calls.iterdir()}
    T.ingest(spark, str(lists), str(state), str(root), getter(str(calls))).awaitTermination()
    assert before == {p.name: len(p.read_text()) for p in calls.iterdir()}


@pytest.mark.parametrize("step", ["commit", "vacuum"])
def test_a_compaction_that_dies_loses_nothing(spark, tmp_path, monkeypatch, step):
    state = str(tmp_path / "state")
    table = T.Versions(f"{state}/record")
    for i in range(3):
        spark.createDataFrame([(f"u{i}", f"d{i}")], "url string, dest string").write.parquet(table.path(f"s{i}"))
        table.commit(i, [f"s{k}" for k in range(i + 1)])
    real = getattr(T.Versions, step)

    def dying(*_args, **_more):
        raise Died

    monkeypatch.setattr(T.Versions, step, dying)
    with pytest.raises(Died):
        T.compact(spark, state)
    monkeypatch.setattr(T.Versions, step, real)
    assert {r.url for r in T.recorded(spark, state).collect()} == {"u0", "u1", "u2"}
    T.compact(spark, state)
    assert {r.url for r in T.recorded(spark, state).collect()} == {"u0", "u1", "u2"} and len(table.segments()) == 1


def test_the_record_as_json(spark, tmp_path):
    state = str(tmp_path / "state")
    long = "http://a/" + "n" * 210 + ".html"
    table = T.Versions(f"{state}/record")
    spark.createDataFrame([(u, "d") for u in ("http://a/1", "http://a/é", long)], "url string, dest string").write.parquet(table.path("s"))
    table.commit(0, ["s"])
    T.write_state(spark, state, str(tmp_path / "out"))
    back = S.json_state(spark, str(tmp_path / "out/download_state.json"), "array<string>").select(F.explode("state").alias("u")).collect()
    assert {r.u for r in back} == {"http://a/1", "http://a/é", long}
    names = S.json_state(spark, str(tmp_path / "out/filename_mapping.json"), "map<string,string>").select(F.explode("state")).collect()
    assert [(r.key[:150], r.value) for r in names] == [("n" * 150, "n" * 210 + ".html")]


def test_plans_without_rows(spark):
    assert N.fetch(spark.createDataFrame([], "url string, dest string"), getter("/nowhere")).collect() == []
