"""The levelled store of a stream's mapping: few runs, replay, earlier stores."""

import pytest

from veilframe.operators import mapping as M
from veilframe.streaming import jobs as J
from veilframe.streaming import runs as RU

KEY = M.derive_key("secret", b"s" * 32, iterations=1000)


def add(spark, store, number, values):
    RU.add_batch(spark.createDataFrame([(number, v) for v in values], "n int, v string").coalesce(1), store, number)


def lost(*args, **how):
    raise OSError("lost")


def held(spark, store, number):
    return sorted((r.n, r.v) for r in RU.read_before(spark, store, number).collect())


def test_runs_stay_few_and_hold_everything(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(RU, "FAN", 3)
    store = str(tmp_path / "store")
    assert RU.read_before(spark, store, 0) is None
    for n in range(14):
        add(spark, store, n, [] if n == 4 else [f"v{n}"])
        levels = [at for at, _ in RU.active_runs(spark, store, n)]
        assert levels == sorted(levels, reverse=True) and all(levels.count(at) < 3 for at in levels)
        assert held(spark, store, n + 1) == [(k, f"v{k}") for k in range(n + 1) if k != 4]
    assert levels == [2, 1, 0, 0]  # 14 = 9 + 3 + 2
    assert spark.read.parquet(store).count() == 13


def test_a_batch_run_again_replaces_its_own_rows_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(RU, "FAN", 2)
    store = str(tmp_path / "store")
    for n in range(3):
        add(spark, store, n, [f"v{n}"])
    add(spark, store, 3, ["lost"])       # merges levels 0 and 1
    add(spark, store, 3, ["again"])
    assert held(spark, store, 3) == [(0, "v0"), (1, "v1"), (2, "v2")]
    assert held(spark, store, 4) == [(0, "v0"), (1, "v1"), (2, "v2"), (3, "again")]


def test_store_of_an_earlier_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(RU, "FAN", 2)
    store = str(tmp_path / "store")
    for n in range(3):
        spark.createDataFrame([(n, f"v{n}")], "n int, v string").write.parquet(RU.batch_path(store, n))
    add(spark, store, 3, ["v3"])
    assert len(RU.active_runs(spark, store, 3)) == 1
    assert held(spark, store, 4) == [(n, f"v{n}") for n in range(4)]


@pytest.mark.parametrize("fails", ["mapping", "log"])
def test_failed_batch_is_replayed(spark, tmp_path, monkeypatch, fails):
    """A batch that fails after any of its writes leaves no row twice and keeps its fakes."""
    monkeypatch.setattr(RU, "FAN", 2)
    source, out, log, store, state = (str(tmp_path / n) for n in ("in", "out", "log", "store", "state"))

    def run(k):
        spark.createDataFrame([(k, f"a@b.org and c{k}@d.org")], "doc int, text string").coalesce(1).write.mode(
            "append").parquet(source)

    def start():
        stream = J.read_stream(spark, source, spark.read.parquet(source).schema)
        J.scrub_batches(stream, "doc", "text", out, log, state, store=store, mode="pseudonymise", key=KEY,
                        session_id="s").awaitTermination()

    run(0)
    start()
    run(1)
    with monkeypatch.context() as m:
        m.setattr(*{"mapping": (RU, "_merge"), "log": (J, "audit_entries")}[fails], lost)
        with pytest.raises(Exception):
            start()
    start()
    run(2)
    start()
    texts = {r.doc: r.scrubbed_text.split(" and ") for r in spark.read.parquet(out).collect()}
    assert len(texts) == 3 and len({t[0] for t in texts.values()}) == 1 and "a@b.org" not in texts[0]
    assert spark.read.parquet(store).count() == 4 == RU.read_before(spark, store, 3).count()
    assert spark.read.parquet(log).count() == 3
