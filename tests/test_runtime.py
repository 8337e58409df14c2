"""What the driver keeps between steps."""

from marginalia import runtime
from marginalia.llm import mixing


def test_garbage_is_collected_when_it_fills_a_share_of_the_heap(spark, monkeypatch):
    monkeypatch.setattr(runtime, "_HEAP_SHARE", 2.0)
    assert not runtime.relieve(spark) and runtime.relieve(spark, always=True)
    monkeypatch.setattr(runtime, "_HEAP_SHARE", 0.0)
    assert runtime.relieve(spark)


def test_each_round_of_the_fit_gives_the_heap_a_look(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mixing, "relieve", lambda s: seen.append(s))
    rows = spark.createDataFrame([(float(10 + i), [i / 9, 1 - i / 9]) for i in range(10)], "tokens double, p array<double>")
    rated, missed = mixing.fit_rates(rows, [90.0, 60.0], rounds=5)
    assert seen and max(abs(x) for x in missed) < 1e-3 and rated.count() == 10
