"""Hits, expiry and invalidation of kept results."""

from graphloom.operators.cache import ResultCache, request_key


def test_hits_expiry_and_invalidation(spark, tmp_path):
    now, runs = [1000.0], []
    cache = ResultCache(spark, str(tmp_path / "c"), ttl=300, clock=lambda: now[0])
    request = {"repo_id": "org/a b", "task": "t", "entry_points": ["x", "y"], "depth": 2}

    def run():
        runs.append(1)
        return spark.createDataFrame([(len(runs), [1.5, None]), (None, None)], "n int, v array<double>")

    ask = lambda r=request, version="v1": sorted(map(tuple, cache.get_or_run(r, version, run).collect()), key=repr)
    first = ask()
    assert ask() == first and len(runs) == 1
    assert ask(request | {"entry_points": ["y", "x"]}) == first and len(runs) == 1
    ask(version="v2")
    ask(request | {"depth": 3})
    assert len(runs) == 3
    now[0] = 1299.9
    assert ask() == first and len(runs) == 3
    now[0] = 1300.0
    assert ask() != first and len(runs) == 4
    other = request | {"repo_id": "b"}
    ask(other)
    assert cache.invalidate("org/a b") and not cache.invalidate("nobody")
    assert cache.get(request, "v1") is None and cache.get(other, "v1") is not None


def test_an_empty_result_is_kept(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "c"))
    cache.put({"repo_id": "r"}, "v", spark.createDataFrame([], "a long, b string"))
    assert cache.get({"repo_id": "r"}, "v").columns == ["a", "b"] and cache.get({"repo_id": "r"}, "v").count() == 0
    assert request_key({"repo_id": "r", "a": 1}, "v") == request_key({"a": 1, "repo_id": "r"}, "v") != request_key({"repo_id": "r", "a": 1}, "w")
