from siftwright.config import Settings, budget_for
from siftwright.operators import registry


def test_partial_overrides_keep_defaults():
    s = Settings().merged({"memory_share": 2, "token_budget": 500, "mode_budgets": {"minimal": 300, "debug": -1}, "other": 1})
    assert (s.memory_share, s.token_budget, s.mode_budgets["minimal"], s.mode_budgets["debug"]) == (0.3, 500, 300, 2500)


def test_budget_precedence():
    s = Settings()
    assert budget_for("review", s, 100_000) == 8000
    assert budget_for("review", s, 100) == 1000
    assert budget_for("minimal", s, 100_000) == 800
    assert budget_for("review", s, 100_000, explicit=700, environment=900) == 700
    assert budget_for("review", s, 100_000, environment=900) == 900


def test_registry(spark):
    repos = spark.createDataFrame([("a", "/a", "go"), ("b", "/b", "py")], "name string, path string, language string")
    links = spark.createDataFrame([("a", "b", "imports", 0.5)], "src_repo string, dst_repo string, edge_kind string, confidence double")
    assert registry.add_repo(repos, spark.createDataFrame([("a", "/new", "go")], repos.schema)).where("path = '/new'").count() == 1
    left, rest = registry.remove_repo(repos, links, "b")
    assert left.count() == 1 and rest.count() == 0
    assert [r["confidence"] for r in registry.link(links, spark.createDataFrame([("a", "b", "imports", 0.9)], links.schema)).collect()] == [0.9]
    assert registry.refresh_source(links, "a", links.limit(0)).count() == 0
