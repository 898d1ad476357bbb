"""The registered queries run on the published settings."""

from dataclasses import replace
from inspect import signature

from kinweave.catalog import graphs, learning
from kinweave.plans.params import WorkflowParams


def test_workflows_run_on_the_published_settings(monkeypatch):
    used = []
    monkeypatch.setattr(learning, "classify_new", lambda *a: used.append(a[-1]))
    monkeypatch.setattr(learning, "evaluate_database", lambda *a: used.append(a[-1]))
    monkeypatch.setattr(learning, "_workflow_inputs", lambda *a: (Any(),) * 3)
    monkeypatch.setattr(learning.staging, "scratch_path", lambda *a: "")
    monkeypatch.setattr(learning, "strip_version", lambda *a: Any())
    monkeypatch.setattr(learning, "F", Any())
    for name in ("classify_queries", "evaluate_database"):
        learning.query.__globals__["QUERIES"][name](None, None)
    published = WorkflowParams()
    bounds = {"triangles_train": published.triangles_train, "triangles_eval": published.triangles_eval}
    assert [replace(p, **bounds) for p in used] == [published] * 2


def test_embeddings_and_refinement_run_on_the_published_settings(monkeypatch):
    used = []
    queries = learning.query.__globals__["QUERIES"]
    published = WorkflowParams()
    monkeypatch.setattr(graphs, "spark_view", lambda *a: None)
    monkeypatch.setattr(graphs.G, "symmetrize_with_loops", lambda *a: None)
    embed = signature(graphs.embeddings.node_embeddings)
    monkeypatch.setattr(graphs.embeddings, "node_embeddings", lambda *a, **b: used.append(embed.bind(*a, **b)))
    queries["node_embeddings"](None, None)
    used[0].apply_defaults()
    for name in ("dim", "window", "epochs", "walk_length", "p", "q", "walks_per_node"):
        assert used[0].arguments[name] == getattr(published, name)

    refine = signature(learning.ML.triangle_refine)
    monkeypatch.setattr(learning, "side_rows", lambda *a: Any())
    monkeypatch.setattr(learning, "F", Any())
    monkeypatch.setattr(learning.ML, "ordinal_interval_fit", lambda *a: None)
    monkeypatch.setattr(learning.ML, "predict_rank", lambda *a: None)
    monkeypatch.setattr(learning.ML, "triangle_refine", lambda *a, **b: used.append(refine.bind(*a, **b)) or Any())
    for name in ("triangle_refine", "predict_rank"):
        queries[name](None, None)
        used[-1].apply_defaults()
        assert used[-1].arguments["gate"] == published.gate and used[-1].arguments["max_recycles"] == published.max_recycles


class Any:
    """Stands for a table or an expression of which nothing is asked."""

    def __getattr__(self, name):
        return lambda *a, **b: Any()
