"""Query registry; the modules below register themselves on import."""

from importlib import import_module

_MODULES = (
    "sources_plans", "projection_plans", "signature_plans", "aggregate_plans", "detector_plans", "fusion_plans",
    "lookup_plans", "graph_plans", "drift_plans", "evaluation_plans", "model_plans", "scenario_plans", "stream_plans",
)


def _load():
    from tracewarden.plans import registry

    for m in _MODULES:
        import_module(f"tracewarden.plans.{m}")
    return registry


def all_queries():
    return _load().QUERIES


def all_oracles():
    return _load().ORACLES
