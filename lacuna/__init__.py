"""Lacuna: evidence-coverage analytics on Spark."""

from importlib import import_module

__version__ = "0.1.0"

#: Names that users import from the package, and where they are. They load when first used, so that workers load only what they run.
EXPORTS = {
    "configure": "lacuna.session",
    "read_cases": "lacuna.sources.cases",
    "evidence_matrix": "lacuna.operators.matrix",
    "coverage": "lacuna.operators.matrix",
    "explain": "lacuna.operators.matrix",
    "classify": "lacuna.operators.timeline",
    "read_timeline": "lacuna.sources.timelines",
    "read_mft": "lacuna.sources.mft",
    "read_prefetch": "lacuna.sources.prefetch",
    "read_amcache": "lacuna.sources.amcache",
    "read_application_cache": "lacuna.sources.registry",
    "read_folder_bags": "lacuna.sources.registry",
    "outcomes": "lacuna.operators.rivals",
    "support": "lacuna.operators.rivals",
    "counterfactuals": "lacuna.operators.rivals",
    "link_errors": "lacuna.operators.chain",
    "summarize": "lacuna.operators.chain",
    "seal_export": "lacuna.operators.seal",
    "seal_bundle": "lacuna.operators.seal",
    "verify_rows": "lacuna.operators.verify",
    "digest": "lacuna.functions.canonical",
    "run_batch": "lacuna.sinks",
    "ADAPTERS": "lacuna.adapters",
}
__all__ = [*EXPORTS, "__version__"]


def __getattr__(name: str):
    if name not in EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(EXPORTS[name]), name)
