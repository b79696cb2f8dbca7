"""The queries of this subpackage and their SQL; the pipeline, which stands at the repository's top, is one of them."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    import millrace.llm as here

    return [m for m in (importlib.import_module(f"millrace.llm.{x.name}") for x in sorted(pkgutil.iter_modules(here.__path__), key=lambda x: x.name) if x.name != "registry") if hasattr(m, "QUERIES")]


def queries() -> dict:
    import corpus_pipeline

    return {k: q for m in _modules() for k, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {k: q for m in _modules() for k, q in m.SQL.items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
