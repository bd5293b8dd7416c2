import importlib
import sys

import __spark_entry__ as entry


def test_entry_stands_without_the_training_package(monkeypatch):
    every = set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("fleetfold.llm")] + ["fleetfold.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    import fleetfold

    monkeypatch.delattr(fleetfold, "llm", raising=False)
    try:
        bare = importlib.reload(entry)
        assert "outcome_ledger" in bare.queries() and not any(n.startswith("op") and "_" in n and n[2].isdigit() for n in bare.queries())
        assert set(bare.oracle_sql()) <= set(bare.queries()) <= every
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
