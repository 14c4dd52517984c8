"""The entry point stands without the optional packages, and hides no other missing module."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def entry_without(*missing: str) -> subprocess.CompletedProcess:
    block = "".join(f"sys.modules[{m!r}] = None\n" for m in missing)
    code = f"import sys\n{block}import __spark_entry__ as e\nprint(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("missing", ["corpus_pipeline", "sievelight.llm", "sievelight.llm.queries", "public_tokenizers"])
def test_optional_queries(missing):
    got = entry_without(missing)
    assert got.returncode == 0 and got.stdout.split()[1] == "False" and int(got.stdout.split()[0]) >= 100


def test_other_missing_modules_are_faults():
    assert entry_without("sievelight.plans").returncode != 0
