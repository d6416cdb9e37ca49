"""Nothing outside the subpackage for training data imports it."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_core_does_not_import_llm():
    for p in (ROOT / "pagewright").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"pagewright\.llm|from \.+llm", p.read_text()), p


def test_no_local_checkpoint():
    for p in (ROOT / "pagewright").rglob("*.py"):
        assert "localCheckpoint(" not in p.read_text(), p
