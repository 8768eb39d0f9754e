"""Every query against its SQL, and those without SQL against their promises."""

import subprocess
import sys

import pytest

from loomtale.plans import catalog

from .conftest import DATA, ROOT


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_is_its_sql(name, spark, same_rows):
    same_rows(catalog.QUERIES[name](spark, DATA), catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["html_text", "consolidate_full"])
def test_others_give_rows(name, spark):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["language", "documents", "chunks", "narrative_chunks", "narrative_chars"] and df.count() > 0


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['loomtale.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(sorted(k for k in e.queries() if k[:2] == 'op'), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert out.stdout.split()[0] == "[]"


def test_nothing_else_imports_the_corpus_operators():
    from pathlib import Path

    for p in Path(ROOT, "loomtale").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "loomtale.llm" not in p.read_text() and "from ..llm" not in p.read_text() and "from .llm" not in p.read_text(), p
