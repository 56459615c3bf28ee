"""The registry as a whole: names, SQL, the flagship query, and the rule that nothing else needs the training-data part."""

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quern.plans import registry

ROOT = Path(__file__).resolve().parent.parent
CORE = registry.queries()
#: Cheap ones with SQL, run here on the smallest tables; all run against their SQL at sf0.01 outside the suite.
CHECKED = ["url_classify", "url_parts", "link_resolve", "crawl_bfs", "history_upsert", "sentences", "chunk_ids", "upsert_last_wins", "strip_repeated_lines",
           "bm25_multiquery", "dense_multiquery", "rrf_fuse", "hybrid_reranked", "llm_parse", "result_card", "chunk_fixed", "chunk_semantic", "chunk_header", "html_text", "robots_table", "store_lookup",
           "ingest_store", "ingest_history", "repeated_lines", "bm25_vocab"]


def test_sql_belongs_to_queries():
    assert set(registry.oracle_sql()) <= set(CORE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_only_the_entry_imports_the_llm_part():
    for path in ROOT.glob("quern/**/*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("quern.llm", "corpus_pipeline")) for n in names), path


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, name):
    df = CORE[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns and got == want
