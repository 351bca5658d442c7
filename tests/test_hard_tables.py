"""Every query over empty tables and over tables with nulls in any column and repeated rows: none may fail."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from conftest import DATA

import __spark_entry__ as entry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("hard"), np.random.default_rng(3)
    for kind in ("empty", "nulls"):
        (root / kind).mkdir()
    for name in os.listdir(DATA):
        t = pq.read_table(f"{DATA}/{name}")
        pq.write_table(t.slice(0, 0), root / "empty" / name)
        columns = [c if pa.types.is_nested(c.type) else pc.if_else(pa.array(rng.random(t.num_rows) < 0.08), pa.scalar(None, c.type), c) for c in t.columns]
        t = pa.table(columns, names=t.column_names)
        pq.write_table(pa.concat_tables([t, t.slice(0, max(1, t.num_rows // 5))]), root / "nulls" / name)
    return root


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n[0] == "p" and n[1].isdigit()))
def test_runs(spark, made, kind, name):
    got = entry.queries()[name](spark, str(made / kind)).collect()
    if kind == "empty" and not name.endswith(("report", "counts", "cases", "ordinals", "appended", "fill")):  # these count, or know their rows
        assert got == []


@pytest.mark.parametrize("name", ["dense_topk", "bm25_topk", "search_as_of", "citations", "requirement_responses", "article_chunks", "ledger_checks", "scd2_reconcile", "day_spine", "catalog_ancestors", "search_dense_as_of", "apply_versions", "index_maintenance", "catalog_diff", "graph_kept", "body_structure"])
@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_own_operators(spark, made, kind, name):
    entry.queries()[name](spark, str(made / kind)).collect()
