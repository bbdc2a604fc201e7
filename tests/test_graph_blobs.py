"""Blobs of a cell are bounded by their edges, not by the cell."""

from compare import connect, rows_of_spark, rows_of_sql

from wayfold import plans
from wayfold.plans import graphs

FOLDER = "/root/testdata/sf0.001"


def test_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "_BLOCK", 5)
    cols, rows = rows_of_spark(plans.QUERIES["sc13_graph_roundtrip"](spark, FOLDER))
    want = rows_of_sql(connect(FOLDER), plans.ORACLES["sc13_graph_roundtrip"])
    assert (cols, rows) == want and max(int(r[cols.index("edges")]) for r in rows) > 5
