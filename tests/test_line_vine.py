"""The lines are read once for a round trip."""

from meteospan.operators import vine
from meteospan.plans import catalog


def test_table_of_a_vine_is_written_once(spark, monkeypatch):
    monkeypatch.setattr(vine, "fit_vine", lambda table, *more, **options: None)
    table, _ = catalog.line_vine(spark, "/root/testdata/sf0.001")
    assert not table.inputFiles()
