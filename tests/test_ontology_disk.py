"""The written ontology takes no more disk than its compressed documents."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from catalens.functions.rules import default_rules
from catalens.operators import graph


def test_written_ontology_is_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "SECTION_ROWS", 700)
    columns = (
        "'t' target, 's' server, concat('d', id div 100) database, 'dbo' schema, concat('T', id div 10) table_name, "
        "concat('Column', id) column_name, 'int' data_type, false is_nullable, id % 10 = 0 is_primary_key, id % 10 = 1 is_foreign_key, "
        "if(id % 10 = 1, 'dbo.T0.Column0', '') fk_references, id row_count_estimate, 0L null_count, 0.0D null_rate, 5L distinct_count, "
        "500L profiled_rows"
    )
    catalog = spark.sql(f"SELECT {columns} FROM range(3000)")
    options = {"base_uri": "urn:x#", "generated_at": F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")}
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before, path = spark.conf.get(setting), str(tmp_path / "o")
    graph.write_ontology(catalog, default_rules(), path, **options)
    assert spark.conf.get(setting) == before
    files = list(Path(path).rglob("part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)
    wanted = graph.ontology_sections(catalog, default_rules(), **options).collect()
    found = graph.read_ontology(spark, path).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, wanted))
    assert sum(f.stat().st_size for f in files) * 4 < sum(len(r.document) for r in wanted)
