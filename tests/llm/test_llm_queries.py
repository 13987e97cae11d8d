import pytest

from notegraph.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["query_id", "title"], "p2_found": ["note_id"], "p3_found": ["title", "term"], "p4_found": ["vec_field", "note_id_a", "note_id_b"], "p5_found": ["note_id", "kind"],
    "p7_found": ["suggestion_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = [str(r) for r in df.collect()]
    assert len(rows) == len(set(rows))


def test_clean_notes_and_found_ones_are_all(spark):
    notes = spark.read.parquet(f"{SF}/notes.parquet").count()
    assert QUERIES["p2_found"](spark, SF).count() + QUERIES["p2_clean"](spark, SF).count() == notes
