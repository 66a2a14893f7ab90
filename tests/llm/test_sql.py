"""Every operator's query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import json
import os

import duckdb
import pytest

from spindrift.llm import bpe, packing, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


@pytest.mark.parametrize(("encoder", "name", "other"), [(bpe.TreeEncoder, "word_bpe_49k.json", "byte_bpe_50k.json"), (packing.ByteEncoder, "byte_bpe_50k.json", "word_bpe_49k.json")])
def test_files_that_cut_texts_otherwise_are_refused(tmp_path, encoder, name, other):
    with pytest.raises(ValueError, match="normalizer"):
        encoder(queries.tokenizer(other))
    spec = json.load(open(queries.tokenizer(name), encoding="utf-8"))
    spec["model"]["ignore_merges"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="ignore_merges"):
        encoder(str(tmp_path / "other.json"))
