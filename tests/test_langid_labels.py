"""Language identification over a table with other labels than the usual four."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from tools.oracle_check import compare, duck

SF_SMALL = "/root/testdata/sf0.001"


def test_further_languages_are_predicted(spark, tmp_path):
    for name in os.listdir(SF_SMALL):
        if name != "documents.parquet":
            os.symlink(f"{SF_SMALL}/{name}", tmp_path / name)
    table = pq.read_table(f"{SF_SMALL}/documents.parquet")
    rows = table.slice(0, 40).to_pylist()
    more = [("it", "perché gli zucchini della nonna sono così buoni"), ("bg", "здравей свят, как си днес"),
            ("it", "gli gnocchi della nonna"), (None, "здравей свят"), ("de", ""), (None, "𐍈")]
    for i, (lang, text) in enumerate(more):
        rows.append({**rows[0], "doc_id": 10**6 + i, "lang": lang, "text": text, "n_chars": len(text)})
    pq.write_table(pa.Table.from_pylist(rows, table.schema), str(tmp_path / "documents.parquet"))
    name = "e11_classify_documents"
    status, n, _, _, msg = compare(spark, duck(str(tmp_path)), name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert status == "ok" and n == len(rows), msg
    got = {r.doc_id: r.pred_lang for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert [got[10**6 + i] for i in range(6)] == ["it", "bg", "it", "bg", "de", "de"]
