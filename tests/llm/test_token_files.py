import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweave import shared
from logweave.llm.common import shared_path, table
from logweave.llm.encoding import BYTE_BPE, tokenizer_path
from logweave.llm import token_files
from logweave.llm.token_files import Ranged, TokenFiles, op7_token_files, parts_for, read_manifest, read_token_files, write_token_files

PATH = tokenizer_path(BYTE_BPE)
SCHEMA = "doc_id long, text string, start string"


def test_whole_table(spark):
    library = Tokenizer.from_file(PATH)
    got = sorted(op7_token_files(spark, "/root/testdata/sf0.01").collect())
    start = 0
    docs = sorted(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect())
    assert len(got) == len(docs)
    for r, d in zip(got, docs):
        ids = [*library.encode(d.text, add_special_tokens=False).ids, 2]
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)


def test_files(spark, tmp_path):
    docs = [(5, "five", ""), (None, "none", ""), (2, None, ""), (5, "fünf", ""), (9, "x " * 50_000, "")]
    folder = shared_path(spark, "files")
    manifest = write_token_files(spark.createDataFrame(docs, SCHEMA), folder, PATH, parts=3)
    assert read_manifest(folder) == manifest and manifest["documents"] == 5 and manifest["ids"] == "<u2"
    files = TokenFiles(folder)
    rows = [files.document(i) for i in range(len(files))]
    assert [r[0] for r in rows] == [None, 2, 5, 5, 9]
    assert all(a[1] + len(a[2]) == b[1] for a, b in zip(rows, rows[1:])) and rows[0][1] == 0
    assert rows[1][2].tolist() == [2] and all(r[2][-1] == 2 for r in rows)
    back = {(r.doc_id, r.start): bytes(r.ids) for r in read_token_files(spark, folder).collect()}
    assert back == {(d, s): t.astype("<u4").tobytes() for d, s, t in rows}


def test_wide_ids(spark):
    folder = shared_path(spark, "files")
    assert write_token_files(spark.createDataFrame([(1, "a", "")], SCHEMA), folder, PATH, vocab=1 << 17, parts=1)["ids"] == "<u4"
    assert array("I", bytes(read_token_files(spark, folder).first().ids)).tolist() == [64, 2]


def test_empty(spark):
    folder = shared_path(spark, "files")
    assert write_token_files(spark.createDataFrame([], SCHEMA), folder, PATH)["tokens"] == 0
    assert read_token_files(spark, folder).collect() == []


def test_parts_follow_the_bytes(spark):
    docs, least = table(spark, "/root/testdata/sf0.01", "documents"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = os.path.getsize("/root/testdata/sf0.01/documents.parquet")
    assert parts_for(docs) == least and parts_for(docs, 10_000) == -(-size // 10_000) > least
    # joins multiply estimates, and rows made in memory have none
    assert parts_for(docs.join(docs.select(F.col("doc_id").alias("other")), F.col("doc_id") == F.col("other")), 10_000) <= 2 * -(-size // 10_000)
    assert parts_for(spark.createDataFrame([(1, "a", "")], SCHEMA)) == least


def test_stores_that_are_not_mounted(spark, monkeypatch):
    """Through Arrow's file systems: ids are read by stretches, not as a whole part."""
    folder = shared_path(spark, "files")
    write_token_files(spark.createDataFrame([(i, f"text number {i} " * i, "") for i in range(20)], SCHEMA), folder, PATH, parts=2)
    want = [TokenFiles(folder).document(i) for i in range(20)]
    monkeypatch.setattr(token_files, "mounted", lambda _: None)
    monkeypatch.setattr(shared, "mounted", lambda _: None)
    files = TokenFiles(folder)
    got = [files.document(i) for i in range(20)]
    assert [(d, s, t.tolist()) for d, s, t in got] == [(d, s, t.tolist()) for d, s, t in want]
    p = files.manifest["parts"][0]
    assert isinstance(token_files._maps(folder, files.manifest["ids"], p)[2], Ranged)
    rows = [r for b in token_files._read_part(iter([pa.RecordBatch.from_pylist(files.manifest["parts"])]), folder, files.manifest["ids"]) for r in b.to_pylist()]
    assert [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows] == [(d, s, t.tolist()) for d, s, t in want]


def test_very_long_text_without_spaces(spark):
    folder = shared_path(spark, "files")
    text = "ab" * 600_000
    write_token_files(spark.createDataFrame([(1, text, "")], SCHEMA), folder, PATH, parts=1)
    assert TokenFiles(folder).document(0)[2].tolist() == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 2]
