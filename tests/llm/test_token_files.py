import os
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from helpers import docs, odd_texts

from tidemark.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def expected(rows):
    """(doc_id, start, n, crc) by a loop over (doc_id, text)."""
    each = [(d, np.array(ids_of(t), "<u4")) for d, t in rows]
    out, at = [], 0
    for d, ids in sorted(each, key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def folder(tmp_path):
    return f"file://{tmp_path}/ids"


def test_odd_texts_and_lookup(spark, tmp_path):
    texts = odd_texts()
    token_files.write(docs(spark, texts).selectExpr("*", "1 AS n", "2 AS row", "3 AS ids"), PATH, folder(tmp_path))
    assert rows_of(token_files.read(spark, folder(tmp_path))) == expected(list(enumerate(texts)))
    for k in (0, 1, 7, 8, 10):
        assert [x.tolist() for x in token_files.ids_of(spark, folder(tmp_path), k)] == [ids_of(texts[k])]
    assert token_files.ids_of(spark, folder(tmp_path), 999) == []


def test_empty_table(spark, tmp_path):
    token_files.write(docs(spark, []), PATH, folder(tmp_path))
    assert token_files.read(spark, folder(tmp_path)).count() == 0


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (-5, "d e f"), (None, None)]
    token_files.write(docs(spark, rows), PATH, folder(tmp_path))
    got = rows_of(token_files.read(spark, folder(tmp_path)))
    assert [r[0] for r in got] == [None, None, -5, 1, 1]
    assert sorted(map(repr, (r[0::2] for r in got))) == sorted(map(repr, (r[0::2] for r in expected(rows))))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert [x.tolist() for x in token_files.ids_of(spark, folder(tmp_path), 1)] == [ids_of("a b")] * 2
    assert sorted(len(x) for x in token_files.ids_of(spark, folder(tmp_path), None)) == sorted([len(ids_of("c")), 1])


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(token_files.op13_token_files(spark, "/root/testdata/sf0.001")) == expected([(r.doc_id, r.text) for r in df.collect()])


def test_dictionary_and_files(spark, tmp_path):
    """The dictionary makes short documents smaller; damage and another dictionary are noticed."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = token_files.write(df, PATH, folder(tmp_path)).collect()
    dictionary = (tmp_path / "ids/dictionary").read_bytes()
    assert len(dictionary) > 10_000
    import zstandard

    short = [np.array(ids_of(r.text), "<u2").tobytes() for r in df.where("length(text) < 1500").limit(100).collect()]
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(x)) for x in short)
    both = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
    assert sum(len(both.compress(x)) for x in short) < 0.9 * alone
    assert sum(r.n_docs for r in told) == df.count()
    assert {r.file for r in told} <= set(os.listdir(tmp_path / "ids/files"))
    from pyarrow import fs

    path = tmp_path / "ids/files" / told[0].file
    with fs.LocalFileSystem().open_input_file(str(path)) as f, pytest.raises(ValueError, match="another dictionary"):
        token_files.Reader(f, dictionary[:-1])
    whole = bytearray(path.read_bytes())
    whole[-40] ^= 1
    path.write_bytes(whole)
    with fs.LocalFileSystem().open_input_file(str(path)) as f, pytest.raises(ValueError, match="index is damaged"):
        token_files.Reader(f, dictionary)


def test_files_of_lost_attempts_do_not_count(spark, tmp_path):
    token_files.write(docs(spark, ["a", "b"]), PATH, folder(tmp_path))
    (tmp_path / "ids/files/left.ids").write_bytes(b"half a file")
    assert len(rows_of(token_files.read(spark, folder(tmp_path)))) == 2
