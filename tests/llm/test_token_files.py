"""Token files: same ids as the library, order, starts, and what the files let a reader skip."""

import random

import numpy as np
import pyarrow as pa
import pytest
from small import SCHEMA

from riskfeat.llm import token_files
from riskfeat.llm.plans import tokenizer_file


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_encoder_on_random_characters(tokenizer):
    encoder, r = token_files.Encoder(tokenizer_file()), random.Random(3)
    alphabet = [*"abcDEF 's\n\t.,!<|>0129éÉ×÷ßñ’—中́İſ\x1c\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll ", "the "]
    for _ in range(60):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(20)]
        ids, n = encoder.encode(pa.array(texts), 1)
        want = [i for t in texts for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 1]]
        assert ids.tolist() == want and n.sum() == len(want)


def test_files_of_odd_rows(spark, tokenizer, odd, tmp_path):
    path = str(tmp_path / "orc")
    token_files.write(odd, path, tokenizer_file(), n_files=5)
    got = token_files.read(spark, path).collect()
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    assert sorted(list(r["ids"]) for r in got) == sorted(ids(r["text"]) for r in rows)
    assert [1] in [list(r["ids"]) for r in got]


def test_empty_table(spark, nothing, tmp_path):
    token_files.write(nothing, str(tmp_path / "orc"), tokenizer_file())
    assert token_files.digests(token_files.read(spark, str(tmp_path / "orc"))).count() == 0


def test_lookups_reach_the_files(spark, odd, tmp_path):
    from pyarrow import orc

    path = str(tmp_path / "orc")
    token_files.write(odd, path, tokenizer_file(), n_files=3)
    plan = token_files.read(spark, path).where("doc_id = 12")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,12)" in plan and "ids" in plan
    narrow = token_files.file_offsets(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in narrow.split("ReadSchema")[-1].split(">")[0]
    files = sorted((tmp_path / "orc").glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == odd.count()
    assert all(orc.ORCFile(f).row_index_stride == token_files.ROW_GROUP for f in files)


def test_schema_of_the_fixture(odd):
    assert len(odd.columns) == len(SCHEMA.split(","))
