"""Every stage on what the one before it kept, against plain versions on the smallest tables."""

import corpus_pipeline
import duckdb
import pyarrow.parquet as pq
import pytest
from test_decontaminate import scan
from test_jaccard import shingles
from test_queries import FOLDER

from riskfeat.llm.plans import MIX_SQL, tokenizer_file


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), [pq.read_table(f"{FOLDER}/documents.parquet").to_pandas()]
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, FOLDER)
        df.write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_copies", "decontamination", "source_mix", "token_files"]
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[:5])


def test_quality_stage(stages):
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    kept = set(stages[1]["doc_id"])
    assert kept < set(stages[0]["doc_id"])
    right = [(d in kept) == (q == 1) for d, q in label.items()]
    assert sum(right) / len(right) > 0.9


def test_near_copies_stage(stages):
    rows = sorted(zip(stages[1]["doc_id"], map(shingles, stages[1]["text"]), strict=True))
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert sorted(stages[2]["doc_id"]) == sorted(d for d in root if find(d) == d)


def test_decontamination_stage(stages):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]
    clean = [d for d, t in zip(stages[2]["doc_id"], stages[2]["text"], strict=True) if scan(t, items, 10)[1] == 0]
    assert sorted(stages[3]["doc_id"]) == sorted(clean)


def test_mix_stage(stages):
    con = duckdb.connect()
    con.register("documents", stages[3])
    copies = dict(con.execute(f"SELECT doc_id, copies FROM ({MIX_SQL})").fetchall())
    got = stages[4]["doc_id"].value_counts().to_dict()
    assert got == {d: n for d, n in copies.items() if n}


def test_token_stage(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    start = 0
    for (d, t), r in zip(sorted(zip(stages[4]["doc_id"], stages[4]["text"], strict=True)), stages[5].sort_values("start").itertuples(), strict=True):
        assert (r.doc_id, r.start) == (d, start)
        assert r.n_tokens == len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        start += r.n_tokens


def test_run_gives_the_rows_of_the_stages_twice(spark, stages):
    first, second = corpus_pipeline.run(spark, FOLDER), corpus_pipeline.run(spark, FOLDER)
    want = sorted(map(tuple, stages[5][first.columns].itertuples(index=False)))
    assert sorted(map(tuple, first.collect())) == want == sorted(map(tuple, second.collect()))


def test_odd_and_empty_tables_pass_all_stages(spark, odd, nothing, tmp_path):
    """Nulls, repeated rows, a long text and clashing columns; then no rows at all."""
    for name, docs in (("odd", odd), ("nothing", nothing)):
        size = docs.count()
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, FOLDER)
            out.write.parquet(str(tmp_path / name / stage_name))
            after = spark.read.schema(out.schema).parquet(str(tmp_path / name / stage_name))
            if k < 4:
                assert after.columns == odd.columns
            docs = after
        assert (size == 0) == (docs.count() == 0)
