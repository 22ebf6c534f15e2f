"""Each stage of the pipeline against brute force over what the stage before kept."""


from helpers import DOCS, docs
from test_decontaminate import every_pair
from test_lines import maximal
from test_near_copies import expected
from test_packing import check

import corpus_pipeline
from tidemark.llm import language

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, tmp_path):
    assert len(corpus_pipeline.STAGES) == 5
    steps = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], SF).write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes
    whole, known, lined, single, clean = (rows(df) for df in steps[:5])
    # language: what goes has no letters or is far from every language; here all have a language
    model = language.learned_from(steps[0])
    far = {r.doc_id for r in language.identify(steps[0], model).where("not accepted").collect()}
    assert set(known) == set(whole) - far and len(far) <= 0.02 * len(whole)
    # lines
    order = sorted(known)
    assert [lined[d].text for d in order] == maximal([known[d].text for d in order])
    assert all(r.n_chars == len(r.text) for r in lined.values())
    # near copies: the smallest doc_id of each component stays
    assert set(single) == expected([(d, r.text) for d, r in lined.items()])
    # benchmark
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    held = {d for d, _ in every_pair({d: r.text for d, r in single.items()}, [items[i] for i in sorted(items)])}
    gone = set(single) - set(clean)
    assert gone <= held and len(gone) >= 0.95 * len(held)
    assert {d for d, r in single.items() if any(x in r.text for x in items.values())} <= gone
    # packing
    check(steps[5].collect(), {d: r.text for d, r in clean.items()}, 4096)


def test_run_equals_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_stages_take_odd_rows(spark):
    """Nulls, repeated rows, long texts, and columns named like those that operators add."""
    texts = [None, "", "123", "a b c", "a b c", "the word " * 3000, "x\ny\nz", "x\ny\nz\nw"]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, "null id", None, None, None), (3, "a b c", "en", "s", 5)], DOCS))
    odd = ["score", "symbols", "lang_pred", "excess", "accepted", "row", "__row", "__row_key", "runs", "fp", "set", "count", "words", "item_id", "n_removed", "length", "start"]
    more = df.selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(odd)])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        base = stage(spark, df, SF)
        assert base.count() > 0
        wide = stage(spark, more, SF)
        assert sorted((r.doc_id or -1) for r in wide.collect()) == sorted((r.doc_id or -1) for r in base.collect()), name
        if k < 4:
            row = wide.first()
            assert wide.columns == more.columns and all(row[c] == i for i, c in enumerate(odd)), name


def test_stages_take_empty_tables(spark):
    empty = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
