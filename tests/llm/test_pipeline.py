import corpus_pipeline
from larder.llm import langid
from larder.llm.queries import PACK_TOKENIZER, tokenizer_path
from larder.llm.secrets import mask
from tests.llm.helpers import DATA, awkward, documents
from tests.llm.test_near_dedup import brute

STAGES = dict(corpus_pipeline.STAGES)


def stage(spark, name, docs):
    return STAGES[name](spark, docs, DATA)


def rows(df):
    return sorted(map(str, df.collect()))


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "secret_scan", "packing"]


def test_language_stage_drops_what_the_model_rejects(spark):
    docs = documents(spark)
    model = langid.train(docs)
    want = [r for r in docs.collect() if not model.predict([r.text])[2][0]]
    got = stage(spark, "language_id", docs)
    assert got.columns == docs.columns and rows(got) == sorted(map(str, want))
    assert docs.count() - len(want) <= 2  # these documents are clean


def test_exact_stage_keeps_the_largest_id(spark):
    docs = documents(spark).unionByName(documents(spark).filter("doc_id < 20"))
    last = {}
    for r in docs.collect():
        last[r.text] = max(last.get(r.text, r), r, key=lambda x: x.doc_id)
    assert rows(stage(spark, "exact_dedup", docs)) == sorted(map(str, last.values()))


def test_exact_stage_judges_each_text_of_a_doc_id_and_keeps_clashing_columns(spark):
    rows = [(5, "a", 1), (5, "b", 2), (9, "b", 3), (9, "b", 4), (None, "b", 5), (None, "c", 6), (None, "c", 7), (7, None, 8), (8, "", 9), (3, "d", 10)]
    docs = spark.createDataFrame([(i, t, "en", n, n, True) for i, t, n in rows], "doc_id long, text string, lang string, n_chars int, digest int, stays boolean")
    got = stage(spark, "exact_dedup", docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("3", "d"), ("5", "a"), ("8", ""), ("9", "b"), ("None", "c")]


def test_near_stage_keeps_the_smallest_id_of_each_component(spark):
    docs = stage(spark, "exact_dedup", documents(spark))
    kept = {i for i, _, _, k in brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if k}
    assert rows(stage(spark, "minhash_near_dedup", docs)) == sorted(str(r) for r in docs.collect() if r.doc_id in kept)


def test_secret_stage_masks_and_keeps_every_row(spark):
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = {r.doc_id: r for r in stage(spark, "secret_scan", docs).collect()}
    changed = 0
    for r in docs.collect():
        assert got[r.doc_id].text == mask(r.text) and got[r.doc_id].n_chars == len(mask(r.text))
        changed += got[r.doc_id].text != r.text
    assert changed > 0 and len(got) == docs.count()


def test_awkward_rows_and_an_empty_table_go_through(spark):
    for docs in (awkward(spark), awkward(spark).limit(0)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, DATA)
            assert out.columns == docs.columns, name
        pieces = stage(spark, "packing", docs)
        assert pieces.columns[0] == "doc_id"
    kept = stage(spark, "exact_dedup", awkward(spark)).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept) == sorted([("2", "a pla"), ("4", ""), ("5", " \t\n"), ("6", "A Pla"), ("7", kept_text(spark)), ("8", "one t")])


def kept_text(spark):
    return awkward(spark).filter("doc_id = 7").first().text[:5]


def test_run_packs_what_the_stages_keep(spark):
    docs = documents(spark)
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, DATA).collect(), docs.schema)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(PACK_TOKENIZER))
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {}
    for r in corpus_pipeline.run(spark, DATA).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
