import corpus_pipeline
from factloom.llm.near_dedup import near_duplicate_groups
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        after = docs.count()
        assert docs.columns == corpus_pipeline.COLUMNS and 0 < after <= before, name
        before = after
        if name.startswith("near"):
            groups = brute.near_groups([(r.doc_id, r.text) for r in docs.collect()], 5)
            assert all(kept for _, _, kept in groups.values())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == before and out.where("not round_trip").count() == 0
    assert near_duplicate_groups(docs).where("not kept").count() == 0


def test_stages_keep_rows_of_a_repeated_id_and_pass_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, other = docs.select("text").where("length(text) > 400").limit(2).collect()
    rows = [(1, one.text), (2, one.text), (2, other.text), (None, other.text), (3, None)]
    odd = spark.createDataFrame([(i, t, "en", "s", 1, "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_copies(spark, odd, SF).collect()) == ["1", "2", "2", "3", "None"]
    left = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == corpus_pipeline.COLUMNS and left.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, left, SF).count() == 0


def test_the_last_stage_lets_go_what_others_hold_in_a_worker():
    from factloom.llm import common, sentence_pieces
    from factloom.llm.queries import piece_model

    gone = []
    common.hold("another operator", lambda: gone.append("held"))
    list(sentence_pieces._encoder(piece_model())(iter(())))
    assert gone == ["held"] and set(common._HELD) == {"sentence pieces"}
    # The next task of the same operator keeps what the first one remembers.
    kept = sentence_pieces._paths(piece_model(), sentence_pieces.PATHS)
    list(sentence_pieces._encoder(piece_model())(iter(())))
    assert sentence_pieces._paths(piece_model(), sentence_pieces.PATHS) is kept
    common.release("line dedup")
    assert not common._HELD and sentence_pieces._paths(piece_model(), sentence_pieces.PATHS) is not kept
