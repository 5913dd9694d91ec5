import random

import brute
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, outs = docs.columns, []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
        outs.append(docs)
    source, told, single, cut, clean = texts(spark.read.parquet(f"{DATA}/documents.parquet")), *map(texts, outs[:4])
    assert len(told) >= 0.97 * len(source) and all(source[k] == v for k, v in told.items())
    groups = brute.components(list(told.items()), 5, 80, 100)
    assert single == {k: told[k] for k in {c for _, c in groups.values()}}
    ids = sorted(single)
    left = {k: b.decode(errors="ignore") for k, (_, _, b) in zip(ids, brute.duplicated([single[k] for k in ids], 240), strict=True)}
    assert cut == {k: v for k, v in left.items() if v or not single[k]}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {k for k, v in brute.decontaminated(list(cut.items()), items).items() if v[4]}
    assert bad and clean == {k: v for k, v in cut.items() if k not in bad}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in outs[4].orderBy("doc_id", "start").collect():
        pieces.setdefault(r["doc_id"], []).extend(r["ids"])
    assert pieces == {k: tokenizer.encode(v, add_special_tokens=False).ids + [1] for k, v in clean.items()}


def test_run_and_odd_rows(spark, tmp_path):
    assert pipeline.run(spark, DATA).count() > 0
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "plain words of a text", "en", "a", 21), (3, "plain words of a text", "en", "a", 21), (None, "null key text of words", "en", None, None), (5, "é" * 500, "fr", "b", 500), (6, "x" + "é" * 300, "fr", "b", 301)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            stage(spark, some, DATA).collect()
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.drop_repeated_strings(spark, docs, DATA).collect()}
    assert 5 not in cut and cut[6] == ("x", 1) and cut[2] == ("", 0)


def test_replacement_characters_of_the_text_stay(spark):
    common = "".join(f"{i:04d}" for i in range(100))
    rows = [(1, "q\ufffd\x01B é" + common), (2, "w\x01A ũ" + common + "\ufffd"), (3, "\ufffd whole")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i: b.decode(errors="ignore") for (i, _), (_, _, b) in zip(rows, brute.duplicated([t for _, t in rows], 240), strict=True)}
    assert want == {1: "q\ufffd\x01B ", 2: "w\x01A \ufffd", 3: "\ufffd whole"}
    assert texts(pipeline.drop_repeated_strings(spark, docs, DATA)) == want


def test_passages_of_over_fifty_words_go_and_clean_text_stays(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows, passages = [], []
    for i in range(40):
        passages.append(words(rng.randint(51, 60)))
        for j in range(2 + i % 3):
            rows.append((len(rows), f"{words(30)}. {passages[-1]}. {words(30)}"))
    clean = [(1000 + i, words(120)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows + clean], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = texts(pipeline.drop_repeated_strings(spark, docs, DATA))
    assert not [p for p in passages if any(p in t for t in got.values())]
    assert all(len(got[i].split()) in (59, 60, 61, 62) for i, _ in rows)
    assert {i: got[i] for i, _ in clean} == dict(clean)


def test_columns_with_clashing_names_stay(spark):
    names = ["copies", "digest", "found", "hit", "told", "size", "kept", "n_hit", "key", "token", "lang_pred", "n_removed", "row", "__hit", "__lang", "a.b"]
    rows = [(i, f"some plain words number {i} of a text", "en", "a", 1, *range(len(names))) for i in range(1200)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for _, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {tuple(range(len(names)))}
    pipeline.pack(spark, docs, DATA).collect()


def test_documents_without_labels_stay(spark):
    docs = spark.createDataFrame([(1, "plain words", None), (2, "12 !", None), (3, None, None), (4, "", None), (5, "mots", None)], "doc_id long, text string, lang string")
    out = pipeline.identify_language(spark, docs, DATA)
    assert out.columns == docs.columns and texts(out) == {1: "plain words", 5: "mots"}
