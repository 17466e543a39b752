"""The pipeline's stages, one after another, against plain versions."""

import hashlib

import corpus_pipeline as p
import public_tokenizers
import sentencepiece

from tests.llm.conftest import ODD


def test_stages(spark, docs, tmp_path):
    shared = "a passage of quite a few words that two documents share"
    long = " ".join(f"word{k}" for k in range(120))
    rows = [(k, f"document number {k} has its own words\nand a second line {k}", "en", f"s{k % 3}") for k in range(30)]
    rows += [(100, f"{shared}\nfirst", "en", "s0"), (101, f"{shared}\nsecond", "en", "s1"), (102, long, "en", "s1"), (103, long + " more", "en", "s2"), (104, "99 --", "en", "s0")]
    rows += [(105, long + "".join(f" other{k}" for k in range(20)), "en", "s0"), (106, long + "".join(f" foreign{k}" for k in range(40)), "en", "s0")]
    frame = docs(rows)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    kept = p.language_filter(spark, frame, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {104}
    lines = p.line_dedup(spark, kept, str(tmp_path))
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert texts[101] == "second" and texts[100] == f"{shared}\nfirst" and all(texts[k] == rows[k][1] for k in range(30))
    left = p.near_dedup(spark, lines, str(tmp_path))
    ids = {r.doc_id for r in left.collect()}
    assert 102 in ids and 106 in ids and not ids & {103, 105} and len(ids) == len(texts) - 2
    mixed = p.source_mix(spark, left, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} <= ids and all(mixed.groupBy("doc_id").count().where("count > 3").isEmpty() for _ in [0])
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in p.run(spark, str(tmp_path)).collect():
        assert r.ids == model.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_odd_and_empty(spark, docs, tmp_path):
    for name, rows in (("odd", ODD), ("none", [])):
        folder = str(tmp_path / name)
        docs(rows, extra=True).write.parquet(f"{folder}/documents.parquet")
        frame = spark.read.parquet(f"{folder}/documents.parquet")
        kept = [r.text for r in p.language_filter(spark, frame, folder).collect()]
        assert sorted(kept, key=str) == sorted([t for _, t in rows if t and any(map(str.isalpha, t))], key=str)
        out = p.run(spark, folder).collect()
        assert {r.n_tokens > 0 for r in out} <= {True}
    unlabelled = docs([(k, t, None, "s") for k, t in ODD])
    assert p.language_filter(spark, unlabelled, "").count() == len(ODD)
    assert p.near_dedup(spark, docs(ODD), "").count() == len(ODD) - 2  # 7 and the two rows of 8 are equal
    rows = [(None, "words without a number " * 80), (1, "words " * 320), (1, "other words " * 160), (2, None), (3, " ")]
    mixed = p.source_mix(spark, docs(rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in mixed) == [(0, rows[0][1]), (1, rows[2][1]), (1, rows[1][1])]


def test_language_decides(spark, docs):
    """Texts in a learned language stay; letters that are of none go by the network's score, not by a rule on characters."""
    rows = [(k, " ".join(f"{'the and of' if k % 2 else 'und der das'} {w}" for w in ("river", "house", "garden", "stone") * 6), ("en" if k % 2 else "de"), "s") for k in range(80)]
    net = p.train_language_net(docs(rows))
    scored = {r.doc_id: r for r in p.predict_language(docs(rows), net).collect()}
    assert all(scored[k].lang_pred == rows[k][2] and scored[k].score >= p.LEAST_SCORE for k in scored)
    old, p.LEAST_SCORE = p.LEAST_SCORE, 1.01
    try:
        assert p.language_filter(spark, docs(rows), "").count() == 0
    finally:
        p.LEAST_SCORE = old
    assert p.language_filter(spark, docs(rows), "").count() == len(rows)


def test_decodes(spark, docs):
    rows = [(1, None), (2, ""), (3, " two  spaces\nand 日本 \x00 "), (4, "an ordinary text")]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {k: t or "" for k, t in rows}
    got = p.encode(spark, docs(rows), "").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(model.decode(list(r.ids)).encode()).hexdigest() == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
