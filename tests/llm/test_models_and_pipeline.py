"""Held-out accuracy of the trained models; the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import decontaminate, language_id, near_duplicates, queries, quality, secrets

from test_similarity import windows
from test_text_operators import plain_spans

DATA = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    got = queries.op3_language_id(spark, DATA)
    rows = got.join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    docs += [(100, None, "en"), (101, "12 %% 3", "en"), (102, "", None), (103, "²", None), (104, "der und die " * 20_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.col("doc_id") < 40)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 100, 101, 102, 103, 104)] == ["en", "de", "und", "und", "und", "und", "de"]
    assert {r.doc_id for r in language_id.accepted(df, model).collect()} >= set(range(40)) | {104}
    nothing = language_id.fit(df.where("false"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_all_languages_are_learned(spark):
    df = spark.createDataFrame([(i, f"word{i % 300} said{i % 300}", f"l{i % 300}") for i in range(600)], "doc_id long, text string, lang string")
    assert sorted(language_id.fit(df, F.lit(True)).langs) == sorted(f"l{i}" for i in range(300))


def test_quality_accuracy(spark):
    got = queries.op1_quality(spark, DATA)
    rows = got.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert got.where("score is null or score < 0 or score > 1").count() == 0


def plain_quality(model, text):
    """The score from the model's arrays, token by token."""
    mean, scale, w1, b1, w2, b2 = model.net
    known = dict(zip(model.names.split("\n"), model.table))
    total, n, last = np.zeros(len(w2)), 0, None
    for token in (text or "").split():
        for term in quality.shape_terms(token) + ([quality.REPEAT] if token == last else []):
            own = known.get(term)
            total += (quality.index_vectors([term])[0] @ (w1 / scale[:, None])[: quality.DIM]) if own is None else own
        last, n = token, n + 1
    logit = float(np.tanh(total / max(n, 1) - mean / scale @ w1 + b1) @ w2 + b2[0])
    return 1 / (1 + math.exp(-logit / model.temperature))


def test_quality_scores_recomputed(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(150)
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), F.col("doc_id") % 2 == 0)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "new new new !!! ÀÉ 12 12"), (-4, "x " * 9000), (-3, "new new new !!! ÀÉ 12 12")], "doc_id long, text string")
    rows = quality.score(docs.unionByName(odd), model).collect()
    assert len(rows) == docs.count() + 5
    for r in rows:
        assert abs(r.score - plain_quality(model, r.text)) < 1e-4


def test_all_terms_of_the_sample_have_context(spark):
    docs = spark.createDataFrame([(i, f"word{i} said once by{i}") for i in range(300)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"), F.lit(True))
    assert {quality.shape_terms(f"word{i}")[0] for i in range(300)} <= set(model.names.split("\n"))


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good plain words here" if i % 2 else "%%% ### !!!") for i in range(60)] + [(70, None), (71, ""), (72, "x " * 50_000), (1, "%%%")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(70, None), (71, 7), (None, 1), (1, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect() if r.text != "%%%"}
    assert got[1] > 0.5 > got[0] and 0 <= got[70] <= 1 and got[70] == got[71]
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("false"), F.lit(True))).collect()} == {0.5}
    assert quality.fit(docs.where("false"), labels, F.lit(True)) is None and quality.score(docs.where("false"), model).count() == 0
    clash = quality.score(docs.withColumn("Score", F.lit("own")), model).first()
    assert clash.Score_in == "own" and 0 <= clash.score <= 1


def plain_language(model, text):
    """Language and score from the model's arrays, n-gram by n-gram."""
    words = language_id.words_of(text or "")
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    rows = []
    for w in words:
        data = b"<" + w + b">"
        for i in range(len(data)):
            code = 2166136261
            for n in range(5):
                if i + n >= len(data):
                    break
                code = ((code ^ data[i + n]) * 16777619) & 0xFFFFFFFF
                if n + 1 >= 2:
                    h = (code * 2654435761) & 0xFFFFFFFF
                    rows.append((((h ^ (h >> 15)) * 2246822519) & 0xFFFFFFFF) >> (32 - model.bits))
    logits = (sum((model.logits[r].astype(float) for r in rows), np.zeros(len(model.langs))) / max(1, len(rows)) + model.bias) / model.temperature
    p = np.exp(logits - logits.max())
    p /= p.sum()
    return model.langs[int(p.argmax())], float(p.max())


def test_language_scores_recomputed(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").orderBy(F.length("text")).limit(120)
    model = language_id.fit(docs, F.col("doc_id") % 3 != 0)
    odd = spark.createDataFrame([(-1, None, None), (-2, "12 !", "en"), (-3, "né à ßtraße ßtraße", "de"), (-3, "né à ßtraße ßtraße", "de")], "doc_id long, text string, lang string")
    both = docs.unionByName(odd).withColumns({"Lang_Pred": F.lit("x"), "SCORE": F.lit("y")})
    rows = language_id.identify(both, model).collect()
    assert len(rows) == 124 and {(r.Lang_Pred_in, r.SCORE_in) for r in rows} == {("x", "y")}
    for r in rows:
        lang, score = plain_language(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4
    assert language_id.identify(docs.where("false"), model).count() == 0
    assert language_id.fit(docs.unionByName(docs), F.lit(True)).langs == sorted({r.lang for r in docs.collect()})


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, stages):
    source, told, single, clean, safe, coded = stages
    for df in (told, single, clean, safe):
        assert df.columns == source.columns
    assert told.count() >= 0.99 * source.count()
    groups = near_duplicates.near_duplicates(told)
    assert single.count() == groups.where("kept").count() < told.count()
    assert near_duplicates.near_duplicates(single).where("not kept").count() == 0
    assert clean.join(single, "doc_id", "left_anti").count() == 0 and clean.count() < single.count()
    assert safe.count() == clean.count()
    assert secrets.secret_digests(safe).where("spans != ''").count() == 0
    changed = safe.alias("a").join(clean.alias("b"), "doc_id").where("a.text != b.text").select("doc_id")
    found = secrets.secret_digests(clean).where("spans != ''").select("doc_id")
    assert sorted(r[0] for r in changed.collect()) == sorted(r[0] for r in found.collect()) != []
    assert coded.count() == safe.count() and coded.where("n_tokens != size(token_ids)").count() == 0


def odd_documents(spark):
    """Some documents, repeated rows, ids that are null or have two texts, and columns with clashing names."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = [r.asDict() for r in docs.where("n_chars between 200 and 4000").orderBy("doc_id").limit(60).collect()]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    add = [some[3], some[3], some[5] | {"text": some[9]["text"]}, some[7] | {"doc_id": None}, some[8] | {"doc_id": None, "text": some[8]["text"] + " new words here and there"}]
    add += [some[0] | {"doc_id": 9001, "text": some[0]["text"] + " token=abcdef123456 end"}, some[1] | {"doc_id": 9002, "text": item + " " + some[1]["text"]}, some[2] | {"doc_id": 9003, "text": None}, some[2] | {"doc_id": 9004, "text": ""}, some[2] | {"doc_id": 9005, "text": "123 456 !"}]
    df = spark.createDataFrame(some + add, docs.schema).withColumns({"items": F.lit("a"), "root": F.lit(1), "Score": F.lit(2.0), "lang_pred": F.lit("b"), "secrets": F.lit("c"), "_n_words": F.lit(3)})
    return df, item


def test_stages_equal_brute_force(spark, tmp_path):
    docs, _ = odd_documents(spark)
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    now = docs.repartition(3)
    now.write.parquet(str(tmp_path / "0"))
    now = spark.read.parquet(str(tmp_path / "0"))

    def told(rows):
        model = language_id.fit(now, F.lit(True))
        found = [(r, *plain_language(model, r["text"])) for r in rows]
        return [r for r, lang, score in found if lang != "und" and score >= model.reject_below]

    def single(rows):
        sets = []
        for r in rows:
            w = (r["text"] or "").encode().lower().split()
            sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
        root = list(range(len(rows)))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[top(a)] = top(b)
        groups = {}
        for i, r in enumerate(rows):
            groups.setdefault(top(i), []).append(r)
        return [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]

    def clean(rows):
        known = {w for _, t in items for w in windows(t)}
        out = []
        for r in rows:
            w = decontaminate.words_of((r["text"] or "").encode())
            if not any(tuple(w[i : i + n]) in known for n in range(1, 11) for i in range(len(w) - n + 1)):
                out.append(r)
        return out

    def safe(rows):
        out = []
        for r in rows:
            text, last = r["text"], len(r["text"])
            for _, _, end, begin in sorted(plain_spans(text), key=lambda x: -x[3]):
                assert end <= last
                text, last = text[:begin] + "[redacted]" + text[end:], begin
            out.append(r | {"text": text, "n_chars": len(text)})
        return out

    library = Tokenizer.from_file(queries.vocabulary())

    def coded(rows):
        out = []
        for r in rows:
            ids = library.encode(r["text"], add_special_tokens=False).ids
            out.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "token_ids": ids, "decoded_sha256": hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()})
        return out

    brute = {"language_id": told, "near_duplicates": single, "decontaminate": clean, "secrets": safe, "bpe": coded}
    shown = lambda rows: sorted((tuple(sorted((k, repr(v)) for k, v in r.items())) for r in rows))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        rows = [r.asDict() for r in now.collect()]
        after = stage(spark, now, sf)
        assert name == "bpe" or after.columns == now.columns
        after.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        got, want = [r.asDict() for r in now.collect()], brute[name](rows)
        assert shown(got) == shown(want), name
        assert name == "secrets" or name == "bpe" or len(got) < len(rows), name
    assert [name for name, _ in corpus_pipeline.STAGES] == list(brute)


def test_run_applies_all_stages(spark, tmp_path):
    docs, _ = odd_documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"]
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    same = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.decoded_sha256, r.n_tokens) for r in df.collect())
    assert same(got) == same(now) != []


def test_stages_take_empty_tables_and_more_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).withColumns({"n": F.lit(1), "a": F.lit("x"), "items": F.lit("y"), "root": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), DATA).count() == 0, name
        odd = stage(spark, docs.withColumn("text", F.when(F.col("doc_id") % 5 != 0, F.col("text"))), DATA)
        assert odd.columns == (docs.columns if name != "bpe" else ["doc_id", "n_tokens", "token_ids", "decoded_sha256"]), name
        assert name != "bpe" or odd.count() == 40
