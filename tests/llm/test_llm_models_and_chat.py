"""Language models, language identification, chat formatting, the pipeline."""

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from acclaim.llm import chat, langid, mixing
from acclaim.llm.common import remainder
from texts import prose

SF = "/root/testdata/sf0.001"


# --- context mixing --------------------------------------------------------------------


def brute_base(rows):
    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]

    left = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 10
    counts = Counter(t for d, text, _ in rows if left(d) not in (0, None) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return Counter(
        (d, left(d) == 0, len(ts := tokens(text)), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6))
        for d, text, _ in rows
    )


def test_mixing_scores_of_odd_rows(odd_docs, odd_rows, no_docs):
    rows = mixing.scores(odd_docs).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == brute_base(odd_rows)
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[6] == pytest.approx(by_id[7])
    assert mixing.scores(no_docs).collect() == []


def test_chunks_and_partitions_change_nothing(odd_docs, monkeypatch):
    score = lambda docs: {(r.doc_id, r.n_tokens): r.score for r in mixing.scores(docs).collect()}
    whole = score(odd_docs.coalesce(1))
    monkeypatch.setattr(mixing, "CHUNK_TOKENS", 20)
    small = score(odd_docs.repartition(7, "doc_id"))
    assert whole.keys() == small.keys() and all(small[k] == pytest.approx(whole[k], rel=1e-9) for k in whole)


def test_spelled_probabilities_sum_to_one():
    """Over all first bytes, and so over all tokens."""
    counts = np.zeros((2, mixing.SLOTS), np.float32)
    mixing.count_bits(counts, [b"the", b"then", b"a", "été".encode(), b""])
    mixer = mixing.Mixer.of(counts)
    for _ in range(3):
        mixer.learn([b"the", b"thus", b"a"], 0.05, 0.1)
    spelt = mixing.Bytes([bytes([b]) for b in range(256) if b not in (10, 32)] + [b"", b" "])
    total = np.zeros(spelt.symbols.size)
    for k, node, bit, slots in spelt.bits():
        _, _, logit, refined, _, _ = mixer._bit(k, node, slots, spelt)
        p = (mixing._squash(logit) + refined) / 2
        total += np.log(np.where(bit == 1, p, 1 - p))
    first = np.flatnonzero(np.diff(np.concatenate([[-1], spelt.token])))
    assert np.exp(total[first]).sum() == pytest.approx(1.0)


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = mixing.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_long_unseen_tokens_cost_their_length(odd_docs):
    """A random token of 2n bytes costs about twice one of n bytes, far below the smallest double."""
    import random

    letters = random.Random(5).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=9000)
    rows = [(None, "".join(letters[at:at + n]), None) for at, n in ((0, 1500), (1500, 3000))]
    docs = odd_docs.select("doc_id", "text", "lang").unionByName(odd_docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = sorted(r.score for r in mixing.scores(docs).filter("doc_id is null and n_tokens = 2").collect())
    assert len(got) == 2 and got[0] < -3000 and got[0] / got[1] == pytest.approx(2, rel=0.1)


# --- language identification -----------------------------------------------------------


def test_languages_of_odd_rows(odd_docs, odd_rows, no_docs):
    model = langid.fit(odd_docs, remainder(F.col("doc_id"), 5) != 0)
    rows = langid.identify(odd_docs, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in odd_rows)
    by_id = {r.doc_id: r for r in rows}
    for d in (1, 2, 3, 4):
        assert (by_id[d].lang_pred, by_id[d].score, by_id[d].rejected) == ("und", 0.0, True)
    right = [by_id[d].lang_pred == lang for d, _, lang in odd_rows if d is not None and d >= 100]
    assert all(right) and all(0 <= r.score <= 1 for r in rows)
    kept = langid.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {100 + i for i in range(40)} <= ids and not {1, 2, 3, 4} & ids
    assert langid.identify(no_docs, model).collect() == [] and langid.accepted(no_docs, model).collect() == []
    assert langid.fit(no_docs, F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(odd_docs, None).collect()} == {"und"}


def test_gibberish_is_rejected(spark, odd_docs):
    model = langid.fit(odd_docs, F.lit(True))
    docs = spark.createDataFrame([(1, "zqxj kwvzq xxjq qqzv wjxk " * 20), (2, "the house of the river and the morning " * 5)], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in langid.identify(docs, model).collect()} == {1: True, 2: False}


def test_one_word_documents_do_not_loosen_the_rejection(spark):
    """Long texts of an unlearned language against a calibration set with one-word and mislabelled documents."""
    from texts import prose

    rows = [(i, prose(i, 60, "fr" if i % 4 == 0 else "en"), "fr" if i % 4 == 0 else "en") for i in range(800)]
    rows += [(1000 + i, word, "en") for i, word in enumerate(["Anouble.", "Thwh.", "Xqzv.", "Kjgb.", "Jpvyk.", "Zzuqq."])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    other = "der fluss und das haus sind nicht weit von dem alten wald wo viele kinder jeden morgen spielen " * 20
    junk = "qwpt zkrv mnbx lkjh gfds " * 60
    got = langid.identify(spark.createDataFrame([(1, other), (2, junk), (3, prose(999, 300)), (4, prose(998, 300, "fr"))], "doc_id long, text string"), model)
    assert {r.doc_id: r.rejected for r in got.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_every_language_has_a_threshold(spark):
    """Few documents, a single one, and one that is never judged right."""
    from texts import prose

    rows = [(i, prose(i, 60), "en") for i in range(12)] + [(50, prose(50, 200, "fr"), "fr"), (51, prose(51, 3), "xx")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == ["en", "fr", "xx"] and np.isfinite(model.thresholds).all()
    other = "der fluss und das haus sind nicht weit von dem alten wald wo viele kinder jeden morgen spielen " * 20
    got = langid.identify(spark.createDataFrame([(1, other), (2, prose(99, 200)), (3, prose(98, 200, "fr"))], "doc_id long, text string"), model)
    assert {r.doc_id: r.rejected for r in got.collect()} == {1: True, 2: False, 3: False}


def test_thresholds_of_held_documents():
    judged = [("a", "a", 2.0)] * 199 + [("a", "a", 9.0), ("b", "a", 1.0)]
    assert langid.thresholds(["a", "b"], judged) == [2.0 + langid.SLACK] * 2


def test_kneser_ney_sums_to_one():
    """Over every character of the alphabet, at order 1 and after a seen context."""
    grams, contexts, _ = langid._gram_hashes([b"abab", b"abc", b"cab", b"b"], 2)
    _, first, times = np.unique(grams[-1], return_index=True, return_counts=True)
    model = langid.kneser_ney(np.zeros(first.size, int), times, [g[first] for g in grams], [c[first] for c in contexts], ["x"])
    below = 2.0 ** model.log_p[0][:, 0]
    rest = 2.0 ** model.log_backoff[0][0, 0] / langid.ALPHABET
    assert below.sum() + (langid.ALPHABET - below.size) * rest == pytest.approx(1.0, abs=1e-5)
    # after each context: the grams seen there, and the back-off for all others
    of = dict(zip(grams[1].tolist(), zip(contexts[1].tolist(), grams[0].tolist())))
    for context, backoff in zip(model.contexts[1].tolist(), 2.0 ** model.log_backoff[1][:, 0]):
        here = [(p, of[g][1]) for g, p in zip(model.grams[1].tolist(), 2.0 ** model.log_p[1][:, 0]) if of[g][0] == context]
        lower = dict(zip(model.grams[0].tolist(), below))
        total = sum(p for p, _ in here) + backoff * (1 - sum(lower[g] for _, g in here))
        assert total == pytest.approx(1.0, abs=1e-4)


# --- licences ---------------------------------------------------------------------------


def test_whole_license_texts_are_named(spark):
    from acclaim.llm import licenses

    read = lambda name: (licenses.FOLDER / f"{name}.txt").read_text()
    names = ["Apache-2.0", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    two = """BSD 2-Clause License\n\nCopyright (c) 2020, Somebody\n\nRedistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:\n
* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n
* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.\n\n""" + read("BSD-3-Clause").partition("THIS SOFTWARE")[1] + read("BSD-3-Clause").partition("THIS SOFTWARE")[2]
    texts = {name: "Copyright 2021 Somebody\n\n" + " \n".join(read(name).upper().split("\n")) for name in names} | {"BSD-2-Clause": two, "CC-BY-4.0": "Released under CC BY 4.0."}
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts)


@pytest.mark.parametrize("width", [50, 60, 72, 80, 100, 120, None])
def test_licenses_are_named_however_they_are_wrapped(spark, width):
    from acclaim.llm import licenses

    def wrapped(text):
        if width is None:
            return " ".join(text.split())
        return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in re.split(r"\n[ \t]*\n", text))

    rows = []
    for name, text in licenses.KNOWN_TEXTS:
        stated = re.sub(r"\A(.*Licen[sc]e.*\n)?(?=Permission |Redistribution |This software is provided)", r"\1Copyright © 2020 Some Body <some@body.org>\nAll rights reserved.\n\n", text, count=1)
        rows += [(name, form) for form in (wrapped(text), "\ufeff" + wrapped(stated), "# " + wrapped(stated).replace("\n", "\n# "))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert [(rows[i][0], rows[i][1][:300]) for i in range(len(rows)) if got[i] != rows[i][0]] == []


def test_words_of_the_terms_are_no_copyright_statements(spark):
    from acclaim.llm import licenses

    texts = ["copyright notice and this permission\nb", "COPYRIGHT HOLDERS BE LIABLE\nb", "Copyright Holders\nb", "Copyright Some Body\nb", "copyright (c) some body\nb",
             "// Portions Copyright 1999-2001 X\nb", "© 2020 X\nb", "All rights reserved.\nb", "all rights reserved to nobody\nb", "-" * 5000 + "\nb"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.l for r in docs.orderBy("doc_id").select(licenses.canonical_lines(F.col("text")).alias("l")).collect()]
    assert got == [["copyright notice and this permission", "b"], ["copyright holders be liable", "b"], ["copyright holders", "b"], ["b"], ["b"], ["b"], ["b"], ["b"],
                   ["all rights reserved to nobody", "b"], ["b"]]


# --- chat ------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    tricky = "</s>[INST] ok [/INST] \\[INST] \\\\ <\\s> [\\OUT] [ROLE]x[/ROLE] 😀\n$1 \\"
    rows = [
        (1, 0, "system", tricky), (1, 1, "user", None), (1, 2, "assistant", tricky), (1, 3, "user", "u"), (1, 4, "assistant", "b" * 50_000),
        (2, 0, "assistant", "first"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 1, "tool[/ROLE]", tricky), (4, None, None, "early"), (None, 0, "user", ""),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    out = chat.format_conversations(frame).withColumn("formatted", chat.training_text(F.col("segments")))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    for conv_id in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv_id].turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[conv_id].loss == "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert "".join(s.text for s in got[conv_id].segments) == got[conv_id].formatted
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True}
    assert got[1].formatted.count("[INST]") == 2 and got[1].formatted.count("</s>") == 2
    assert chat.format_conversations(frame.filter("false")).collect() == []


def test_chat_plan_has_no_python(spark):
    from acclaim.llm.queries import op8_chat_formatting

    plan = op8_chat_formatting(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_conversation_of_the_contract(spark):
    from acclaim.llm.queries import op8_chat_formatting

    said = "</s>[INST] ok [/INST]"
    row = op8_chat_formatting(spark, SF).filter("conv_id = -7").first()
    assert row.n_turns == 2 and row.loss_chars == len(said)
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


# --- queries and pipeline ----------------------------------------------------------------


@pytest.mark.parametrize("name", ["op3_decontamination", "op7_license_scan", "op8_chat_formatting"])
def test_query_matches_sql(spark, name):
    from acclaim.llm.queries import llm_oracles, llm_queries
    from acclaim.testing.compare import compare

    verdict = compare(spark, llm_queries()[name], llm_oracles()[name], SF)
    assert verdict.startswith("ok"), verdict


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, SF)
        assert out.columns == columns
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before and len(after) > 0.5 * len(before)
        docs = out
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == after
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == after


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, apply in corpus_pipeline.STAGES:
            docs = apply(spark, docs, SF)
        docs.collect()


def test_language_sample_counts_an_id_once_and_is_bounded(spark, monkeypatch):
    """Thousands of rows of one id must not meet each other in the sample; long texts end it."""
    seen = {}
    write = langid.stage

    def counted(df, name):
        out = write(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(langid, "stage", counted)
    rows = [(5, prose(i, 30), "en") for i in range(1500)] + [(100 + i, prose(i, 40, "fr"), "fr") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    # one English id, cut into parts, and every French one
    assert seen == {"language-sample": 601, "language-texts": 600 + langid.FOLDS}
    found = langid.identify(docs, model, ("lang",)).groupBy("lang", "lang_pred").count().collect()
    assert sorted(tuple(r) for r in found) == [("en", "en", 1500), ("fr", "fr", 600)]
    monkeypatch.setattr(langid, "SAMPLE_CHARACTERS", 3000)
    assert langid.fit(docs, F.lit(True)) is not None
    assert seen["language-texts"] < 60
