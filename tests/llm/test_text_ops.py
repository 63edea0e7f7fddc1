"""Rules, tokens, mixing, chat, classifiers and fingerprints."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from regula.llm import chat, langid, mixing, quality, sentencepiece_codec, syncmers, toxicity
from regula.llm.queries import ORACLES, QUERIES
from regula.sources.parquet import read_table
from tests.conftest import SF_SMALL
from tests.llm import cases

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = QUERIES[name](spark, SF_SMALL)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want


def test_repeated_words_and_counts():
    import pyarrow as pa
    got = quality.count_slice(pa.array(["a b c a b c d", "x\nx\n y \ny", None, "#!é"]))
    assert got["n_words"].tolist() == [7, 4, 0, 1] and got["n_repeat_words"].tolist() == [6, 0, 0, 0]
    assert got["word_chars"].tolist() == [7, 4, 0, 3] and got["n_symbols"].tolist() == [0, 0, 0, 1]
    assert got["n_dup_lines"].tolist() == [0, 1, 0, 0] and got["n_shouts"].tolist() == [0, 0, 0, 1]


def test_quality_awkward(spark):
    docs = cases.awkward(spark)
    judged = quality.judge(docs).select("row.doc_id", "n_words", "base_failed", "kept").collect()
    assert len(judged) == 13
    assert all(r["base_failed"] and not r["kept"] for r in judged if r["doc_id"] in (4, 5, 6, 8, 9))
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and {1, 2, 3, 7} <= {r["doc_id"] for r in kept.collect()}
    assert quality.quality_filter(cases.empty(spark)).count() == 0


def test_bucket_is_monotone_and_narrow(spark):
    rows = spark.range(0, 5000).select(F.col("id").alias("v"), quality.bucket_of("id").alias("b")).orderBy("v").collect()
    buckets = [r["b"] for r in rows]
    assert buckets == sorted(buckets) and all(r["b"] <= r["v"] <= r["b"] * (1 + 2.0 ** -quality.SUB_BITS) for r in rows)


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_quality_fences_follow_the_spread(spark):
    """Groups whose usual word length differs get fences of their own; a measure
    that is usual in a group is not held against it."""
    rnd = random.Random(5)
    rows = []
    for i in range(1200):
        long = i % 2
        body = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 7) + 6 * long)) for _ in range(80)]
        if i % 3 == 0:
            body = [w + " |" if j % 2 else w for j, w in enumerate(body)]  # tables: the usual symbols
        spam = i % 60 == 1
        rows.append((i, " ".join(w + "%%%" if spam else w for w in body), "en", "long" if long else "short"))
    judged = quality.judge(_corpus(spark, rows), carry=["doc_id", "lang", "source"])
    kept = {r["doc_id"]: r["kept"] for r in judged.select("row.doc_id", "kept").collect()}
    assert all(kept[i] == (i % 60 != 1) for i in kept)
    whole = quality.judge(_corpus(spark, rows)).select("row.doc_id", "kept").collect()
    assert {r["doc_id"]: r["kept"] for r in whole} == kept


def test_quality_blends_small_groups(spark):
    """One odd document alone in its source is measured by its language."""
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    rows = [(i, " ".join(word(rnd.randrange(3, 7)) for _ in range(80)), "en", "big") for i in range(300)]
    rows += [(1000, " ".join(word(40) for _ in range(80)), "en", "tiny"), (1001, " ".join(word(5) for _ in range(80)), "en", "tiny")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(_corpus(spark, rows)).select("row.doc_id", "kept").collect()}
    assert not kept[1000] and kept[1001] and all(kept[i] for i in range(300))


def test_quality_learned_spreads_decide(spark):
    docs = spark.read.parquet(f"{SF_SMALL.replace('sf0.001', 'sf0.01')}/documents.parquet")
    measured = quality.with_measures(quality.measure_documents(docs, carry=["lang", "source"])).select("row.*", *quality.MEASURES, "base_failed")
    rows = quality.spreads(quality.group_sketches(measured)).where("measure <> 'shout_rate'").collect()
    assert sum(r["spread"] >= quality.LEAST_SPREAD[r["measure"]] for r in rows) > len(rows) / 2


def test_sentencepiece_awkward(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = cases.awkward(spark).withColumnsRenamed({"row": "ids", "key": "span_begin"})
    got = sentencepiece_codec.encode_documents(docs, MODEL).collect()
    want = sorted((r["doc_id"] or -1, sp.encode(r["text"] or "", add_eos=True)) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, list(r["ids"])) for r in got) == want
    assert sentencepiece_codec.encode_documents(cases.empty(spark), MODEL).count() == 0


def test_sentencepiece_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(2)
    alphabet = [" ", "  ", "\n", "\t", "a", "the", "é", "▁", "😀", "<s>", "</s>", "<0x41>", "中", "\r", "ﬁ", "ing", " \n", "\n ", "Ⅷ"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(800)] + ["", None, cases.words(20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentencepiece_codec.encode_documents(docs, MODEL).collect():
        t = texts[r["doc_id"]] or ""
        ids = sp.encode(t, add_eos=True)
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        spans = [(p.begin, p.end) for p in sp.encode(t, return_type="proto").pieces]
        if not any(sp.is_byte(i) for i in ids):
            assert list(zip(r["span_begin"], r["span_end"]))[:-1] == spans
        assert r["span_end"][-1] == len(t.encode())
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs, MODEL), MODEL)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: sp.decode(sp.encode(t or "")) for i, t in enumerate(texts)}


def test_sentencepiece_workers_keep_one_copy_of_a_cut():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = sentencepiece_codec.Codec(MODEL)
    texts = [cases.words(300) + "\nnext  line ", "plain", "odd \U0001f9ff\U0001f9ff cut and \x07 more", "plain odd \U0001f9ff\U0001f9ff"]
    for t, (ids, _, _, written, decoded) in zip(texts, codec.encode(texts)):
        want = sp.encode(t)
        assert ids.tolist() == want and written == " ".join(map(str, want)) and decoded == sp.decode(want)
    plain = sentencepiece_codec.Codec(MODEL)
    plain.encode(texts[:2])
    assert plain._ids and not plain._surface
    assert sentencepiece_codec.SLICE_BYTES <= 1 << 20


def test_longest_prefix_of_a_character_map():
    """A hand-made double array that maps "ab" to "X" and "a" to "yy"."""
    units = [0] * 512

    def leaf(value):
        return value | 1 << 31

    root, after_a, after_b = 256, 256 ^ ord("a") ^ 128, 0
    units[0] = root << 10
    units[root ^ ord("a")] = ((root ^ ord("a")) ^ (128)) << 10 | 1 << 8 | ord("a")
    units[128] = leaf(0)
    units[128 ^ ord("b")] = ((128 ^ ord("b")) ^ 300) << 10 | 1 << 8 | ord("b")
    units[300] = leaf(3)
    import struct
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"yy\0X\0"
    rules = sentencepiece_codec.Rules(blob, dummy_prefix=True, squeeze=True, mark_spaces=True)
    text, align = sentencepiece_codec.Normaliser(rules)(" ab  ac ")
    assert text == "▁X▁yyc"
    assert align.tolist() == [1, 1, 1, 1, 3, 3, 3, 5, 5, 6, 8]


def test_mixing_awkward(spark):
    docs = cases.awkward(spark)
    plan = mixing.mix_plan(docs)
    rows = plan.collect()
    assert len(rows) == 13 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for group in by.values():
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= 0.5
    total = sum(r["size"] for r in rows)
    assert sum(g[0]["target"] for g in by.values()) == pytest.approx(1.5 * total)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in rows)
    assert sorted(map(tuple, plan.collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixing.mix_plan(cases.empty(spark)).count() == 0


def test_chat_round_trip_and_states(spark):
    rows = [(1, 0, "system", "be\\ <s>"), (1, 1, "user", "[INST]\\"), (1, 2, "assistant", "\\</s>\\\\[/INST]"), (2, 0, "assistant", "x"),
            (3, 0, "user", None), (3, 0, "robot<s>", "a"), (None, 1, None, "q"), (None, None, "user", "<|role|>"), (4, 1, "user", "b"),
            (4, 1, "user", "b"), (5, 0, "user", "u"), (5, 1, "assistant", "")]
    table = spark.createDataFrame([(*r, "clash", True) for r in rows], "conv_id long, turn long, role string, text string, segment string, loss boolean")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_segments(table)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, r in got.items():
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c]["valid"] for c in (1, 2, 3, 4, 5, None)] == [True, False, False, False, True, False]
    assert chat.read_back(chat.format_segments(table.limit(0))).count() == 0


def test_fingerprints(spark):
    docs = cases.awkward(spark)
    got = syncmers.fingerprint_edits(docs)
    rows = got.collect()
    assert len(rows) == 13
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ring = sorted(i for i in texts if i is not None)
    for r in rows:
        if r["doc_id"] is None:
            continue
        t, follow = texts[r["doc_id"]], texts[ring[(ring.index(r["doc_id"]) + 1) % len(ring)]]
        edited = t[:len(t) - len(t) // 2] + follow[:len(t) // 2]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1 and by[5]["fingerprint"] == ""
    assert syncmers.fingerprint_edits(cases.empty(spark)).count() == 0


def test_toxicity_held_out(spark):
    rnd = random.Random(0)
    docs, labels = [], []
    for i in range(900):
        toxic = int(rnd.random() < 0.3)
        body = [f"w{rnd.randrange(300)}" for _ in range(40)]
        if toxic:
            for _ in range(3):
                body[rnd.randrange(40)] = rnd.choice(["idiot", "moron", "1diot", "you idiot"])
        docs.append((i, " ".join(body)))
        labels.append((i, toxic))
    got = toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(labels, "doc_id long, toxic int"), trees=5).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert len(got) == 900 and held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def _toxicity_features(texts, lexicon):
    hashes = toxicity.word_hashes(lexicon)
    order = np.argsort(hashes)
    weights = np.arange(1.0, len(lexicon) + 1)[order]
    rows = toxicity.features(pa.array(texts, pa.string()), hashes[order], weights, np.sort(toxicity.word_hashes(["you"])))
    return [dict(zip(toxicity.FEATURES, r)) for r in rows]


def test_toxicity_densest_window_matches_brute_force():
    rnd = random.Random(1)
    rows = np.sort([rnd.randrange(6) for _ in range(400)])
    weights = np.array([rnd.choice([0, 0, 0, 1.5, 2.0]) for _ in rows])
    most, heaviest = toxicity.densest(rows, weights, 7, 10)
    for t in range(7):
        mine = weights[rows == t]
        spans = [mine[i:i + 10] for i in range(len(mine))] or [mine]
        assert most[t] == max((s > 0).sum() for s in spans) and abs(heaviest[t] - max(s.sum() for s in spans)) < 1e-9


def test_toxicity_window_keeps_a_passage_of_a_long_text():
    passage = "idiot moron idiot"
    short, long = _toxicity_features([passage, "plain words here " * 5000 + passage + " more of it" * 5000], ["idiot", "moron"])
    assert short["window_hits"] == long["window_hits"] == 3 and short["window_weight"] == long["window_weight"] == 4
    assert long["hit_rate"] < 0.02


def test_toxicity_undoes_look_alikes_before_end_marks():
    for word in ("1d1ot", "1d1ot!", "1d1ot!!!", "(1d1ot),", "id!ot", "!d!ot!?"):
        found, = _toxicity_features([f"a {word} b"], ["idiot"])
        assert found["hidden_count"] > 0, word
    clean, = _toxicity_features(["a ! b !! c?"], ["idiot"])
    assert clean["hidden_count"] == 0 and clean["window_hits"] == 0


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (7, 5)], "doc_id long, toxic int")
    got = toxicity.score_documents(cases.awkward(spark), labels).collect()
    assert len(got) == 13 and all(r["score"] in (0.0, 1.0) for r in got)
    assert toxicity.score_documents(cases.empty(spark), labels.limit(0)).count() == 0


def test_languages_of_the_given_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    truth = docs.where("lang IS NOT NULL AND text RLIKE '[A-Za-z]'").select("doc_id", "lang")
    got = langid.identify(docs).where("held_out").join(truth, "doc_id").agg(
        F.count("*").alias("n"), F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("right")).first()
    assert got["n"] > 100 and got["right"] >= 0.97


def test_language_sample_needs_no_shuffle_of_texts(spark, monkeypatch):
    docs = cases.awkward(spark).withColumn("lang", F.lit("en"))
    plans, repartition = [], type(docs).repartition

    def spy(self, *args):
        plans.append(self._jdf.queryExecution().toString())
        return repartition(self, *args)

    monkeypatch.setattr(type(docs), "repartition", spy)
    langid.learn(docs, 10)
    assert plans and "Join" not in plans[0] and "Exchange" not in plans[0]


def test_language_held_out_and_awkward(spark):
    rnd = random.Random(0)
    syllables = {"x": ["ba", "ke", "lo"], "y": ["ski", "sch", "tz"], "z": ["ção", "nh", "lh"]}
    docs = [(i, " ".join("".join(rnd.choice(syllables[lang]) for _ in range(3)) for _ in range(30)), lang)
            for i in range(300) for lang in [rnd.choice("xyz")]]
    got = langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    truth = {d: lang for d, _, lang in docs}
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    rows = langid.identify(cases.awkward(spark)).collect()
    assert len(rows) == 13 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (4, 5, 6))
    assert langid.identify(cases.empty(spark)).count() == 0
    lost = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert lost["lang_pred"] == "und"


def test_pipeline_runs_and_keeps_columns(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL).cache()
        assert docs.columns == columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert last.count() == docs.count() and 0 < last.select("doc_id").distinct().count() <= n
    empty = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0
