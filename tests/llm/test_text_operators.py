"""BPE, language ID, quality and LM scoring: round trips, held-out accuracy and plain recomputation."""

import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from churnforge.llm import bpe, langid, lm, quality
from churnforge.llm.textbatch import held_out
from tests.conftest import SF001, SF01
from tests.llm.brute import sha

LONG = "word " * 40_000 + "x" * 70_000 + " don't 12ab\n\n  end" + " " * 5_000 + "tail\n" + "\n" * 3_000
EDGES = [(1, "Plain text, it's 3 o'clock.", "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n", "x"), (4, "Repeated row", "x"),
         (4, "Repeated row", "x"), (None, "no id é ß 日本語 👍", "x"), (5, LONG, "x"), (6, "<|endoftext|> nul\x00 byte", None),
         (7, "12345 67,8 ...", "x")]


def edges(spark):
    """Rows with nulls, repeats, empty and long texts, and columns whose names operators use inside."""
    return spark.createDataFrame(EDGES, "doc_id long, text string, extra string").select(
        "doc_id", "text", F.lit(1).alias("id"), F.lit("c").alias("block"), F.lit(2.5).alias("score"),
        F.lit("z").alias("lang"), F.lit(3).alias("n_tokens"), F.col("extra").alias("ids"), F.lit(0).alias("label"))


def test_bpe_matches_the_library_and_decodes_back(spark):
    encoder, _ = bpe.codec("byte_bpe_50k.tiktoken")
    assert isinstance(encoder, tiktoken.Encoding)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.bpe_round_trip(edges(spark)).collect())
    want = sorted((i or 0, len(x), np.array(x, "<u4").tobytes(), (t or "").encode())
                  for i, t, _ in EDGES for x in [encoder.encode_ordinary(t or "")])
    assert got == want


def test_bpe_pieces_are_safe_whatever_the_cut():
    encoder, _ = bpe.codec("byte_bpe_50k.tiktoken")
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b'll", " ", "  ", "\n", "1", "!", "'s", "é", "\u00a0", "👍"]) for _ in range(60))
        cut = list(bpe.pieces(text, rng.randint(1, 9)))
        assert "".join(cut) == text
        assert [i for p in cut for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)


def test_bpe_runs_of_white_space(monkeypatch):
    encoder, table = bpe.codec("byte_bpe_50k.tiktoken")
    for text in (" " * 1_000_000 + "a", "a" + "\n" * 1_000_000, "\u3000" * 300_000 + " b " + "\t " * 2_000 + "!"):
        assert b"".join(table[i] for i in bpe.encode(text, encoder, "byte_bpe_50k.tiktoken")) == text.encode()     # no stack overflow
    monkeypatch.setattr(bpe, "LONG_RUN", bpe.re.compile(bpe.LONG_RUN.pattern.replace("1000", "3")))
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "'s", " ", "  ", "\n", "\t\n ", "\xa0", "1", "!", "é", "\u3000", "\x1c"]) for _ in range(1_100))
        assert bpe.encode(text, encoder, "byte_bpe_50k.tiktoken") == encoder.encode_ordinary(text)


def test_bpe_query_and_empty_table(spark):
    from churnforge.llm.catalog import op1_byte_bpe
    rows = op1_byte_bpe(spark, SF001).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    encoder, _ = bpe.codec("byte_bpe_50k.tiktoken")
    assert len(rows) == len(texts)
    for r in rows:
        ids = encoder.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[r["doc_id"]] or ""))
    assert bpe.bpe_round_trip(edges(spark).limit(0)).count() == 0


def test_language_id_is_right_on_held_out_texts(spark):
    from churnforge.llm.catalog import op2_language_id
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = op2_language_id(spark, SF01).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = out.agg(F.count(F.lit(1)), F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert n > 200 and right > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def test_language_id_learns_nothing_from_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (langid.fit_language_model(d, ~held_out("doc_id")) for d in (docs, spoiled))
    assert a.languages == b.languages and np.array_equal(a.log_prob, b.log_prob)


def test_language_id_equals_a_plain_bayes_and_handles_edges(spark):
    config = langid.LanguageIdConfig(buckets=64, evidence=10**9)
    train = spark.createDataFrame([(1, "aab", "p"), (2, "abb ab", "p"), (3, "zzy", "q"), (4, None, "p"), (5, "zz", None)],
                                  "doc_id long, text string, lang string")
    model = langid.fit_language_model(train, F.lit(True), config=config)
    assert model.languages == ["p", "q"]
    counts = {}
    for text, lang in (("aab", 0), ("abb ab", 0), ("zzy", 1)):
        for buckets, _ in langid.grams([text], config):
            for b in buckets:
                counts[b, lang] = counts.get((b, lang), 0) + 1
    want = np.array([[counts.get((b, k), 0) + 0.5 for k in (0, 1)] for b in range(64)])
    assert np.allclose(model.log_prob, np.log(want / want.sum(0)), atol=1e-5)
    df = edges(spark)
    out = langid.identify_language(df, model, config=config, pred_col="_p", score_col="_s")
    assert out.columns == [*df.columns, "_p", "_s"]
    got = {(r["doc_id"], r["text"]): (r["_p"], r["_s"]) for r in out.collect()}
    assert all(got[k] == ("und", 0.0) for k in ((2, None), (3, ""), (4, " \t\n"), (7, "12345 67,8 ...")))
    assert got[1, EDGES[0][1]][0] in ("p", "q") and out.count() == len(EDGES)
    nothing = langid.fit_language_model(train.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify_language(df, nothing).collect()} == {"und"}
    assert langid.identify_language(df.limit(0), model).count() == 0


def _auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    p = label.sum()
    return (order[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def test_quality_is_right_on_held_out_texts(spark):
    from churnforge.llm.catalog import op6_quality
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    out = op6_quality(spark, SF01).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 80 and _auc(out["score"].to_numpy(), out["quality"].to_numpy()) > 0.95


def test_quality_scores_are_the_softmax_of_averaged_vectors_and_handle_edges(spark):
    config = quality.QualityConfig(buckets=1 << 10, epochs=2)
    df = edges(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (9, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit_quality_model(df, labels, F.lit(True), config=config)
    out = quality.score_quality(df, model, config=config).collect()
    assert len(out) == len(EDGES) and all(0 <= r["score"] <= 1 for r in out)
    empty = {round(r["score"], 12) for r in out if r["doc_id"] in (2, 3)}
    assert empty == {round(float(1 / (1 + np.exp(-model.bias))), 12)}
    data = np.frombuffer(EDGES[0][1].encode(), np.uint8)
    parts = np.concatenate([b for b, _ in quality.features(data, np.array([0, len(data)]), config)])
    want = 1 / (1 + np.exp(-(model.share[parts].astype(float).mean() + model.bias)))
    assert next(r["score"] for r in out if r["doc_id"] == 1) == pytest.approx(want)
    nothing = quality.fit_quality_model(df, labels.limit(0), F.lit(True), config=config)
    assert {r["score"] for r in quality.score_quality(df, nothing, config=config).collect()} == {0.5}


def test_lm_scores_equal_a_plain_forward_pass(spark):
    config = lm.LMConfig(vocabulary=20, rest=4, classes=6, hidden=5, dim=3)
    model = lm.fit_language_scorer(edges(spark), config=config)
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm.score_documents(edges(spark), model, config=config).collect()}
    assert (2, 0) in got and got[2, 0]["log_prob"] == 0 and got[2, 0]["mean_log_prob"] is None
    words = EDGES[0][1].encode().split()
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = lm.word_bounds(data, np.array([0, len(data)]))
    vocabulary = model.vocabulary
    ids = vocabulary.ids(lm.word_codes(data, starts, ends)).tolist()
    vectors, inner, inner_bias, outer, outer_bias = lm.Network(model.weights, vocabulary.size, config).parts
    total = 0.0
    for k, i in enumerate(ids):
        around = [ids[j] if 0 <= j < len(ids) else vocabulary.size for j in (k - 2, k - 1, k + 1, k + 2)]
        logits = np.tanh(np.concatenate([vectors[a] for a in around]) @ inner + inner_bias) @ outer + outer_bias
        total += logits[vocabulary.class_of[i]] - np.log(np.exp(logits).sum()) + vocabulary.log_share[i]
    assert got[1, len(words)]["log_prob"] == pytest.approx(total, rel=1e-4)
    assert len(got) >= 8 and lm.score_documents(edges(spark).limit(0), model, config=config).count() == 0


def test_lm_vocabulary_is_the_most_frequent_words(spark):
    rows = [(k, " ".join(["a"] * 40 + ["b"] * 40 + [f"w{k}_{j}" for j in range(5)] + ["c"] * k)) for k in range(6)]
    vocabulary = lm.fit_vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), "text", lm.LMConfig(vocabulary=3, rest=2))
    data = np.frombuffer(b"a b c d", np.uint8)
    starts, ends, _ = lm.word_bounds(data, np.array([0, len(data)]))
    ids = vocabulary.ids(lm.word_codes(data, starts, ends))
    assert sorted(ids[:3]) == [0, 1, 2] and ids[3] >= 3 and vocabulary.size == 5


def test_lm_prefers_words_in_place_and_beats_word_shares(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    model = lm.fit_language_scorer(docs)
    shares = np.bincount(model.vocabulary.class_of, np.exp(model.vocabulary.log_share))
    assert np.allclose(shares[shares > 0], 1)       # a probability over the words of each class in use
    start = lm.LanguageScorer(model.vocabulary, lm.Network.start(model.vocabulary.size, lm.LMConfig()))
    trained, blank = (lm.score_documents(docs, m).agg(F.sum("log_prob") / F.sum("n_tokens")).first()[0] for m in (model, start))
    assert trained > blank + 0.3
    french = docs.join(spark.read.parquet(f"{SF01}/documents.parquet").where("lang = 'fr'").select("doc_id"), "doc_id")
    mixed = french.withColumn("text", F.array_join(F.shuffle(F.split("text", " ")), " "))
    whole, moved = (lm.score_documents(d, model).agg(F.avg("mean_log_prob")).first()[0] for d in (french, mixed))
    assert whole >= moved - 0.05


def test_lm_scores_every_word_with_its_own_share(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_WORDS", 7)
    config = lm.LMConfig(vocabulary=3, rest=2, classes=2, hidden=5, dim=3)
    rows = [(k, " ".join(["a"] * 9 + ["b"] * 8 + ["c"] * 7 + [f"w{j}" for j in range(k + 1) for _ in range(j + 1)])) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm.materialise(lm.count_words(docs, "text"))
    model = lm.fit_language_scorer(docs, config=config, counts=counts)
    rest, v = lm.rest_words(counts, model.vocabulary), model.vocabulary
    new = spark.createDataFrame([*rows, rows[3], (None, "a w5 never b seen w5"), (8, ""), (9, None)], "doc_id long, text string")
    got = lm.score_documents(new, model, config=config, rest=rest).collect()
    plain = {(r["doc_id"], r["n_tokens"]): r for r in lm.score_documents(new, model, config=config).collect()}
    assert len(got) == 10 and {r["doc_id"] for r in got if r["log_prob"] == 0 and r["mean_log_prob"] is None} == {8, 9}

    def code(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return lm.word_codes(data, np.array([0]), np.array([len(data)]))

    tally = {r["code"]: r["n"] for r in counts.collect()}
    known = {c: n for c, n in tally.items() if v.ids(np.array([c]).view(np.uint64))[0] >= 3}
    bucket = {c: int(v.ids(np.array([c]).view(np.uint64))[0]) - 3 for c in known}
    kinds = [sum(b == k for b in bucket.values()) for k in range(2)]
    mass = [sum(known[c] for c in known if bucket[c] == k) + max(1, kinds[k]) for k in range(2)]

    def share(word):
        c = code(word)
        at, key = int(v.ids(c)[0]) - 3, int(c.view(np.int64)[0])
        if at < 0:
            return 0.0
        return np.log(known[key] / mass[at]) if key in known else rest.log_unseen[at]

    for r in got:
        text = next(t for i, t in [*rows, (None, "a w5 never b seen w5"), (8, ""), (9, "")] if i == r["doc_id"])
        want = plain[r["doc_id"], r["n_tokens"]]["log_prob"] + sum(share(w) for w in text.split())
        assert r["log_prob"] == pytest.approx(want, rel=1e-6)
    # over all codes, the shares of each rest id make 1, and so do the classes
    free = [2.0 ** 63 - kinds[k] - sum(int(lm.mix64(v.codes[i:i + 1])[0]) % 2 == k for i in range(3)) for k in range(2)]
    for k in range(2):
        assert sum(known[c] / mass[k] for c in known if bucket[c] == k) + np.exp(rest.log_unseen[k]) * free[k] == pytest.approx(1)
    out = lm.Network(model.weights, v.size, config).log_probs(np.zeros((1, 4), int))[2]
    assert np.exp(out[0, np.unique(v.class_of)]).sum() == pytest.approx(1, abs=1e-5)


def test_lm_scores_hold_one_row_of_outputs_a_word():
    import tracemalloc
    config = lm.LMConfig(classes=1_000)
    net = lm.Network(lm.Network.start(50, config), 50, config)
    around = np.random.default_rng(1).integers(0, 51, (1_000, 4)).astype(np.uint16)
    tracemalloc.start()
    try:
        net.log_prob_of(around, np.zeros(1_000, int))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * 1_000 * (config.classes + config.rest) * 4      # exponentials beside the outputs made it two


@pytest.mark.parametrize("dim", [3, 4])
def test_lm_step_is_plain_adagrad(dim):
    config = lm.LMConfig(classes=6, rest=2, hidden=5, dim=dim)
    rng = np.random.default_rng(2)
    weights = lm.Network.start(9, config)
    around, classes = rng.integers(0, 10, (40, 4)).astype(np.uint16), rng.integers(0, 8, 40)
    around[around == 7] = 8                                     # 7 stands in no window
    before = [p.astype(float) for p in lm.Network(weights.copy(), 9, config).parts]
    net = lm.Network(weights.copy(), 9, config)
    net.step(around, classes, 0.1, [np.zeros_like(p) for p in net.parts])
    vectors, inner, inner_bias, outer, outer_bias = before
    grads = [np.zeros_like(p) for p in before]
    for row, own in zip(around, classes, strict=True):
        x = np.concatenate([vectors[i] for i in row])
        h = np.tanh(x @ inner + inner_bias)
        error = np.exp(h @ outer + outer_bias)
        error = error / error.sum() - np.eye(8)[own]
        below = (outer @ error) * (1 - h * h)
        for i, into in zip(row, (inner @ below).reshape(4, dim), strict=True):
            grads[0][i] += into / 40
        for k, g in ((1, np.outer(x, below)), (2, below), (3, np.outer(h, error)), (4, error)):
            grads[k] += g / 40
    for got, was, g in zip(net.parts, before, grads, strict=True):
        assert np.allclose(got, was - 0.1 * g / np.sqrt(g * g + 1e-8), atol=2e-3)
    assert (net.parts[0][7] == before[0][7]).all()


def test_lm_word_ids_are_those_of_a_plain_lookup():
    rng = np.random.default_rng(3)
    low, high = np.uint64(0), ~np.uint64(0)
    near = (np.uint64(77) << np.uint64(48)) + np.arange(0, 60, 3, dtype=np.uint64)       # with the same highest bits
    for codes in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.array([low, high]),
                  np.unique(np.concatenate([near, rng.integers(0, 1 << 64, 500, np.uint64, endpoint=False)]))):
        place = {int(c): k for k, c in enumerate(codes)}
        asked = np.concatenate([codes, codes + np.uint64(1), codes - np.uint64(1), rng.integers(0, 1 << 64, 300, np.uint64), [low, high]])
        other = (lm.mix64(asked) % np.uint64(7)).astype(int) + len(codes)
        got = lm.Vocabulary(codes, np.zeros(0), np.zeros(0), 7).ids(asked)
        assert got.tolist() == [place.get(int(c), o) for c, o in zip(asked, other, strict=True)]


def test_lm_masks_every_word_once_and_averages_vectors_by_their_windows(spark):
    for rounds, every in ((2, 8), (3, 8), (8, 8), (1, 5)):
        config = lm.LMConfig(rounds=rounds, mask_every=every)
        assert sorted(t for r in range(rounds) for t in lm.turns_of(r, config)) == list(range(every))
    config = lm.LMConfig(vocabulary=30, rest=1, classes=4, hidden=5, dim=3, rounds=1)
    # only the first of two partitions holds x and y; z stands everywhere
    rows = [(1, "x y z " * 200), (2, "z p q " * 2_000)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    model = lm.fit_language_scorer(docs, config=config)
    v = model.vocabulary
    alone = lm._train(docs.where("doc_id = 1"), "text", lm.LanguageScorer(v, _start(v, config)), 0, config)
    both = lm._train(docs, "text", lm.LanguageScorer(v, _start(v, config)), 0, config)
    rows_of = [lm.Network(w, v.size, config).parts[0] for w in (_start(v, config), alone, both, model.weights)]
    data = np.frombuffer(b"x y z", np.uint8)
    x, y, z = v.ids(lm.word_codes(data, np.array([0, 2, 4]), np.array([1, 3, 5])))
    for word in (x, y):
        assert np.abs(rows_of[1][word] - rows_of[0][word]).max() > 1e-3
        assert np.allclose(rows_of[2][word], rows_of[1][word], atol=1e-6)        # the other partition does not dilute it
        assert np.allclose(rows_of[3][word], rows_of[1][word], atol=1e-6)
    assert not np.allclose(rows_of[2][z], rows_of[1][z], atol=1e-6)


def _start(vocabulary, config):
    weights = lm.Network.start(vocabulary.size, config)
    unused = np.setdiff1d(np.arange(config.classes + config.rest), vocabulary.class_of)
    lm.Network(weights, vocabulary.size, config).parts[4][unused] = -1e4
    return weights


def test_language_id_is_plain_bayes_on_long_texts_at_the_usual_setting():
    config, rng = langid.LanguageIdConfig(), np.random.default_rng(1)
    base = np.log(rng.dirichlet(np.ones(config.buckets)))
    # a hot language, a rare one that fits 0.15 nats an n-gram better, and two close to it
    model = langid.LanguageModel(["hot", "rare", "near", "nearer"],
                                 np.stack([base, base + 0.15, base + 0.148, base + 0.149], 1).astype(np.float32),
                                 np.log([0.9997, 0.0001, 0.0001, 0.0001]))
    values = ["abcdefghij " * 9_000, "ab", "abcdefghij " * 3]
    best, score = langid.score_texts(values, model, config)
    for k, text in enumerate(values):
        total = sum(model.log_prob[b].astype(float).sum(0) for b, _ in langid.grams([text], config)) + model.log_prior
        n = sum(len(b) for b, _ in langid.grams([text], config))
        assert best[k] == total.argmax()
        soft = total * min(1.0, config.evidence / n)
        assert score[k] == pytest.approx(1 / np.exp(soft - soft.max()).sum())
    assert best.tolist() == [1, 0, 1] and score[0] < 0.5
    plain = langid.score_texts(values, model, langid.LanguageIdConfig(evidence=None))
    assert plain[0].tolist() == best.tolist() and plain[1][0] == pytest.approx(1)       # the pipeline keeps it


def test_language_id_with_more_languages_than_a_block(spark):
    """201 languages, and the same answers whatever the width of a block."""
    rng = np.random.default_rng(12)
    letters = [chr(0x4E00 + k) for k in range(201)]
    rows = [(k, "".join(rng.choice(letters[k % 201: k % 201 + 3], 12)), f"l{k % 201:03d}") for k in range(402)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_lid", F.lit(1))
    answers = []
    for width in (200, 1_000, 7):
        config = langid.LanguageIdConfig(buckets=1 << 10, languages_a_block=width)
        model = langid.fit_language_model(df, F.lit(True), config=config)
        assert len(model.languages) == 201
        out = langid.identify_language(df, model, config=config)
        assert out.columns == [*df.columns, "lang_pred", "score"]
        answers.append({r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()})
    assert sum(answers[0][k][0] == lang for k, _, lang in rows) > 380
    for other in answers[1:]:
        assert {k: (other[k], v) for k, v in answers[0].items() if other[k][0] != v[0] or abs(other[k][1] - v[1]) > 1e-6} == {}


def test_quality_learns_the_same_from_any_partitions(spark):
    """Repeated ids with different texts: weights do not depend on how the rows are dealt."""
    rng = np.random.default_rng(13)
    docs = spark.createDataFrame([(k % 40, " ".join(rng.choice(list("abcdefgh"), 8)) if k % 9 else None) for k in range(160)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 0), (4, 1)], "doc_id long, quality int")
    config = quality.QualityConfig(buckets=1 << 10, epochs=2)
    models = [quality.fit_quality_model(docs.repartition(n), labels.repartition(n), F.lit(True), config=config) for n in (1, 2, 3, 4)]
    assert all(np.array_equal(m.share, models[0].share) and m.bias == models[0].bias for m in models)


def test_scores_on_the_registered_path_handle_edges(spark):
    """Words coded once, every word scored as itself: empty tables, very long texts and clashing columns."""
    docs = edges(spark)
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "block", "ids", "places", "codes", "n", "code", "_lm_id") if c not in docs.columns])
    long = spark.createDataFrame([(900, "alpha beta gamma " * 60_000)], "doc_id long, text string").select(
        *[F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    for df in (docs.unionByName(long), docs.limit(0)):
        counts = lm.materialise(lm.count_words(df, "text"))
        vocabulary = lm.fit_vocabulary(df, "text", lm.LMConfig(), counts)
        coded = lm.materialise(lm.code_texts(df, vocabulary))
        model = lm.fit_language_scorer(df, vocabulary=vocabulary, coded=coded)
        rest = lm.rest_words(counts, vocabulary)
        once = lm.score_documents(df, model, rest=rest, coded=coded).collect()
        again = lm.score_documents(df, model, rest=rest).collect()
        assert sorted(map(str, once)) == sorted(map(str, again)) and len(once) == df.count()
        assert all(r["n_tokens"] > 0 or (r["log_prob"] == 0 and r["mean_log_prob"] is None) for r in once)
        assert not once or {r["n_tokens"] for r in once if r["doc_id"] == 900} == {180_000}
