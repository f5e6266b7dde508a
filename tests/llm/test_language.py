import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import language as L

WORDS = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zwei", "drei", "vier", "funf"], "cc": ["uno", "quatro", "cinque", "sette"]}


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    labels = [list(WORDS)[i % 3] for i in range(n)]
    return [" ".join(rng.choice(WORDS[y], rng.integers(3, 30))) for y in labels], labels


def test_learns_and_rejects(spark):
    model = L.train(*corpus(240, 1))
    texts, labels = corpus(120, 2)
    scores = model.scores([L.normalise(t) for t in texts])
    assert (np.array(model.languages)[scores.argmax(axis=1)] == labels).mean() > 0.97
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "Привет как дела сегодня"), (5, texts[0])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.predict(rows, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[5]["lang_pred"] == labels[0] and not got[5]["rejected"] and 0 <= got[4]["score"] <= 1


def test_foreign_texts_are_rejected_and_mixed_ones_kept():
    model = L.train(*corpus(240, 1))
    foreign = ["Привет как дела сегодня погода хорошая", "the quick brown fox jumps over the lazy dog near a river", "kaikki ihmiset syntyvat vapaina ja tasavertaisina", "qzx wvk jjp xxq kkv zzw qpx"]
    assert model.judged([L.normalise(t) for t in foreign])[1].all()
    mixed = [f"{a} {b}" for a, b in zip(corpus(60, 7)[0], corpus(60, 8)[0][1:] + ["uno sette"], strict=True)]
    assert model.judged([L.normalise(t) for t in mixed])[1].mean() <= 0.02
    assert model.judged([L.normalise(t) for t in corpus(300, 9)[0]])[1].mean() <= 0.01
    assert model.errors[0] <= 0.01 and model.errors[1] <= 0.1
    two = L.train(*zip(*[(t, y) for t, y in zip(*corpus(240, 1), strict=True) if y != "cc"], strict=True))
    assert two.judged([L.normalise(t) for t, y in zip(*corpus(90, 2), strict=True) if y == "cc"])[1].mean() >= 0.95


def test_predictions_by_hand():
    """One window after the other, with the model's own numbers."""
    model = L.train(*corpus(120, 3))
    for text in corpus(12, 5)[0] + ["a", "dolor ½ zwei", "x" * 30]:
        data, rows, told = L.normalise(text), [], []
        for n in L.ORDERS:
            for i in range(len(data) - n + 1):
                window = data[i : i + n]
                if b" " in (window if n == 1 else window[1:-1]):
                    continue
                code = int.from_bytes(window, "big")
                hashed = ((code ^ (code >> 15)) * 2654435761 + (n * 0x9E3779B1 & 0xFFFFFFFF)) * 2654435761 & 0xFFFFFFFF
                rows.append(model.table[hashed >> 16].astype(float))
                told += [rows[-1][-1]] if n >= 3 else []
        logits = (np.mean(rows, axis=0)[:-1] + model.bias) / model.temperature
        want = np.exp(logits) / np.exp(logits).sum()
        share = np.mean(told)
        allowed = share + L.SIGMAS * (max(share * (1 - share), 1 / len(told)) / len(told)) ** 0.5
        scores, rejected = model.judged([data])
        assert np.allclose(scores[0], want) and rejected[0] == (want.max() < model.floor or allowed < model.known)


def test_letters():
    assert not any(L.has_letter(t) for t in ("", "12 !?", "½²①Ⅷ_", "\n")) and all(L.has_letter(t) for t in ("½a", "ж", "字"))


def test_batches_slices_and_single_texts_agree(monkeypatch):
    model = L.train(*corpus(120, 3))
    texts = [L.normalise(t) for t in corpus(40, 4)[0]] + [L.normalise("lorem ipsum " * 3000)]
    together = model.logits(texts)
    alone = np.concatenate([model.logits([t]) for t in texts])
    assert np.allclose(together, alone)
    monkeypatch.setattr(L.words, "SLICE", 100)
    assert np.allclose(together, model.logits(texts))


def test_held_out_rows_and_labels_are_not_used(spark):
    rows = [(i, "lorem ipsum", "aa") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r["doc_id"] for r in docs.where(L.held_out(F.col("doc_id"))).collect()}
    swapped = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    texts, labels = L.training_sample(swapped)
    assert held and set(labels) == {"aa"} and len(texts) == 40 - len(held)


def test_odd_rows(spark, odd_docs):
    model = L.fit(odd_docs)
    assert L.predict(odd_docs, model).count() == odd_docs.count()
    kept = L.identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert L.identified(odd_docs.withColumnRenamed("text", "Text"), model).count() == kept.count()
    assert {r["h"] for r in odd_docs.where("doc_id is null").select(L.held_out(F.col("doc_id")).alias("h")).collect()} == {False}
    empty = odd_docs.limit(0)
    assert L.identified(empty, model).count() == 0
    assert L.predict(empty, L.fit(empty)).count() == 0


def test_copies_fill_the_sample_last(spark):
    rows = [(i, "one text", "aa") for i in range(100)] + [(1000 + i, f"text number {i}", "aa") for i in range(200)]
    texts, _ = L.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50)
    assert len(texts) == len(set(texts)) == 50
