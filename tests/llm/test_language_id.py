import math
import re

import numpy as np
import pyarrow as pa

from millrace.llm import language_id as op

from .common import documents, empty, odd, row


def model_of(spark, docs):
    return op.fit(docs.where(~op.held_out()))


def test_held_out_accuracy(spark):
    docs = documents(spark)
    out = op.predict(docs, model_of(spark, docs)).withColumn("held", op.held_out()).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_mixtures_are_found(spark):
    docs = documents(spark)
    model = model_of(spark, docs)
    by = {}
    for r in docs.collect():
        by.setdefault(r.lang, []).append(r.text)
    pieces = {k: " ".join(" ".join(v).split()[:300]) for k, v in by.items()}
    text = pieces["de"] + " " + " ".join(pieces["fr"].split()[:150])
    _, full, chosen, _ = op.mixtures(model, pa.array([pieces["en"], text]))
    assert model.langs[chosen[0].argmax()] == "en" and chosen[0].max() > 0.97
    share = dict(zip(model.langs, chosen[1]))
    assert abs(share["de"] - 2 / 3) < 0.08 and abs(share["fr"] - 1 / 3) < 0.08 and share["es"] < 0.05
    assert np.allclose(full.sum(axis=1), 1)


def test_labels_play_no_part_in_predictions(spark):
    docs = documents(spark)
    model = model_of(spark, docs)
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source")
    a, b = (sorted(map(tuple, op.predict(d, model).collect())) for d in (docs, other))
    assert a == b


def test_odd_rows(spark):
    docs = odd(spark, [row(20, "12345 67"), row(21, "— … €"), row(22, "1 é 2")])
    out = {r.doc_id: r for r in op.predict(docs, model_of(spark, documents(spark))).collect()}
    assert {i for i, r in out.items() if r.lang_pred == "und"} >= {1, 2, 3, 4, 20, 21}
    assert all(out[i].score == 0 for i in (1, 2, 3, 4, 20, 21)) and out[22].lang_pred != "und" and out[10].lang_pred != "und"
    nothing = op.fit(docs.where("lang = 'none'"))
    assert {r.lang_pred for r in op.predict(docs, nothing).collect()} == {"und"}
    assert op.predict(empty(spark), model_of(spark, documents(spark))).count() == 0


def test_accepted_keeps_columns_and_rows(spark):
    docs = odd(spark)
    out = op.accepted(docs, model_of(spark, documents(spark)))
    assert out.schema == docs.schema
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([5, 6, 7, 7, None, 8, 9, 10, 11], key=str)


def test_accepted_infers_no_mixture(monkeypatch):
    monkeypatch.setattr(op, "mixtures", None)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, 5], "text": ["12 a", "12 é", "12 !", "", None]})
    assert [b.column(0).to_pylist() for b in op._accepted(1)(iter([batch]))] == [[1, 2]]


def test_accepted_is_what_has_a_predicted_language(spark):
    docs = odd(spark, [row(20, "12345 67"), row(21, "— … €"), row(22, "1 é 2")])
    for model in (model_of(spark, documents(spark)), op.fit(docs.where("lang = 'none'"))):
        known = op.predict(docs, model).where("lang_pred <> 'und'")
        assert sorted((r.doc_id for r in op.accepted(docs, model).collect()), key=str) == sorted((r.doc_id for r in known.collect()), key=str)


def test_recognised_is_decided_by_the_mixture(spark, monkeypatch):
    docs = odd(spark, [row(20, "12345 67"), row(21, "— … €"), row(22, "1 é 2")])
    for model in (model_of(spark, documents(spark)), op.fit(docs.where("lang = 'none'"))):
        out = op.recognised(docs, model)
        assert out.schema == docs.schema
        known = op.predict(docs, model).where("lang_pred <> 'und'")
        assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((r.doc_id for r in known.collect()), key=str)
    seen = []
    whole = op.mixtures

    def none_in_two(model, column, **more):
        seen.extend(column.to_pylist())
        *out, words = whole(model, column, **more)
        return *out, np.where(np.array(column.to_pylist()) == "two", 0, words)

    monkeypatch.setattr(op, "mixtures", none_in_two)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["one", "two", "12", None]})
    model = op.Model(["en"], np.zeros((op.BUCKETS, 1), dtype=np.float32))
    assert [b.column(0).to_pylist() for b in op._recognised(model, 1, 1.0)(iter([batch]))] == [[1]] and seen == ["one", "two", "12", ""]


def plain_trigrams(text):
    """Buckets of each word's trigrams."""
    out = []
    for w in re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode()):
        p = b" " + w + b" "
        out.append([((p[i] << 16 | p[i + 1] << 8 | p[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(len(w))])
    return out


def plain_em(like, share, times):
    for _ in range(times):
        total = [0.0] * len(share)
        for row_ in like:
            whole = sum(s * x for s, x in zip(share, row_))
            total = [t + s * x / whole for t, s, x in zip(total, share, row_)]
        share = [t / len(like) for t in total]
    return share, sum(math.log(sum(s * x for s, x in zip(share, row_))) for row_ in like)


def plain_mixture(model, text):
    """(all proportions, chosen proportions, words) of one text."""
    like = []
    for word in plain_trigrams(text):
        logs = [sum(float(model.log_likelihood[b][k]) for b in word) for k in range(len(model.langs))]
        like.append([math.exp(x - max(logs)) for x in logs])
    k = len(model.langs)
    full, _ = plain_em(like, [1 / k] * k, 6)
    order = sorted(range(k), key=lambda i: -full[i])
    chosen = [float(i == order[0]) for i in range(k)]
    best = sum(math.log(max(row_[order[0]], 1e-30)) for row_ in like)
    for size in range(2, k + 1):
        if len(like) < 2 or full[order[size - 1]] <= 1e-3:
            break
        share = [max(full[i], 1e-6) if i in order[:size] else 0.0 for i in range(k)]
        share, fit = plain_em(like, [s / sum(share) for s in share], 3)
        if fit - best <= 1 + math.log(max(len(like), 2)):
            break
        chosen, best = share, fit
    return full, chosen, len(like)


def test_against_plain_fit_and_plain_mixtures(spark):
    docs = documents(spark)
    learned = {(r.lang, r.text) for r in docs.where(~op.held_out()).collect() if r.lang is not None and r.text is not None}
    model = model_of(spark, docs)
    assert model.langs == sorted({lang for lang, _ in learned})
    counts = np.zeros((op.BUCKETS, len(model.langs)))
    for lang, text in learned:
        for word in plain_trigrams(text):
            np.add.at(counts[:, model.langs.index(lang)], word, 1)
    seen = (counts.sum(axis=1) > 0).sum()
    assert np.allclose(model.log_likelihood, np.log((counts + 0.5) / (counts.sum(axis=0) + seen)), atol=1e-4)

    by = {}
    for r in docs.collect():
        by.setdefault(r.lang, []).append(" ".join((r.text or "").split()[:40]))
    mixed = [(10_000 + i, f"{a} {b}", None) for i, (a, b) in enumerate(zip(by["de"][:20], by["fr"][:20]))]
    whole = docs.where("length(text) < 20000").select("doc_id", "text", "lang").unionAll(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in op.predict(whole, model).collect()}
    several = 0
    for r in whole.collect():
        got = out[r.doc_id]
        if got.lang_pred == "und":
            assert not any(c.isalpha() for c in r.text or "")
            continue
        full, chosen, words = plain_mixture(model, r.text)
        best = max(chosen)
        assert got.lang_pred in [x for x, s in zip(model.langs, chosen) if s > best - 1e-3]
        at = model.langs.index(got.lang_pred)
        assert abs(got.score - (full[at] * words + 0.5) / (words + 0.5 * len(model.langs))) < 2e-3
        said = {x.partition(":")[0]: float(x.partition(":")[2]) for x in got.languages.split(",")}
        assert all(abs(said.get(x, 0) - s) < 5e-3 for x, s in zip(model.langs, chosen))
        several += len(said) > 1
    assert several >= 10
