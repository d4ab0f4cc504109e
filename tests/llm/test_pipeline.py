import corpus_pipeline
import numpy as np
import pytest
from millrace.llm import decontaminate, language_id, pii
from millrace.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

from .common import SF, documents, empty, jaccard, odd, row, shingles, texts, words

def test_stages_on_own_documents(spark):
    docs = documents(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        seen[name] = docs.collect()
        if name != "sequences":
            assert docs.columns == before.columns
        docs = spark.createDataFrame(seen[name], docs.schema)
    model = language_id.fit(documents(spark).where(~language_id.held_out()))
    assert len(seen["language"]) == language_id.predict(documents(spark), model).where("lang_pred <> 'und'").count()
    kept = [(r.doc_id, shingles(r.text)) for r in seen["near_duplicates"]]
    inverted = {}
    for i, (_, s) in enumerate(kept):
        for g in s:
            inverted.setdefault(g, []).append(i)
    close = {(a, b) for own in inverted.values() for a in own for b in own if a < b}
    assert all(jaccard(kept[a][1], kept[b][1]) < 0.8 for a, b in close)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    before = spark.createDataFrame(seen["near_duplicates"], documents(spark).schema)
    leaked = {r.doc_id for r in decontaminate.search(before, bench).where(decontaminate.contaminated()).collect()}
    assert leaked and {r.doc_id for r in seen["benchmark_leaks"]} == {r.doc_id for r in seen["near_duplicates"]} - leaked
    moved = {r.doc_id: r for r in seen["personal_data"]}
    for i, t in texts(spark.createDataFrame(seen["benchmark_leaks"], documents(spark).schema)):
        assert moved[i].n_chars == len(moved[i].text) or moved[i].text == t
    assert {r.doc_id for r in seen["sequences"]} == set(moved)
    assert pii.KINDS


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_language_stage_infers_the_mixture(spark, monkeypatch):
    no_buckets = language_id.Model(["en"], np.zeros((0, 1), dtype=np.float32))  # can't be looked up by any trigram
    monkeypatch.setattr(language_id, "fit", lambda docs: no_buckets)
    with pytest.raises(Exception, match="out of bounds"):
        corpus_pipeline.language(spark, odd(spark), SF).collect()


def test_registered_queries(spark):
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


CLASHES = ("name", "gone", "twice", "replaced", "pii_parts", "pii_new", "__name", "comp", "block")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_rows_and_clashing_columns(spark, name, stage):
    docs = clashing(odd(spark, [row(20, "call (706) 555-3138 or write to x.y@z.example.org"), row(21, None)]))
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert stage(spark, clashing(empty(spark)), SF).count() == 0
    if name == "sequences":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
        return
    assert out.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    was, kept = (sorted(((r.doc_id, r.text) for r in rs), key=str) for rs in (docs.collect(), rows))
    if name == "language":
        assert kept == [x for x in was if x[1] and any(map(str.isalpha, x[1]))]
    elif name == "near_duplicates":
        fox = [x for x in kept if x[1] and x[1].lower().startswith("the quick brown")]
        assert len(fox) == 1 and set(was) - set(kept) == {x for x in was if x[1] and x[1].lower().startswith("the quick brown")} - set(fox)
    elif name == "benchmark_leaks":
        assert kept == was
    else:
        assert [i for i, _ in kept] == [i for i, _ in was] and [x for x in kept if x[0] != 20] == [x for x in was if x[0] != 20]
        changed = next(r for r in rows if r.doc_id == 20)
        assert "555-3138" not in changed.text and "z.example" not in changed.text and changed.n_chars == len(changed.text)


def test_no_benchmark_window_is_left(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    wanted = {tuple(w[k : k + 13]) for r in bench for w in [words(r.text)] for k in range(len(w) - 12)}
    filler = [f"filler{k % 997}" for k in range(5_000)]
    long_ = [row(10_000 + k, " ".join([*filler[: 700 * k], *words(r.text)[:13], *filler[700 * k :]])) for k, r in enumerate(bench[:5])]
    near = [row(20_000 + k, " ".join([*filler[k:], *words(r.text)[:12]])) for k, r in enumerate(bench[:5])]
    docs = documents(spark).unionByName(spark.createDataFrame([x[:5] for x in long_ + near], documents(spark).schema))
    kept = corpus_pipeline.benchmark_leaks(spark, docs, SF).collect()
    held = {i: any(tuple(w[k : k + 13]) in wanted for k in range(len(w) - 12)) for i, t in texts(docs) for w in [words(t)]}
    assert not any(held[r.doc_id] for r in kept)
    assert {r.doc_id for r in kept} == {i for i, leak in held.items() if not leak}
    assert all(held[10_000 + k] and not held[20_000 + k] for k in range(5))
