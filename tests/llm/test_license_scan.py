import math

from millrace.llm import license_scan as op

from .common import documents, empty, odd, row, texts, words

BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def brute(text):
    w, places, labels = words(text), [], set()
    for label, phrase in BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(df, source):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in source), key=str)
    for r in df.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_against_brute_force(spark):
    docs = documents(spark)
    check(op.scan(docs), texts(docs))


def test_odd_rows(spark):
    docs = odd(spark, [row(20, "MIT License MIT LICENSE cc BY CC by-nc gnu General Public-license apache\nlicense"), row(21, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"), row(22, "permission is hereby granted by the mayor")])
    out = op.scan(docs)
    check(out, texts(docs))
    by = {r.doc_id: r for r in out.collect()}
    assert by[20].labels == "apache,cc-by,cc-by-nc,gpl,mit" and by[20].n_base == 6
    assert by[21].labels == "mit" and by[21].n_base == 0 and by[21].score == 1
    assert by[22].labels == ""


def test_labels_and_score_against_brute_force(spark):
    whole = [notice for _, notice, _ in op.WHOLE]
    broken = whole[0].replace("sublicense", "sell").replace("charge", "cost")
    extra = [row(30 + k, t) for k, t in enumerate([*whole, broken, "x " * 50 + whole[1] + " y", whole[2][:300], whole[4][40:], " ".join(whole)])]
    docs = odd(spark, extra)
    found = {id(t): t for t in op.templates()}.values()
    every = [words(t) for _, t in texts(docs)]
    idf = {w: math.log((len(every) + 1) / (sum(w in set(d) for d in every) + 1.0)) + 1e-3 for t in found for w in t.words}
    want = []
    for (name, _), d in zip(texts(docs), every, strict=True):
        labels, score = set(), 0.0
        for t in found:
            phrase = list(t.words[t.key : t.key + t.key_words])
            for k in range(len(d) - len(phrase) + 1):
                if d[k : k + len(phrase)] != phrase:
                    continue
                at = k - t.key
                share = sum(idf[w] for i, w in enumerate(t.words) if 0 <= at + i < len(d) and d[at + i] == w) / sum(idf[w] for w in t.words)
                if t.base or share >= 0.8:
                    labels.add(t.label)
                    score = max(score, 1.0 if t.key_words == len(t.words) else share)
        want.append((name, ",".join(sorted(labels)), round(min(score, 1.0), 9)))
    got = [(r.doc_id, r.labels, round(r.score, 9)) for r in op.scan(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {x for r in want for x in r[1].split(",")} >= {"mit", "isc", "bsd", "apache", "gpl"}


def test_empty_table(spark):
    assert op.scan(empty(spark)).count() == 0
