"""Fixtures shared by the operators' tests."""

import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Clashing and additional columns, nulls everywhere, repeated rows, ties, empty and long texts.
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("score", T.StringType()), ("id", T.StringType()), ("row", T.StringType()), ("t", T.StringType()), ("labels", T.StringType()), ("key", T.StringType()))]
)
LONG = "lorem ipsum dolor sit amet " * 40_000
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards watch from a hill near the old town"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), "x", "y", "z", "t", "l", "k")


def odd(spark, extra=()):
    rows = [
        row(1, None, None, None),
        row(2, ""),
        row(3, " \n\t"),
        row(4, "!!! ??? ---"),
        row(5, "One"),
        row(6, SENTENCE),
        row(7, SENTENCE),
        row(7, SENTENCE),
        row(None, SENTENCE + " again"),
        row(8, SENTENCE.upper() + "."),
        row(9, "日本語 текст ελληνικά \U0001f600 é"),
        row(10, LONG),
        row(11, "\x00\x01\x02 control \x01\x02 marks \x01"),
        row(None, None, None, None),
        *extra,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
