"""Documents with every odd case the operators define a result for."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

ODD = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "Two  blanks here.\tTab\nline \n end ",
    "it's John's. They'll go, we've 12345 things; x.y.z",
    "Straße ÉCOLE naïve é İstanbul ǅ ﬁ 你好世界 🙂🙂  nbsp em",
    "<|endoftext|> and <|startoftext|> are text",
    "lines\nof.\nWords,\nand. more..\n",
    "the cat sat on the mat " * 40,
    "word " * 9000,
    "\x0b\x0c control \x1c\x1d \x85   separators",
    "a@b.co x@y.z@w.v mail me.at+tag%1@ex-ample.co.uk. @no a@b @@ a@b.c@d.ef",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0255.001.1.1 1.2.3",
    "4539 5787 6362 1486, 4539578763621486 4539-5787-6362-1487 1 2 3 +49 (0)170 123-4567 +1 2 +12345678901234567",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" https://x.org/a?b=c, IBAN DE89 3704 0044 0532 0130 00 account: 12345678',
]


def docs(spark, texts, lang="en", source="s", **extra):
    rows = [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Odd texts, one repeated row, a null id, extra columns named as results are."""
    from pyspark.sql import functions as F

    frame = docs(spark, ODD)
    frame = frame.union(frame.filter("doc_id = 6")).union(spark.createDataFrame([(None, "no id at all", None, None, None)], DOCS))
    for c in ("n_words", "ids", "spans", "open", "kept", "path", "word", "media", "group"):
        frame = frame.withColumn(c, F.lit("x"))
    return frame
