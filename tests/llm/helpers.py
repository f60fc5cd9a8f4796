"""Small corpora with everything that may go wrong in one."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: names that the operators use for columns of their own
CLASHING = "did th start mini words found node root gone gone_ cuts leads shard key bin part n_words lang_pred loss gap keep quality toxic stats rep code v a b lo hi size".split()

WORDS = {
    "en": "the of and river house morning letter window walked slowly garden because nothing remember towards evening children".split(),
    "fr": "le la des rivière maison matin lettre fenêtre marchait lentement jardin parce souvenir soir enfants était".split(),
    "de": "der die das und Fluss Haus Morgen Brief Fenster ging langsam Garten weil nichts Abend Kinder".split(),
}


def prose(seed, n, lang="en", fresh=False):
    rng = random.Random(seed)
    words = [rng.choice(WORDS[lang]) for _ in range(n)]
    if fresh:  # words that no other text has
        words = [w if rng.random() < 0.4 else f"{w}{rng.randrange(10**6)}" for w in words]
    return " ".join(words)


def corpus(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "web", None if r[1] is None else len(r[1])) for r in rows], DOCS)


def ugly_rows():
    long = prose(1, 60_000, fresh=True)
    same = prose(2, 120, fresh=True)
    return [
        (None, prose(3, 80, fresh=True)),
        (None, None),
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "... !!! ???"),
        (5, long),
        (6, same),
        (7, same),
        (7, same),
        (8, prose(4, 90, fresh=True), None),
        (9, prose(5, 90, "fr", fresh=True), "fr"),
        (9, prose(6, 90, "de", fresh=True), "de"),
        (10, "word"),
        (11, "ünïcödé \U0001f600 " + prose(7, 60, fresh=True)),
        (12, "x" * 200_000),
        (13, "nul \x00 byte " + prose(8, 60, fresh=True)),
    ]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in CLASHING if c not in df.columns})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
