"""Small tables with awkward rows, shared by the tests of this folder."""

import random
import re

SPACES = re.compile(r"[\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def frame(spark, texts, first=1, sources=None):
    rows = [(first + i, t, "en", None if sources is None else sources[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


def documents(spark, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
