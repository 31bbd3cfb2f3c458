"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_texts():
    rng = random.Random(3)
    base = words(rng, 120)
    edited = base.split()
    edited[60] = "changed"
    passage = words(rng, 60)
    return [
        None, "", "   \n\t ", "x", "Ünïcödé ÉÉ \u00a0 nbsp", base, base, " ".join(edited), base.upper(),
        words(rng, 30) + "\n" + passage + "\n" + words(rng, 30), words(rng, 25) + " " + passage + " " + words(rng, 9),
        words(rng, 9000), "ab" * 3000, "a" * 5000, "line one here\nline one here\n\nline two", "日本語 テキスト 😀 " * 20, "<|endoftext|> don't SHE'LL 12345",
    ]


def documents(spark, texts=None, extra=False):
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        clash = ["score", "kept", "fp", "g", "uid", "spans", "doc", "th", "part", "bad", "n", "ids", "lang_pred", "component_id"]
        df = df.select("*", *(F.lit("clash").alias(c) for c in clash))
    return df
