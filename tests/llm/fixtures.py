"""Small frames that every operator must take: nulls, empty and long texts, repeats, clashing extra columns."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, token string, block bigint"


def documents(spark, texts):
    rows = [(i, t, None, "src0", None, "x", 7) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two three four five six seven"), (5, "one two three four five six seven"),
        (None, "no id here at all"), (6, long), (7, "a  b\n\nc \n d  e　　f\x00g"), (8, "ÀÉ naïve 日本語 text <|endoftext|> 🙂"),
        (9, "x" * 5000), (9, "x" * 5000), (10, "\r\n\r\nq\x0bq\x0cq"),
    ]
