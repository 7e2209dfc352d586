"""Rows that every operator on texts must stand."""

ODD_TEXTS = [
    None,
    "",
    " \t\n ",
    "a",
    "The the THE the, the.",
    "don't I'LL we've <|endoftext|> x <|startoftext|>",
    "café ÉTÉ ünï ß ½ ² 中文 字 かな ́a ǅ İ ſ ﬁ",
    "x  y   z \n  w \x1c \x1f \x85 \xa0 v",
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen",
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen",
    "!!! *** ### 123 456",
    "word " * 30_000,
    "z" * 5_000,
]


def odd_documents(spark):
    """Repeated rows, a null id, nulls in all columns, and extra columns whose names the operators use themselves."""
    rows = [(k, t, "en" if k % 2 else None, "s", k, "x", "y", 1) for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[8], rows[8], (None, "text of a row without an id", None, None, None, None, None, None), (None,) * 8]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _id string, shard string, size int"
    return spark.createDataFrame(rows, kinds).repartition(3), rows


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
