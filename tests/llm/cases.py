"""Small tables with the awkward rows that every operator has to take."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, id long, bucket long, "
          "component string, size long, key string")


def words(n, base=0):
    return " ".join(f"w{base + i}" for i in range(n))


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    extra columns whose names operators use inside."""
    long_text = "\n".join(words(40, 40 * i) for i in range(400))
    rows = [
        (1, words(80), "en", "a"), (2, words(80), "en", "a"), (3, words(80) + " extra", "en", None), (3, words(80) + " extra", "en", None),
        (4, None, "en", "a"), (5, "", "de", "b"), (6, " \n\t ", None, "b"), (7, long_text, "de", "b"), (None, words(80, 500), "en", "a"),
        (None, words(80, 500), None, None), (8, "short one", "fr", "c"), (9, "żółw 😀 ▁x  y\n\nlast", "fr", "c"), (None, None, None, None),
    ]
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), True, "r", 7, 7, "c", 7, "k") for i, t, l, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
