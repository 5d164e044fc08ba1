"""Frames shared by the tests of this folder."""

LONG = "long text of many words, " * 8000

EDGE_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp string, "
               "text_key string, TOXICITY_SCORE string, pii_email string, bucket string, runs string")


def edge_docs(spark):
    """Null ids and texts, blanks, one character, a very long text, repeated rows
    and columns named like the operators' own."""
    rows = [(0, None), (1, ""), (2, "   \n"), (3, "x"), (4, LONG), (None, "no id at all, but a text"),
            (None, None), (5, "Same text twice here."), (6, "Same text twice here."),
            (7, "One row. That comes again."), (7, "One row. That comes again."), (8, "naïve 日本語 😀 text")]
    return spark.createDataFrame(
        [(i, t, None if i == 3 else "en", None if i in (1, 4) else "src0", None if t is None else len(t),
          "a", "b", "c", "d", "e", "f") for i, t in rows], EDGE_SCHEMA)
