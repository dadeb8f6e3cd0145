"""Inputs for the small tests: every operator must take these."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, extra="", values=()):
    """A documents table with ids 0.. and the given texts."""
    rows = [(i, t, "en", "src0", len(t or ""), *values) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + (", " + extra if extra else ""))


ODD = [None, "", "x", "\n\n", " ", "a b c d e f g h i j k l " * 3000, "same text here again\nand a line of it", "same text here again\nand a line of it", "é\U0001f600 ǘ   \x1c end"]
