"""Rows for the tests of the pipeline operators."""

SF_DIR = "/root/testdata/sf0.001"

#: Documents that no operator may stumble over, with columns named like the operators' own.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "One two three four five six seven eight nine ten."),
    (5, "ONE two THREE four five six seven eight nine ten."), (6, "one"), (7, "é" * 150),
    (7, "é" * 150), (8, "a" * 900), (9, "a b " * 300), (10, "a b " * 300), (None, "a b " * 300),
    (11, "日本語 テキスト 。 " * 40), (12, "  x\u0085y <|endoftext|> it's 3.14\r\n\r\n"),
    (13, "word " * 5000 + "tail"), (13, "another text under the same id, " * 8), (-5, "one two three four five"),
]


def frame(spark, rows, schema="doc_id long, text string"):
    """Rows with further columns whose names clash with what operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    clash = "doc tag key run start n spans kept digest shard part winner rep node component level block group ids score masked size bands".split()
    return df.withColumns({c: F.lit(None).cast("string") for c in clash}).repartition(3)
