import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    body = " ".join(words[i * i % 10] + str(i % 7) for i in range(300))
    rows = [
        (1, body, 7), (2, body, 8), (3, body.replace("gamma1", "gamma9", 1), 9), (4, "", 1), (5, None, 2), (6, "   \n\t ", 3),
        (7, "short", None), (8, "x" * 5000 + " " + "mail me: a.b@c.org or +1 (212) 555-0100", 5), (8, "x" * 5000, 5), (8, "x" * 5000, 5),
        (None, "no id here", 6), (9, "ÉCOLE don't 'tis we'll 日本語 <|endoftext|> 4111 1111 1111 1111 Σας ½", 1), (10, body * 20, 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int").selectExpr("*", "text AS fingerprint", "1 AS slot", "'z' AS rank", "2.0 AS score")
