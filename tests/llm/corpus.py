"""Small corpora for tests: ordinary prose, and the rows that break things."""

import random

WORDS = "the of and to in is that for was with cat tree house river stone light morning garden people water small early under across bright quiet walk found seven letter winter market".split()


def prose(seed, words=80, line=10):
    r = random.Random(seed)
    picked = [r.choice(WORDS) + (r.choice("abcdefgh") if r.random() < 0.3 else "") for _ in range(words)]
    return "\n".join(" ".join(picked[i : i + line]).capitalize() + "." for i in range(0, words, line))


#: Null ids and texts, empty and white-space texts, repeated rows, one id with two texts, other scripts.
ODD = [
    (None, None), (None, "text without an id"), (1, None), (2, ""), (3, " \n\t\n "), (4, "one"), (5, "!!! ### 123"), (6, prose(6)), (6, prose(6)), (6, prose(66)),
    (7, "Ελληνικά ΣΟΦΟΣ κείμενα"), (8, "日本語のテキスト です"), (9, "Привет мир, это текст"), (10, "a" * 5000), (11, "x y " * 3000), (12, "é <|endoftext|> \u0085 \U0001f600"), (13, "\n".join(["same line"] * 6)),
]

#: Extra columns whose names operators use themselves.
CLASHES = "score kept covered fp node root epoch block n_tokens ids decoded n_lines n_removed twin held_out label v".split()


def documents(spark, rows, clashes=False):
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("mine") for c in CLASHES})
    return df
