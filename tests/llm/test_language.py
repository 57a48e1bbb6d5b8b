import random

from pyspark.sql import functions as F

from graphloom.llm import language

SCHEMA = "doc_id bigint, text string, lang string, score double, lang_pred int"


def test_languages_odd_rows_and_unknown_scripts(spark):
    rng = random.Random(2)
    parts = {"aa": ["ka", "ko", "ti", "mu"], "bb": ["sch", "ung", "ein", "ber"], "cc": ["пре", "ста", "вы"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))

    rows = [(i, text(x, 30), x) for i, x in enumerate(["aa"] * 60 + ["bb"] * 9 + ["cc"] * 5)]
    odd = [(900, None, "aa"), (901, "", None), (902, "123 !? \n", "bb"), (903, "漢字かな", None),
           (904, text("bb", 20_000), None), (905, text("cc", 4), None), (905, text("cc", 4), None)]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows + odd], SCHEMA)
    model = language.learn(df)
    assert model.languages[0] == "aa" and set(model.languages) == {"aa", "bb", "cc"}
    found = language.language_of(model, F.col("text"), df)
    got = [(r["doc_id"], r["x"]["lang_pred"], r["x"]["score"])
           for r in df.select("doc_id", found.alias("x")).collect()]
    want = dict((i, x) for i, _, x in rows) | {900: "und", 901: "und", 902: "und", 903: "aa", 904: "bb",
                                               905: "cc"}
    assert len(got) == len(rows) + len(odd)
    assert all(want[d] == lang and 0 <= score <= 1 for d, lang, score in got)
    assert all(score == 0 for d, _, score in got if 900 <= d <= 903)
    none = language.learn(df.filter("false"))
    found = language.language_of(none, F.col("text"), df)
    assert {r["x"]["lang_pred"] for r in df.select(found.alias("x")).collect()} == {"und"}
    assert df.filter("false").select(found.alias("x")).collect() == []


def test_filter_has_every_learned_trigram(spark):
    df = spark.createDataFrame([("one two three", "en"), ("eins zwei drei", "de")], "text string, lang string")
    model = language.learn(df)
    codes, _ = language.trigrams(["one two three"], model.letters)
    bit = model.languages.index("en")
    for row in language.slots_of(codes, len(model.masks), model.hashes):
        assert (model.masks[row] >> bit & 1).all()
