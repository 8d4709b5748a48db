"""The language filters learn from the ends of long texts too."""

from tidewire.llm import language


def test_ends_of_long_texts_reach_the_filters(spark):
    rows = [(1, "abcd " * 14_000 + "wxyz quvw " * 2_000, "aa"), (2, "mnop " * 14_000, "bb")]
    filters = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.identify(spark.createDataFrame([(1, "wxyz quvw wxyz quvw")], "doc_id long, text string"), filters).first()
    assert got["lang_pred"] == "aa" and got["score"] > 0.5
