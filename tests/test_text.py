import pytest
from pyspark.sql import functions as F

from skeinfeed.functions import text as X
from skeinfeed.functions.lexicon import NO_DETAILS


CASES = {
    "id": (lambda: X.article_id(F.lit(" u "), F.lit(" t ")), "5ef5a4ad" and None),
    "tags": (lambda: X.tags(F.lit("technology"), X.article_id(F.lit(" u "), F.lit(" t ")), F.lit("en")), ["#Tech", "#AI", "#LiveUpdates"]),
    "score": (lambda: X.sentiment(F.lit("Markets surge"), F.lit("Profit growth boosts bank"))[1], 76),
    "label": (lambda: X.sentiment(F.lit(None), F.lit(None))[0], "Neutral"),
    "tie": (lambda: X.category(F.lit("cricket stock"), F.lit(None)), "business"),
    "science": (lambda: X.category(F.lit("ISRO satellite"), F.lit("launch said")), "science"),
    "no_scrape": (lambda: X.scrapeable(F.lit("https://x.com/videos/1")), False),
    "scrape": (lambda: X.scrapeable(F.lit("https://x.com/videos")), True),
    "image": (lambda: X.image_url(F.lit("https://x.com/a.JPG?x=1")), True),
    "page": (lambda: X.image_url(F.lit("https://x.com/page")), False),
    "cdn": (lambda: X.image_url(F.lit("https://cdn.x.com/page")), True),
    "ftp": (lambda: X.image_url(F.lit("ftp://x/a.png")), False),
    "logo": (lambda: X.article_image(F.lit("https://x.com/logo.png")), False),
    "tiny": (lambda: X.article_image(F.lit("https://x.com/20x300.png")), False),
    "off_title": (lambda: X.fits_title(F.lit("text"), F.lit("AI wins")), False),
    "no_title": (lambda: X.fits_title(F.lit("x"), F.lit("")), True),
    "repeats": (lambda: X.repeats_title(F.lit("Hello World."), F.lit("hello  world")), True),
    "blank_lines": (lambda: X.strip_symbols(F.lit("A\n\nB")), "A\nB"),
    "junk": (lambda: X.clean_metadata(F.lit("Space agency launches")), "Space"),
    "trailing": (lambda: X.without_trailing_junk(F.lit("Para one is here.\n\nHoroscope")), "Para one is here."),
    "cut_back": (lambda: X.complete_ending(F.lit("One. Two three"), F.lit("en")), "One."),
    "ended": (lambda: X.complete_ending(F.lit("abc"), F.lit("en")), "abc."),
    "danda": (lambda: X.complete_ending(F.lit("abc"), F.lit("te")), "abc।"),
    "semicolon": (lambda: X.complete_ending(F.lit("abc;"), F.lit("en")), "abc;."),
    "paragraphs": (lambda: X.without_empty_paragraphs(F.lit("--\n\nok two\n\nthree words here")), "three words here"),
    "label_code": (lambda: X.normal_category(F.lit("Andhra Jyothi")), "andhrajyothi"),
    "known_code": (lambda: X.normal_category(F.lit("Technology ")), "technology"),
    "unknown_code": (lambda: X.normal_category(F.lit("tech")), "general"),
    "bundle_word": (lambda: X.valid_bundle(F.lit(" ".join(["word"] * 40))), False),
    "bundle_comma": (lambda: X.valid_bundle(F.lit(" ".join(["word"] * 40) + ",")), True),
    "bundle_short": (lambda: X.valid_bundle(F.lit(" ".join(["word"] * 39) + ".")), False),
    "words": (lambda: X.word_count(F.lit("a b \t c")), 3),
    "chunks": (lambda: X.chunks(F.lit("One two. Three four. Five."), 3), ["One two. Three four.", "Five."]),
    "fallback": (lambda: X.raw_fallback(F.lit("A title of five words"), F.lit(None), F.lit(""), F.lit("en")), NO_DETAILS["en"]),
    "lines": (lambda: X.distinct_lines(F.lit("a\nB\n\nA \nb\n\nc")), "a\nB\n\n\nc"),
    "highlights": (lambda: X.highlights(F.lit("One two three four five six seven eight. One two three four five six seven eight! Short one.")), ["One two three four five six seven eight."]),
    "relevant": (lambda: X.relevant_paragraphs(F.lit("Lead here\n\nabout markets\n\nother thing\n\nmore things"), F.lit("Markets today")), "Lead here\n\nabout markets"),
}


@pytest.mark.parametrize("name", [n for n in CASES if n != "id"])
def test_hand_case(spark, name):
    build, want = CASES[name]
    got = spark.range(1).select(build().alias("v")).collect()[0]["v"]
    assert got == want


def test_all_take_nulls_and_long_texts(spark):
    functions = [X.strip_symbols, X.fix_encoding, X.clean_metadata, X.without_summaries, X.distinct_lines, X.distinct_paragraphs, X.distinct_sentences, X.without_trailing_junk, X.without_broken_words, X.without_empty_paragraphs, X.highlights, X.chunks, X.word_count, X.complete, X.valid_bundle, X.noise_paragraph, X.garbage_sentence]
    df = spark.createDataFrame([(None,), ("",), ("word. " * 3000,)], "c string")
    for f in functions:
        assert df.select(f(F.col("c")).alias("v")).count() == 3
    assert df.select(X.clean_article(F.col("c"), F.lit("en"), F.lit(None)).alias("v")).collect()[0]["v"] == ""


def test_cleaning_is_idempotent_on_lines(spark):
    df = spark.createDataFrame([("a\nb\na\n\nc",)], "c string").select(X.distinct_lines(F.col("c")).alias("c"))
    assert df.select((X.distinct_lines(F.col("c")) == F.col("c")).alias("v")).collect()[0]["v"]
