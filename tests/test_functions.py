"""Scalar functions on literal values."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import language, text


@pytest.fixture(scope="module")
def one(spark):
    def run(column):
        return spark.range(1).select(column.alias("x")).first().x

    return run


def test_tokenize(one):
    cases = {
        "cat123 and DOG456": ["cat123", "and", "dog456"],
        "!? --": [],
        "¿Qué dice sobre el éxodo?": ["qué", "dice", "sobre", "el", "éxodo"],
        "Что said a_b": ["что", "said", "a", "b"],
        "什么是耶稣": ["什么", "么是", "是耶", "耶稣"],
        "神": ["神"],
        "": [],
    }
    for raw, want in cases.items():
        assert one(text.tokenize(F.lit(raw))) == want
    assert one(text.tokenize(F.lit(None).cast("string"))) is None


def test_normalised_tokens(one):
    assert one(text.normalized_tokens(F.lit("God's cats, kittens kitten s Felines"))) == ["god", "s", "cat", "kitten", "cat", "s", "cat"]


def test_slug_title_and_html(one):
    assert one(text.slugify(F.lit("  The Book: Part  2! "))) == "the-book-part-2"
    assert one(text.slugify(F.lit("???"), 10, "item")) == "item"
    assert one(text.clean_html_flat(F.lit("<![CDATA[a <b>b</b>&amp;lt;]]>\n c&nbsp;"))) == "a b &lt; c"
    assert one(text.clean_html_blocks(F.lit("<p>one<br/> two</p><p></p> three"))) == "one\ntwo\nthree"


@pytest.mark.parametrize(("raw", "want"), [("1:02:03", 3723), ("02:03", 123), ("45", 45), ("", 0), ("1:2:3:4", 0), ("x", 0)])
def test_durations(one, raw, want):
    assert one(text.seconds_from_duration(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("00:01.5", 1500), ("1:00:00,25", 3600250), ("nope", None), ("00:02.12345", 2123)])
def test_timestamps(one, raw, want):
    assert one(text.timestamp_ms(F.lit(raw))) == want


def test_clock_forms(one):
    assert one(text.format_timestamp(F.lit(59_999))) == "00:59"
    assert one(text.format_timestamp(F.lit(3_600_000))) == "01:00:00"
    assert one(text.mmss(F.lit(754))) == "1234"
    assert one(text.mmss_to_ms(F.lit("1234"), F.lit(0))) == 754_000
    assert one(text.mmss_to_ms(F.lit("12"), F.lit(3))) == 360_000


def test_citations_and_links(one):
    def cite(kind, show, start):
        return one(text.citation_label(F.lit(kind), F.lit(show), F.lit(None).cast("string"), F.lit("T"), F.lit(start).cast("long"), F.lit(4)))

    assert cite("podcast_episode", "Show", 61_000) == "Show, T, 01:01"
    assert cite("podcast_episode", "", 61_000) == "T, T, 01:01"
    assert cite("text_note", "Show", 61_000) == "T, chunk 4"
    link = lambda kind, url: one(text.timestamp_url(F.lit(kind), F.lit(url), F.lit(61_999)))
    assert link("podcast_episode", "http://a") == "http://a?t=61"
    assert link("youtube_video", "http://a?v=1") == "http://a?v=1&t=61"
    assert link("text_note", "http://a") is None and link("podcast_episode", "") is None
    assert one(text.replace_time(F.lit("http://a/w?v=1&t=9s&x#f"), F.lit(61_000))) == "http://a/w?v=1&x&t=61s#f"


def test_weights(one):
    assert [one(text.weight(F.lit(x))) for x in ("2.5", "0", "-1", "x", None)] == [2.5, 1.0, 1.0, 1.0, 1.0]


def test_vectors(one):
    v = one(text.hash_embedding(F.lit("cats and dogs")))
    assert len(v) == 8 and abs(sum(x * x for x in v) - 1) < 1e-9
    assert one(text.hash_embedding(F.lit("!"))) == [0.0] * 8
    arr = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(text.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(0.5**0.5)
    assert one(text.cosine(arr(0, 0), arr(1, 1))) == 0.0
    with pytest.raises(Exception, match="differ in length"):
        one(text.cosine(arr(1, 2, 3), arr(1, 2)))


def test_idf(one):
    get = lambda n, df: one(text.idf(F.lit(n), F.lit(df)))
    assert get(100, 1) > 3 and 0 <= get(100, 100) < 0.01 and get(0, 0) == 0 and get(5, 0) == 0


@pytest.mark.parametrize(
    ("raw", "code"),
    [
        ("Что говорит книга об исходе", "ru"), ("מה אומר הספר על יציאת מצרים", "he"), ("что такое SPARK сегодня у нас", "ru"),
        ("¿Qué dice el libro sobre el éxodo?", "es"), ("Que dit le livre sur les pauvres dans la ville", "fr"),
        ("Was sagt das Buch über die Stadt und wie", "de"), ("Jerusalem", "en"), ("什么是耶稣的名字在这里的意思是什么呢朋友们你好", "zh"),
    ],
)
def test_languages(one, raw, code):
    found = one(language.detect(F.lit(raw)))
    assert found.language == code
    if raw != "Jerusalem":
        assert found.confidence >= 0.4


def test_no_language(one):
    for raw in ("", "  \n", "123 !?", None):
        assert tuple(one(language.detect(F.lit(raw).cast("string")))) == (None, 0.0)


def test_tokens_on_both_sides_are_normalised_alike(spark):
    texts = ["Cats kitties felines s ss as", "日本語s テスト", "привет домs", "", "x1s été's"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalized_tokens(F.col("t")).alias("n")).collect()
    assert all(list(r.n) == [text.normalized_token(x) for x in text.tokens_of(r.t)] for r in rows)
