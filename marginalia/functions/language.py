"""Language identification by script and stop words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokenize

# The ranges of each script, in order of precedence ...
SCRIPTS = [
    ("he", r"\x{0590}-\x{05FF}"),
    ("ru", r"\x{0400}-\x{04FF}"),
    ("ar", r"\x{0600}-\x{06FF}"),
    ("zh", r"\x{4E00}-\x{9FFF}"),
    ("ko", r"\x{AC00}-\x{D7AF}"),
    ("hi", r"\x{0900}-\x{097F}"),
    ("latin", r"A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}"),
]

#: The range that holds all scripts but Latin, and those without spaces between words.
_FAR = r"[\x{0400}-\x{D7AF}]"

# ... and the words that tell languages of Latin script apart, in order of precedence.
STOP_WORDS = {
    "en": "the a an and or of to in on for is are what does do say says said about that this with from by as it its was were be been has have had not but if so we you they he she who which when where why how",
    "es": "que de la el los las un una unos unas y o en a es son del al por para con no su sus sobre dice dicen qué cómo cuándo dónde este esta estos estas pero como más muy también",
    "fr": "le la les de des du un une et ou est sont que qui pour dans sur avec ne pas vous nous il elle ils elles ce cette ces mais comme plus très dit dis quoi où quand",
    "de": "der die das und oder ist sind nicht mit für auf von zu ein eine einen was wer wie wo wann warum sagt sagen über aber auch sehr mehr",
    "pt": "o a os as de do da dos das que e ou um uma uns umas é são não para com sobre diz dizem qual quando onde como mas muito também",
    "it": "il lo la i gli le di che e o un una non per con su dice dicono cosa quando dove come ma anche molto più",
}

#: Confidence from which a source is tagged with its language.
TAGGED_FROM = 0.4


#: All words that any of the languages counts.
_ANY_STOP_WORD = sorted(set(" ".join(STOP_WORDS.values()).split()))


def _bind(value: Column, then) -> Column:
    """``then`` of a value that is computed once: a lambda's argument is."""
    return F.transform(F.array(value), then)[0]


def detect(text: Column) -> Column:
    """struct<language, confidence> of a text; (null, 0) for null, blank and letterless ones.

    The script with most letters wins, the first of equals.  Latin text goes to the
    language with most stop words, the first of equals, or to English without any.
    """
    none = F.struct(F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"))
    others = "".join(letters for code, letters in SCRIPTS if code != "latin")

    def of(sample: Column) -> Column:
        def letters_of(letters: str) -> Column:
            return F.length(sample) - F.length(F.regexp_replace(sample, f"[{letters}]+", ""))

        def ranked(count) -> Column:
            return F.array_max(F.array(*[F.struct(count(code, letters).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code")) for i, (code, letters) in enumerate(SCRIPTS)]))

        # one look at most texts shows that they have letters of no other script: all those are in one range
        def known(far: Column) -> Column:
            best = F.when(far & sample.rlike(f"[{others}]"), ranked(lambda _, letters: letters_of(letters))).otherwise(
                ranked(lambda code, letters: letters_of(letters) if code == "latin" else F.lit(0))
            )
            return _bind(best, lambda found: decide(sample, found, far))

        return _bind(sample.rlike(_FAR), known)

    def decide(sample: Column, best: Column, far: Column) -> Column:
        dense = F.least(F.lit(1.0), best["n"] / F.greatest(F.lit(20), F.length(sample)))
        other = F.struct(best["code"].alias("language"), dense.alias("confidence"))
        latin = _bind(tokenize(sample, far), lambda words: of_words(words, dense))
        return F.when((F.length(sample) == 0) | (best["n"] == 0), none).when(best["code"] == "latin", latin).otherwise(other)

    def of_words(words: Column, dense: Column) -> Column:
        def top(stops: Column) -> Column:
            def count(words_of: str) -> Column:
                return F.size(F.filter(stops, lambda w: w.isin(sorted(set(words_of.split())))))

            return F.array_max(F.array(*[F.struct(count(stop).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code")) for i, (code, stop) in enumerate(STOP_WORDS.items())]))

        def latin(best: Column) -> Column:
            return F.struct(
                F.when(best["n"] > 0, best["code"]).otherwise("en").alias("language"),
                F.when(F.size(words) == 0, 0.0)
                .when(best["n"] > 0, F.least(F.lit(1.0), F.greatest(best["n"] / F.greatest(F.size(words), F.lit(1)), dense)))
                .otherwise(dense)
                .alias("confidence"),
            )

        # the languages look only at words that any of them counts
        return _bind(F.filter(words, lambda w: w.isin(_ANY_STOP_WORD)), lambda stops: _bind(top(stops), latin))

    return F.when(text.isNull(), none).otherwise(_bind(F.regexp_extract(text, r"(?Us)^\s*((?:.*\S)?)", 1), of))


def tagged(found: Column) -> Column:
    """The language of ``detect``, null below the confidence that tagging asks for."""
    # bound, as the text would else be looked at twice
    return _bind(found, lambda d: F.when(d["confidence"] >= TAGGED_FROM, d["language"]))
