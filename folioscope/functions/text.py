"""Text and label expressions. All of them are row-wise, so they also run on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python treats as blanks and as word characters, spelt out because the
# shorthand classes of Java cover ASCII only. Both spellings are understood by Java and by RE2.
BLANKS = (
    r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD_CHARS = r"\p{L}\p{N}_"
SENTENCE_ENDS = ".!?"
KEPT_PUNCTUATION = ".,;!?"

# The French list of Spark's StopWordsRemover.
FRENCH_STOP_WORDS = (
    "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos "
    "notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à "
    "m n s t y été étée étées étés étant étante étants étantes suis es est sommes êtes sont serai seras sera serons "
    "serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent "
    "sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant ayante ayantes ayants eu eue eues "
    "eus ai as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait "
    "avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez "
    "eussent"
).split()

# The corpus-specific stop words.
CORPUS_STOP_WORDS = ["candidat", "suppléant", "circonscription", "cest", "die", "der", "und", "das"]

STOP_WORDS = FRENCH_STOP_WORDS + CORPUS_STOP_WORDS

# The coarse blocs, first match wins. A needle is (text, ignore case).
BLOC_RULES = [
    ("Bloc de Gauche", [("socialiste", True), ("radicaux de gauche", True)], []),
    ("Bloc de Droite", [("République", False), ("démocratie française", False)], []),
    ("PCF", [("communiste", True)], [("révolutionnaire", True)]),
    ("Extrême Gauche", [("Lutte ouvrière", False), ("Ligue communiste", False)], []),
]
OTHER_BLOC = "Autres"


def _text(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


# -- cleaning ---------------------------------------------------------------------------------------------------------


def newlines_to_blank(text: str | Column) -> Column:
    return F.regexp_replace(_text(text), r"\n+", " ")


def remove_symbols(text: str | Column) -> Column:
    """Delete every character but word characters, blanks and ``.,;!?``."""
    return F.regexp_replace(_text(text), f"[^{WORD_CHARS}{BLANKS}{KEPT_PUNCTUATION}]", "")


def remove_isolated_numbers(text: str | Column) -> Column:
    """Delete numbers of one or two digits that stand alone."""
    return F.regexp_replace(_text(text), rf"(?<![{WORD_CHARS}])\p{{Nd}}{{1,2}}(?![{WORD_CHARS}])", "")


def clean_tokens(text: str | Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Alphabetic lower-case tokens of three letters or more that are not stop words, in order.

    A null text has no tokens. Line breaks are blanks here and numbers never pass the letter test, so the two
    steps that only touch those are not repeated.
    """
    pieces = F.split(F.lower(remove_symbols(F.coalesce(_text(text), F.lit("")))), f"[{BLANKS}{KEPT_PUNCTUATION}]+")
    return F.filter(pieces, lambda t: t.rlike(r"^\p{L}{3,}$") & ~t.isin(list(stop_words)))


def clean_text(text: str | Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return F.array_join(clean_tokens(text, stop_words), " ")


def words(text: str | Column) -> Column:
    """The tokens of an already cleaned, space-joined text."""
    return F.array_remove(F.split(F.coalesce(_text(text), F.lit("")), " "), "")


# -- lexical measures -------------------------------------------------------------------------------------------------


def lexical_tokens(text: str | Column) -> Column:
    """Lower-case, delete everything but word characters and blanks, split on blanks."""
    kept = F.regexp_replace(F.lower(F.coalesce(_text(text), F.lit(""))), f"[^{WORD_CHARS}{BLANKS}]", "")
    return F.array_remove(F.split(kept, f"[{BLANKS}]+"), "")


def sentence_count(text: str | Column) -> Column:
    """Stretches between ``.!?`` that hold at least one visible character."""
    return F.regexp_count(F.coalesce(_text(text), F.lit("")), F.lit(f"[^{SENTENCE_ENDS}{BLANKS}][^{SENTENCE_ENDS}]*"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null instead of an error when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator)


# -- labels and display -----------------------------------------------------------------------------------------------


def contains(text: Column, needle: str, ignore_case: bool) -> Column:
    return F.lower(text).contains(needle) if ignore_case else text.contains(needle)


def coarse_label(label: str | Column, rules=BLOC_RULES, other: str = OTHER_BLOC) -> Column:
    """First rule with one of its needles present and none of its exclusions; null labels stay null."""
    label = _text(label)
    result = F.when(label.isNull(), F.lit(None).cast("string"))
    for name, any_of, none_of in rules:
        hit = F.lit(False)
        for needle, fold in any_of:
            hit = hit | contains(label, needle, fold)
        for needle, fold in none_of:
            hit = hit & ~contains(label, needle, fold)
        result = result.when(hit, F.lit(name))
    return result.otherwise(F.lit(other))


def truncated(label: str | Column, width: int = 50) -> Column:
    label = _text(label)
    return F.when(F.length(label) > width, F.concat(F.substring(label, 1, width), F.lit("..."))).otherwise(label)


def with_percent(name: Column, share: Column) -> Column:
    """``name (12.3%)``."""
    return F.format_string("%s (%.1f%%)", name, share * 100)


def sign_class(value: str | Column) -> Column:
    value = _text(value)
    return F.when(value > 0, "positive").when(value < 0, "negative").otherwise("zero")


def document_name(file_name: Column, extension: str = ".txt") -> Column:
    """File name without its extension."""
    return F.regexp_replace(file_name, r"\Q" + extension + r"\E$", "")
