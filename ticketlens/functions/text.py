"""Text cleaning as native column expressions.

Every step is a `Column -> Column` function evaluated in the JVM; no Python runs per row.
Word characters and whitespace are spelled out as Unicode classes, because the
shorthands `\\w`, `\\b` and `\\s` of Java differ from those of Python on combining marks,
letter-like numbers and some control characters.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"\p{L}\p{N}_"
_S = r"\s\x1c-\x1f"
# The whitespace of ASCII by its members: Java tests a class of single characters by one look into a table.
_BLANKS = r"\t\x0b\f\r\x1c\x1d\x1e\x1f\x20"
_FLAGS = "(?iuU)"
_WORD_START = rf"(?<![{_W}])"
_WORD_END = rf"(?![{_W}])"

# --- Fixed values: what is removed from descriptions, in order ---------------
IMAGE_EXTENSIONS = "png|jpg|jpeg|gif|webp|svg|bmp|heic"
IMAGE_WORDS = "image|imagen|png|jpg|jpeg|gif|webp|svg|bmp|heic"
NOISE_WORDS = "image|imagen|img|png|jpg|jpeg|gif|webp|svg|bmp|heic|alt|width|height"
SMART_LINK = r"\[[^\]]+\|https?://[^\]|]+(?:\|smart-link)?\]"
IMAGE_EMBED = rf"![^!\n]*\.(?:{IMAGE_EXTENSIONS})(?:\|[^!\n]*)?!"
MARKDOWN_IMAGE = r"!\[[^\]]*\]\([^)]+\)"
IMG_TAG = rf"<img{_WORD_END}[^>]*>"
IMAGE_FILENAME = rf"{_WORD_START}[{_W}][{_W}\-.]*\.(?:{IMAGE_EXTENSIONS}){_WORD_END}"
IMAGE_ATTR = (
    rf"{_WORD_START}(?:alt|width|height)[{_S}]*=[{_S}]*"
    rf"(?:\"[^\"]*\"|'[^']*'|[^{_S},;]+)"
)
URL = rf"(https?://[^{_S}]+|www\.[^{_S}]+)"
IMAGE_WORD = rf"{_WORD_START}(?:{IMAGE_WORDS}){_WORD_END}"
GREETING_PHRASES = [
    "buen dia",
    "buenos dias",
    "hola",
    "estimados",
    "estimado",
    "cordial saludo",
    "saludos",
    "buenas tardes",
    "buenas noches",
]
GREETING = rf"{_WORD_START}(?:{'|'.join(GREETING_PHRASES)}){_WORD_END}[:,;\-{_S}]*"
SENTENCE_BREAKS = r".!?\n;:"

# --- Fixed values: what a text holds, in any case, in which a step above finds something -----
IMAGE_HINTS = ["image", "png", "jpg", "jpeg", "gif", "webp", "svg", "bmp", "heic"]
GREETING_HINTS = ["buen", "hola", "estimado", "saludo"]
#: The characters beyond ASCII that are equal to an ASCII letter when case is ignored.
ODD_LETTERS = "\u0130\u0131\u017f\u212a"
NOISE_KEYWORD = rf"(?:^|[{_S}_-])(?:{NOISE_WORDS})(?:$|[{_S}_-])"


def _blank_out(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, _FLAGS + pattern, " ")


def strip_smart_links(text: Column) -> Column:
    return _blank_out(text, SMART_LINK)


def strip_image_embeds(text: Column) -> Column:
    return _blank_out(text, IMAGE_EMBED)


def strip_markdown_images(text: Column) -> Column:
    return _blank_out(text, MARKDOWN_IMAGE)


def strip_img_tags(text: Column) -> Column:
    return _blank_out(text, IMG_TAG)


def strip_image_filenames(text: Column) -> Column:
    return _blank_out(text, IMAGE_FILENAME)


def strip_image_attrs(text: Column) -> Column:
    return _blank_out(text, IMAGE_ATTR)


def strip_urls(text: Column) -> Column:
    return _blank_out(text, URL)


def strip_image_words(text: Column) -> Column:
    return _blank_out(text, IMAGE_WORD)


def strip_greetings(text: Column) -> Column:
    return _blank_out(text, GREETING)


def strip_whitespace(text: Column) -> Column:
    """Trim all Unicode whitespace, not only spaces."""
    return F.regexp_replace(text, rf"(?U)^[{_S}]+|[{_S}]+$", "")


def collapse_whitespace(text: Column) -> Column:
    """Single spaces between words, none around; single spaces are not rewritten."""
    uneven = rf"(?U)[{_S}]{{2,}}|[{_S}&&[^ ]]"
    not_space = _BLANKS.replace(r"\x20", r"\n")
    in_ascii = rf"(?:[{not_space}]|\x20[{_BLANKS}\n])[{_BLANKS}\n]*+"
    return F.trim(_blank_out_by_script(text, in_ascii, uneven))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _blank_out_by_script(text: Column, in_ascii: str, pattern: str) -> Column:
    """`pattern` blanked out; `in_ascii` says the same of ASCII texts."""
    return _let(
        text,
        lambda t: F.when(_is_ascii(t), F.regexp_replace(t, in_ascii, " ")).otherwise(F.regexp_replace(t, pattern, " ")),
    )


# --- Fixed values: Hangul syllables and the letters they consist of -------------
FIRST_SYLLABLE, LAST_SYLLABLE = 0xAC00, 0xD7A3
LEADS = "".join(chr(0x1100 + i) for i in range(19))
VOWELS = "".join(chr(0x1161 + i) for i in range(21))
TRAILS = "".join(chr(0x11A8 + i) for i in range(27))
# ------------------------------------------------------------------------------


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


@lru_cache(maxsize=1)
def _foldings() -> dict[str, str]:
    """What each character becomes that decomposition without combining marks changes.

    Canonical reordering moves combining marks only, so folding works character by
    character. Hangul syllables follow a rule and are left out.
    """
    folded = {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if FIRST_SYLLABLE <= code <= LAST_SYLLABLE or unicodedata.category(char) == "Cs":
            continue
        parts = unicodedata.normalize("NFKD", char)
        kept = "".join(c for c in parts if not unicodedata.combining(c))
        if kept != char:
            folded[char] = kept
    return folded


def _ranges(chars: list[str]) -> str:
    """The inside of a regex class of `chars`, which are in order."""
    spans: list[list[int]] = []
    for code in map(ord, chars):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans)


def _syllable_letters(char: Column) -> Column:
    number = F.ascii(char) - FIRST_SYLLABLE
    trail = number % (len(TRAILS) + 1)
    per_lead = len(VOWELS) * (len(TRAILS) + 1)
    lead = F.floor(number / per_lead).cast("int")
    vowel = F.floor(number % per_lead / (len(TRAILS) + 1)).cast("int")
    return F.concat(
        F.substr(F.lit(LEADS), lead + 1, F.lit(1)),
        F.substr(F.lit(VOWELS), vowel + 1, F.lit(1)),
        F.substr(F.lit(TRAILS), trail, F.least(trail, F.lit(1))),
    )


def _spell_out(text: Column) -> Column:
    """`text` with each character written out that becomes more than one."""
    several = {char: kept for char, kept in _foldings().items() if len(kept) > 1}
    syllables = rf"\x{{{FIRST_SYLLABLE:x}}}-\x{{{LAST_SYLLABLE:x}}}"
    # The first range spares ASCII characters the long list.
    long = rf"\x{{80}}-\x{{{sys.maxunicode:x}}}&&[{_ranges(list(several))}{syllables}]"
    place = lambda char: F.instr(F.lit("".join(several)), char)
    spelled = F.split(F.lit("\n".join(several.values())), "\n")

    def one(piece: Column) -> Column:
        return (
            F.when(piece < "\x80", piece)
            .when(piece.between(chr(FIRST_SYLLABLE), chr(LAST_SYLLABLE)), _syllable_letters(piece))
            .otherwise(F.coalesce(F.get(spelled, place(piece) - 1), piece))
        )

    pieces = F.regexp_extract_all(
        text, F.lit(r"[\x00-\x7f]++|[^\x00-\x7f]"), F.lit(0)
    )
    whole = F.array_join(F.transform(pieces, one), "")
    return F.when(text.rlike(f"[{long}]"), whole).otherwise(text)


def fold_text(text: Column) -> Column:
    """Compatibility decomposition, combining marks removed, lower case.

    ASCII texts are only put in lower case. In others, characters that become one or none are
    translated, and those that become several are written out where there are any.
    """
    short = {char: kept for char, kept in _foldings().items() if len(kept) <= 1}
    # Those without a counterpart come last and are removed.
    order = sorted(short, key=lambda char: not short[char])
    source, target = "".join(order), "".join(short[char] for char in order)

    def folded(value: Column) -> Column:
        translated = F.translate(value, source, target)
        return F.when(_is_ascii(value), value).otherwise(_let(translated, _spell_out))

    return F.lower(_let(text, folded))


def drop_first_words(text: Column, words_to_drop: int = 3) -> Column:
    """Drop the first words of every sentence; sentences not longer than that vanish.

    One pass removes each sentence break with the words after it, a second evens out
    the whitespace that is left.
    """
    if words_to_drop <= 0:
        return text
    breaks = SENTENCE_BREAKS
    opening = (
        rf"(?U)(?:\A|[{breaks}])[{breaks}{_S}]*+"
        rf"(?:[^{_S}{breaks}]++[{_S}&&[^\n]]*+){{0,{words_to_drop}}}+"
    )
    in_ascii = (
        rf"(?:\A|[{breaks}])[{breaks}{_BLANKS}]*+"
        rf"(?:[^{_BLANKS}{breaks}]++[{_BLANKS}]*+){{0,{words_to_drop}}}+"
    )
    return collapse_whitespace(_blank_out_by_script(text, in_ascii, opening))


def _holds(text: Column, lower: Column, words: list[str]) -> Column:
    """Whether one of `words` may stand in `text` in any case; true for odd letters."""
    odd = reduce(or_, [F.contains(text, F.lit(char)) for char in ODD_LETTERS])
    return reduce(or_, [F.contains(lower, F.lit(word)) for word in words]) | (~_is_ascii(text) & odd)


def _strip_markup(text: Column) -> Column:
    """All markup steps; those are left out that find nothing, as what they look for is not in `text`.

    Steps put single spaces in place of what they find, so no step makes such a sign or word for a later one.
    """

    def hints(raw: Column) -> Column:
        images = lambda lower: F.array(_holds(raw, lower, IMAGE_HINTS), _holds(raw, lower, ["www."]))
        links = F.contains(raw, F.lit("://"))
        return F.struct(raw.alias("raw"), links.alias("links"), _let(F.lower(raw), images).alias("words"))

    def stripped(given: Column) -> Column:
        has = lambda sign: F.contains(given["raw"], F.lit(sign))
        text, links, images, www = given["raw"], given["links"], given["words"][0], given["words"][1]
        for step, needed in (
            (strip_smart_links, links & has("[")),
            (strip_image_embeds, images & has("!")),
            (strip_markdown_images, has("![")),
            (strip_img_tags, has("<")),
            (strip_image_filenames, images & has(".")),
            (strip_image_attrs, has("=")),
            (strip_urls, links | www),
            (strip_image_words, images),
        ):
            text = _where(needed, step, text)
        return text

    return _let(text, lambda raw: _let(hints(raw), stripped))


def _where(needed: Column, step: Callable[[Column], Column], text: Column) -> Column:
    return _let(text, lambda value: F.when(needed, step(value)).otherwise(value))


def clean_description(text: Column, words_to_drop: int = 3) -> Column:
    """The whole cleaning chain; null becomes the empty string."""
    folded = fold_text(_strip_markup(F.coalesce(text, F.lit(""))))
    greeted = lambda value: _where(_holds(value, value, GREETING_HINTS), strip_greetings, value)
    cleaned = _let(folded, greeted)
    if words_to_drop <= 0:
        return collapse_whitespace(cleaned)
    return drop_first_words(cleaned, words_to_drop)


def truncate_text(text: Column, max_chars: int = 350) -> Column:
    """At most `max_chars` characters, the last one an ellipsis when cut; null gives ''."""
    cut = F.regexp_replace(F.substring(text, 1, max_chars - 1), rf"(?U)[{_S}]+$", "")
    return (
        F.when(text.isNull(), "")
        .when(F.length(text) <= max_chars, text)
        .otherwise(F.concat(cut, F.lit("…")))
    )


def trim_lower(text: Column) -> Column:
    return F.lower(strip_whitespace(text))


def is_noise(term: Column) -> Column:
    """True for blank terms and those holding an image or markup word."""
    value = F.coalesce(strip_whitespace(term), F.lit(""))
    return (value == "") | value.rlike(_FLAGS + NOISE_KEYWORD)


def keyword_label(keywords: Column, max_terms: int = 4) -> Column:
    """First keywords joined, at most 80 characters; a fixed label when there are none."""
    lead = F.substring(F.array_join(F.slice(keywords, 1, max_terms), ", "), 1, 80)
    return F.when(F.size(keywords) > 0, lead).otherwise("Tema general")
