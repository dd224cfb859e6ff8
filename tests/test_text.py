"""Cleaning expressions against plain Python on crafted, random and sample texts."""

import os
import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from ticketlens import functions as fn
from ticketlens.operators.cleaning import clean_tickets, fill_defaults
from ticketlens.operators.terms import eligible_texts

# What each step removes, written for Python's `re`.
EXT = "(?:png|jpg|jpeg|gif|webp|svg|bmp|heic)"
PATTERNS = {
    "strip_smart_links": r"\[[^\]]+\|https?://[^\]|]+(?:\|smart-link)?\]",
    "strip_image_embeds": rf"![^!\n]*\.{EXT}(?:\|[^!\n]*)?!",
    "strip_markdown_images": r"!\[[^\]]*\]\([^)]+\)",
    "strip_img_tags": r"<img\b[^>]*>",
    "strip_image_filenames": rf"\b[\w\-.]+\.{EXT}\b",
    "strip_image_attrs": r"""\b(?:alt|width|height)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s,;]+)""",
    "strip_urls": r"(?:https?://\S+|www\.\S+)",
    "strip_image_words": r"\b(?:image|imagen|png|jpg|jpeg|gif|webp|svg|bmp|heic)\b",
    "strip_greetings": r"\b(?:buen dia|buenos dias|hola|estimados|estimado|cordial saludo|saludos|"
    r"buenas tardes|buenas noches)\b[:,;\-\s]*",
}

CRAFTED = [
    "",
    "Hola, buen día: no abre el sistema ![a](b.png) https://x.co",
    "señor_ñu.png y Foto-2.JPEG, también imagen. PNG x.png.",
    "[Wiki page|https://wiki.example.org/a|smart-link] and [b|http://c] rest of it",
    "see !shot 1.png|width=300,height=200! and !no image! or !a.gif!",
    "<IMG src='a'> <imgx> <img\n> alt = \"two words\" width=3, height='9' alt=x;y",
    "WWW.Example.org/path?q=1 www. https:// http://a b",
    "ÁÉÍ ﬁne … ½ cup ™ Ⅳ ｆｕｌｌ á b͏c กั 가 ß İ ſ K",
    "imagen ſvg ímage image_ _image image1 ﬁimage",
    "uno dos tres\ncuatro cinco seis siete! a b c. ocho; a b c d : e",
    "tabs\tand\x1cseparators\x85and spaces here now one two",
    "BUENAS TARDES,;-:  hola-hola estimadosx estimado saludos",
    "x" * 400,
]


def random_texts(count=1500):
    pieces = ["hola", "imagen", ".png", "foto", "!", "[a|http://b]", "](", "<img ", ">", "alt=",
              "'", '"', " ", "  ", "\n", ".", ";", ":", "www.", "https://", "é", "ñ", "_", "-", "1",
              "́", "…", "buen dia", "BUENOS DIAS", "\t", "palabra", "|", "!["]
    rng = random.Random(7)
    return ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(count)]


def sample_texts():
    path = f"{registered.SMOKE_DIR}/documents.parquet"
    if not os.path.exists(path):
        return []
    import pyarrow.parquet as pq

    return pq.read_table(path, columns=["text"]).column("text").to_pylist()


def fold(text):
    parts = unicodedata.normalize("NFKD", text)
    return "".join(c for c in parts if unicodedata.combining(c) == 0).lower()


def drop(text, n=3):
    kept = (chunk.split()[n:] for chunk in re.split(r"[.!?\n;:]+", text))
    return " ".join(" ".join(words) for words in kept if words)


def python_step(name):
    if name == "fold_text":
        return fold
    if name == "drop_first_words":
        return drop
    pattern = re.compile(PATTERNS[name], re.IGNORECASE)
    return lambda text: pattern.sub(" ", text)


def python_clean(text):
    for name in PATTERNS:
        if name != "strip_greetings":
            text = python_step(name)(text)
    return drop(python_step("strip_greetings")(fold(text)))


@pytest.fixture(scope="module")
def texts(spark):
    every = CRAFTED + random_texts() + sample_texts()
    return spark.createDataFrame([(t,) for t in every], "text string").repartition(8).cache()


@pytest.mark.parametrize("name", [*PATTERNS, "fold_text", "drop_first_words"])
def test_step(name, texts):
    step = getattr(fn, name)
    expected = python_step(name)
    for row in texts.select("text", step(F.col("text")).alias("got")).collect():
        assert row.got == expected(row.text), repr(row.text)


def test_fold_of_every_character(spark):
    """Alone and between letters, marks and long expansions, all code points fold as in Python."""
    codes = spark.range(0x80, sys.maxunicode + 1, numPartitions=8).where(
        "id not between 55296 and 57343"
    )
    utf8 = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    char = codes.select(utf8.alias("c"))
    among = F.concat(F.lit("Aﬁ"), "c", F.lit("\u0301각\u0345"), "c", F.lit("\n"))
    texts = char.select(F.explode(F.array("c", among)))
    rows = texts.toDF("t").select("t", fn.fold_text(F.col("t")).alias("got")).toPandas()
    wrong = [t for t, got in zip(rows.t, rows.got) if got != fold(t)]
    # Characters that Python's version of Unicode does not have yet may have a lower case in the JVM.
    later = [t for t in wrong if any(unicodedata.category(c) == "Cn" for c in t)]
    assert len(rows) == 2 * (sys.maxunicode + 1 - 0x80 - 2048)
    assert [t for t in wrong if t not in set(later)] == []
    assert len(later) < 200


def test_fold_lets_filters_through(spark):
    df = spark.range(5).select("id", F.lit("É").alias("t"))
    df = df.repartition(2).select("id", fn.fold_text(F.col("t")).alias("t")).where("id > 2")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") > plan.index("Project") and "reflect" not in plan
    nulls = spark.createDataFrame([(None,), ("",), ("ÀB",)], "t string")
    assert [r[0] for r in nulls.select(fn.fold_text(F.col("t"))).collect()] == [None, "", "ab"]


def test_whole_chain(texts):
    got = texts.select("text", fn.clean_description(F.col("text")).alias("got")).collect()
    for row in got:
        assert row.got == python_clean(row.text), repr(row.text)


def test_words_to_drop(texts):
    sample = texts.limit(300)
    for n in (1, 5):
        got = sample.select("text", fn.drop_first_words(F.col("text"), n).alias("got"))
        for row in got.collect():
            assert row.got == drop(row.text, n), repr(row.text)
    kept = sample.select("text", fn.drop_first_words(F.col("text"), 0).alias("got"))
    assert all(r.text == r.got for r in kept.collect())


def test_truncate(spark):
    texts = ["a" * 350, "a" * 351, "a" * 348 + "  b" * 5, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(fn.truncate_text(F.col("text"))).collect()]
    assert got == ["a" * 350, "a" * 349 + "…", "a" * 348 + "…", "", ""]


def test_noise(spark):
    noise = ["", "  ", None, "image", "IMG", "foto png", "alt_text", "a-width", "x heic y"]
    terms = ["images", "salt", "pngs", "foto", "heights"]
    df = spark.createDataFrame([(t,) for t in noise + terms], "term string")
    got = [r[0] for r in df.select(fn.is_noise(F.col("term"))).collect()]
    assert got == [True] * len(noise) + [False] * len(terms)


def test_keyword_label(spark):
    words = [[], ["a"], ["a", "b", "c", "d", "e"], ["w" * 50, "v" * 50]]
    df = spark.createDataFrame([(w,) for w in words], "kw array<string>")
    got = [r[0] for r in df.select(fn.keyword_label(F.col("kw"), 4)).collect()]
    assert got == ["Tema general", "a", "a, b, c, d", ("w" * 50 + ", " + "v" * 50)[:80]]


def test_clean_tickets(spark):
    raw = spark.createDataFrame(
        [(None, None, "uno dos tres " + "x" * 20), ("A", "s", "uno dos tres cuatro"), ("A", "s", None)],
        "Agencia string, Summary string, Description string",
    )
    got = clean_tickets(raw).collect()
    assert [r.Agencia for r in got] == ["Unknown", "A", "A"]
    assert [r.Summary for r in got] == ["", "s", "s"]
    assert [r.Description_clean for r in got] == ["x" * 20, "cuatro", ""]
    assert [r.NLP_Eligible for r in got] == [True, False, False]
    assert got[0].Tipo == got[0]["Issue Type"] == "Unknown"
    assert fill_defaults(raw).first().Resolution == ""


def test_eligible_texts_are_cleaned_once(spark):
    """Choosing by the length of the cleaned text does not clean it a second time."""
    raw = spark.createDataFrame([(1, "uno dos tres " + "cuatro cinco seis " * 3), (2, "corto"), (3, None)], "i int, Description string")
    found = eligible_texts(clean_tickets(raw.repartition(2))).select("i", "Description_clean")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
    assert [r.i for r in found.collect()] == [1]


def test_odd_letters(spark):
    """No other character beyond ASCII is one of the letters that steps look for."""
    chars = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    letters = "".join(sorted(set("".join(fn.text.IMAGE_HINTS + fn.text.GREETING_HINTS + ["www."])) - {"."}))
    same = " || ".join(f"c rlike '(?iuU){x}'" for x in letters).replace("||", "or")
    found = spark.createDataFrame([(c,) for c in chars], "c string").where(same).collect()
    assert {r.c for r in found} <= set(fn.text.ODD_LETTERS)


def test_steps_left_out_change_nothing(spark):
    """The chain equals all of its steps one after the other, also for odd letters and signs without what they belong to."""
    rng = random.Random(9)
    parts = ["image", "ıMAGEN", " ", "ſvg", ".png", "!", "=", "alt = ", "width=3", "<", "<ımg ", "src>", "[a|http://x]",
             "![", "](x)", "www.", "WWW.é", "hola", "buen dıa", "saludoſ", "\x85", "\xa0", "\n", ".", "é", "한", "K", "ab", " cd "]
    texts = [("".join(rng.choices(parts, k=rng.randint(0, 20))),) for _ in range(3000)]

    def all_steps(text):
        steps = (
            fn.strip_smart_links, fn.strip_image_embeds, fn.strip_markdown_images, fn.strip_img_tags,
            fn.strip_image_filenames, fn.strip_image_attrs, fn.strip_urls, fn.strip_image_words, fn.fold_text,
            fn.strip_greetings, fn.drop_first_words,
        )
        for step in steps:
            text = step(text)
        return text

    df = spark.createDataFrame(texts, "text string").repartition(8)
    df = df.select("text", fn.clean_description(F.col("text")).alias("got"))
    step_by_step = df.select("text", "got", all_steps(F.col("text")).alias("expected"))
    assert step_by_step.where("got != expected").collect() == []
