"""Small document tables with the awkward cases every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, fp string, a string, n_tokens string"


def rows(texts, langs=None):
    """Documents 0, 1, ... of these texts, with extra columns whose names clash with the operators' own."""
    return [(i, t, (langs or {}).get(i, "en"), "s", None if t is None else len(t), "h", "fp", "a", "n") for i, t in enumerate(texts)]


def docs(spark, texts, langs=None):
    return spark.createDataFrame(rows(texts, langs), SCHEMA)


def awkward():
    """Null, empty, blank, ties, repeats, one very long text, several scripts."""
    rng = random.Random(7)
    words = ["the", "tion", "Émile", "naïve", "straße", "don't", "x1", "2024", "..", "été", "日本語", "мир", "é", "a b", "<|endoftext|>", "Σας", "I'll", "\U0001f600"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    return [None, "", "   \n\t ", "one", "one two", "ONE Two", base, base, base + " end", base.replace("tion", "sion", 1), prose(20_000), "a\n\nb  c", prose(60) + "\n" + prose(60), " lead", "tail ", "\x1c\x1d odd \x85 spaces", None]


def messy(spark, texts):
    """The same with a null doc_id and a repeated row."""
    got = rows(texts)
    return spark.createDataFrame([*got, got[6], (None, texts[6], None, None, None, None, None, None, None)], SCHEMA)
