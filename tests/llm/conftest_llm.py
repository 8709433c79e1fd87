"""Rows that every operator has to take."""

LONG = "Lorem ipsum dolor sit amet. " * 8000
# doc_id, text, lang, source: nulls, empty and very long texts, repeated rows, an id with two texts
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"), (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (1, "Ein ganz anderer Text mit derselben Nummer steht hier, nur etwas kürzer.", "de", "a"), (2, None, "en", None), (3, "", None, "b"), (None, "no id, but a text of its own", "en", "b"),
    (None, None, None, None), (4, LONG, "la", "c"), (5, LONG, "la", "c"), (6, " \n\t ", "en", "é"), (7, "Ünïcödé — naïve 日本語 text ‘quoted’ 👍", "de", "é"), (8, "12 34 !!", "en", "a"),
    (9, "one two", "en", "a"), (10, "one two", "en", "a"), (11, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "en", "a"), (12, "<|endoftext|> it's we've\r\n\r\n x", "en", "b"),
]
# Columns of an operator's own names must not disturb it.
CLASH = ["size", "row", "rank", "part", "digest", "keep_id", "first", "last_id", "piece", "length", "class", "node", "word", "block", "n", "kept", "score", "label", "h1", "taken", "copies"]
