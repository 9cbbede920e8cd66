"""Rows and helpers that the tests of this folder share."""

LONG = "lorem ipsum " * 20_000
#: Nulls in every column, empty and blank texts, a very long text, repeated rows, ties, and columns that clash with inner names.
ROWS = [
    (1, "a  b", "en", "s0", 0), (1, "a  b", "en", "s0", 0), (2, "a b", None, None, None), (3, None, "de", "s1", 1), (4, "", "de", "s1", 1),
    (5, " \n\t ", "fr", "s1", 2), (None, "a b", "en", "s2", 3), (None, None, None, None, None), (6, LONG, "en", "s0", 4),
    (7, LONG + " ", "en", "s0", 5), (8, "Éte ﬁ 🤖 \x00   x", "fr", "s0", 6), (9, "the last one", "en", "s0", 7),
]
SCHEMA = "doc_id long, text string, lang string, key string, rank long"


def blank_words(text):
    """Words between ASCII white space, A-Z in lower case, without the code under test."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out
