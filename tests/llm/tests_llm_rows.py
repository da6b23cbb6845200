"""Rows with nulls, empty and long texts, copies and repeated rows."""


def awkward_rows():
    return [
        (1, "a clean text of several words that stays", "en", "a", 40),
        (3, None, None, None, None),
        (4, "", "fr", "a", 0),
        (6, "123 %% 456", "de", None, 10),
        (7, "long words here " * 5000, None, "b", None),
        (8, "same text of five words or so", "en", "b", 3),
        (8, "same text of five words or so", "en", "b", 3),
        (9, "Same text, of five words or so!", "en", "b", 3),
        (None, "text without an id but with words", "en", "b", 3),
    ]
