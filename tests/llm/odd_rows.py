"""Rows that every operator must take."""

#: Null and empty texts, blanks, a very long text, repeated rows and a missing id.
ODD = (
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "Word " * 30_000),
    (5, "one two three"),
    (5, "one two three"),
    (None, "one two three"),
    (None, None),
    (6, "ﬁ Ünïcode İstanbul ſecret ▁ x  y"),
)
