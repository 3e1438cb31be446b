"""Small tables with nulls, empty and long texts, repeated rows and columns whose names clash."""

import math
import random
from decimal import Decimal

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, start bigint, chunk int, `_row` string, `a.b` string"
VOCABULARY = [a + b for a in ("ba", "lo", "mi", "ter", "sun", "ka") for b in ("na", "ri", "vo", "ste", "lu", "en", "o")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def odd_rows(seed: int = 5, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    rows = [(i, prose(r, r.randint(1, 80)), r.choice(["en", "de", None]), r.choice(["a", "b", "Z", None])) for i in range(10, 10 + n)]
    rows += [
        (1, None, "en", "a"), (2, "", None, "b"), (3, " \t\n ", "de", None), (4, "one two three", "en", "a"), (5, "one two three", "en", "a"),
        (6, prose(r, 20_000), "en", "b"), (7, "çé ü ’x’ 中文 <|endoftext|> It's", "fr", "b"), (8, "12 34 !!", None, "b"),
        (9, "again and again " * 30, "en", "a"), (9, "again and again " * 30, "en", "a"), (None, "a row without id", None, None), (None, None, None, None),
    ]
    return [(i, t, la, s, len(t) if t is not None else None, 0.5, 7, 3, "row", "dot") for i, t, la, s in rows]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return float(v) if isinstance(v, Decimal) else v


def table(rows, cols):
    """Rows as sorted tuples, columns by name."""
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
