"""Documents with every odd case: nulls, empty and very long texts, copies, ties and clashing columns."""

import random

#: Columns of documents and some whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, removed int, score string, n_tokens string, slot string, lang_pred int, node int, print string"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = words(1, 120)
    parts = base.split()
    near = " ".join(parts[:60] + ["Changed"] + parts[61:])
    texts = [
        (1, base),
        (2, base),  # copy
        (3, near),
        (4, base.upper()),  # same words after lowering
        (5, words(2, 80)),
        (5, words(2, 80)),  # repeated row
        (6, words(2, 80) + " " + " ".join(parts[:30])),
        (7, None),
        (8, ""),
        (9, " \n\t "),
        (10, "one"),
        (11, "ONE"),
        (12, "one two three four"),
        (None, base),
        (None, None),
        (13, "x" * 60_000),
        (14, "é" * 40 + " " + "ñandú 🙂 日本語 " * 10),
        (15, ("la la " * 4000).strip()),
        (16, words(3, 30_000)),
        (17, "12345 !!! ... --- 678"),
        (18, "é" * 40 + " " + "ñandú 🙂 日本語 " * 10 + "end<|endoftext|> 's ' ll"),
        (-4, "a  b   c \n\n d\t\te "),
    ]
    return [(i, t, "en", "s", len(t or ""), "k", 1, "s", "t", "sl", 3, 9, "p") for i, t in texts]
