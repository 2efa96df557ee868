"""Small documents with the cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n_words string"


def documents(seed: int = 5, n: int = 60) -> list[tuple]:
    """Seeded prose with exact and near copies, shared passages, nulls, empty and long texts, repeated rows, odd white space."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(150)]
    words = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, long_text = " ".join(words(80)), "\n".join(" ".join(words(40)) for _ in range(60))
    texts = [None, "", "  \t\n ", "one", "two words", "Three Word Text", long_text, long_text + " more", passage]
    texts += [f"{' '.join(words(r.randint(5, 90)))}\n{passage if r.random() < 0.4 else ''}\x0b{' '.join(words(20))}" for _ in range(n)]
    texts += [t.replace(" ", "  ", 3) if t else t for t in texts[9:20]] + texts[9:14]
    near = [t.split(" ") for t in texts[20:30]]
    for w in near:
        w[len(w) // 2] = "edited"
    texts += [" ".join(w) for w in near]
    rows = [(i, t, "en", "src0" if i % 3 else f"src{i}", None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, texts[15], None, None, 1, None, None), (3, "another text with an id that is used", "en", "src1", 1, "x", "y")]
    return rows
