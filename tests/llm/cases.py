"""Small document tables with the cases that every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, k string"


def documents(seed: int = 5, n: int = 60):
    """Invented documents with copies, near copies, shared passages, empty, null, short and long texts, and odd bytes."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["an", "er", "the", "on", "st", "é", "ing", "sch"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    passage = [" ".join(r.choice(vocabulary) for _ in range(r.choice([55, 80, 140]))) for _ in range(4)]
    texts = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 30, 90, 200, 700]))]
        if i % 3 == 0:
            at = r.randint(0, len(words))
            words[at:at] = r.choice(passage).split()
        texts.append(r.choice([" ", "\n", "\t "]).join(words))
    for i in range(0, n, 4):
        words = texts[i].split()
        for _ in range(max(1, len(words) // 60)):
            words[r.randrange(len(words))] = "CHANGED"
        texts.append(" ".join(words))
    texts += [texts[2], texts[2], texts[2], None, "", None, "  \n\t ", "one", "one", "One two", "again " * 700, "again " * 130, "\x1c wide space \x85 nul\x00in", "日本語の文章です。" * 120, "日本語の文章です。" * 150]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i * 3 - 20, texts[j], r.choice(["en", "de", None]), r.choice(["a", "b", "é", None, "hot", "hot", "hot"]), None if texts[j] is None else len(texts[j]), 1, "clash") for i, j in enumerate(order)]
