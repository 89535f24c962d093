"""Awkward documents shared by the tests of the subpackage."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, score string"


def awkward_texts() -> list[str | None]:
    """Nulls, empty and odd texts, copies, near copies, shared passages, one very long text."""
    rng = random.Random(11)
    words = ["".join(rng.choices("aeinrst", k=rng.randint(1, 7))) for _ in range(300)]
    plain = [" ".join(rng.choices(words, k=rng.randint(5, 120))) for _ in range(60)]
    passage = " ".join(rng.choices(words, k=55))
    shared = [f"{plain[i]} {passage} {plain[i + 1]}" for i in range(12)]
    near = [plain[3] + f" tail{i}" for i in range(8)]
    long = " ".join(rng.choices(words, k=6000))
    return [None, "", " ", "\n\t ", "a", "Tab\there  two   spaces \n\n end ", "é漢字 😀 ½ x y z\x1cq",
            *plain, *[plain[0]] * 25, *shared, *near, long, long + " more", None, ""]


def documents(spark, texts=None, ids=None):
    texts = awkward_texts() if texts is None else texts
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", 7, "clash", "clash") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def stored(docs, folder) -> str:
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


# --- the cutting rule of fingerprints, in Python ---
def chosen(mask, *units):
    import xxhash

    seed = 42
    for unit in units:
        seed = xxhash.xxh64_intdigest(unit.encode(), seed)
    return seed & mask == 0


def after_words(part):
    return re.split("\n ?", " ".join(w + "\n" * chosen(7, w) for w in part.split(" ")))


def after_characters(part):
    return "".join(c + "\n" * chosen(31, *part[max(0, i - 2):i + 1]) for i, c in enumerate(part)).split("\n")


def evenly(part):
    return [part[i:i + 120] for i in range(0, len(part), 120)]


def paragraphs(text):
    found = re.split(r"(?<=[.!?])[ \t]+|\n+", text)
    for cut in (after_words, after_characters, evenly):
        found = [q for p in found for q in (cut(p) if len(p) > 120 else [p])]
    return {p for p in found if p}


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0
