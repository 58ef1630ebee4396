"""Small inputs and plain restatements of the operators."""

import random
import re

WORDS = [f"w{i}" for i in range(300)]
#: Names that the operators use inside.
CLASHING = ("h", "grp", "batch", "id", "class", "gone", "__gone", "pad", "__pad", "__text", "__raw", "__rest", "__id", "spans", "base", "n", "s", "copies", "key", "data", "content", "chars", "tokens", "candidates", "r", "kept", "part", "component_id")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def documents(spark, texts, parts=3):
    """A table of documents with extra columns whose names the operators also use inside."""
    rows = [(i, t, "en", "src0", len(t or ""), *CLASHING) for i, t in (texts.items() if isinstance(texts, dict) else texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_texts():
    """Nulls, empty and blank texts, copies, near copies, ties and a very long text."""
    rng = random.Random(7)
    base = [text(rng, n) for n in (3, 5, 40, 120, 200)]
    out = {0: None, 1: "", 2: " \n\t", 3: "Hello", 4: "hello ", 5: "a b c d", 6: "A  B c d", 7: "a b c d e"}
    for k, b in enumerate(base * 3):
        out[10 + k] = b + (" " if k % 3 == 1 else "")
    for k in range(20):
        words = base[k % 5].split()
        words[rng.randrange(len(words))] = rng.choice(WORDS)
        out[40 + k] = " ".join(words)
    out[90] = text(rng, 6000)
    out[91] = "É日本 👍 " * 5
    return out


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")
