"""Small tables with every edge case, and plain versions of the contracts."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{k % 997}x{k % 31}" for k in range(60_000))


def edge_rows():
    base = "the quick brown fox jumps over the lazy dog near the river bank every single morning of the year"
    return [
        (1, base), (2, base), (3, base + " again"), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one two three four"), (9, "one two three four"),
        (10, LONG), (11, LONG + " tail"), (12, "ünïcode wörds äre fïne hére tøo"), (13, base.upper()), (None, base), (14, "123 456 !!"), (2, base), (15, None, None, None),
        (16, "\n".join(["a line of its own", "a line of its own", "", "another line"])),
    ]


def shingles(text, k=5):
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def docs_of(spark, sf_dir, n=None):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows[:n]]
