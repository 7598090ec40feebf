"""Small tables with the awkward cases, and brute-force versions."""

from __future__ import annotations

import random

WORDS = "river stone light carry under window paper silver morning garden follow number simple letter music winter".split()


def texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empty and blank texts, repeats, near copies, shared passages, one long text, other scripts."""
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    base = [line(rng.randrange(5, 60)) for _ in range(25)]
    out: list[tuple[int | None, str | None]] = list(enumerate(base))
    passage = line(20)
    for i in range(6):
        out.append((100 + i, f"{line(12)} {passage} {line(9)}"))
    long = line(40)
    for i in range(8):
        words = long.split()
        words[rng.randrange(40)] = f"edit{i % 3}"
        out.append((200 + i, " ".join(words)))
    for i in range(12):
        out.append((300 + i, base[3] if i % 2 else base[3].upper()))
    out += [(400, None), (401, ""), (402, " \n\t "), (403, None), (404, "x"), (405, "X"), (406, "ÄÖ Straße ΣΑΣ İx 日本語 😀"), (407, "äÖ Straße ΣΑΣ İx 日本語 😀"), (408, "one two"), (409, "One  TWO")]
    out += [(500, "word " * 30_000), (501, line(4000))]
    rng.shuffle(out)
    return out


def frame(spark, rows, extra: bool = True):
    """documents of the rows; extra columns have names that operators might use inside."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id bigint, text string")
    names = "__k maybe_repeated __gone __toxic __found __source __words __parts __long __id __h __n __row __key rid u tie block place p word marks key row keep".split()
    more = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), 1, "g", 5, {"a": i or 0}, *["?"] * len(names)) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, k string, size int, tags map<string, bigint>, " + ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame(more, schema).repartition(5)
