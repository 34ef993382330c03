"""Small planted tables for the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in that it is was for on with as this by from not have".split(),
    "de": "der die und das von mit nicht ein über für ist ßen wäre den im zu".split(),
}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 2))) for _ in range(n))


def documents(seed=0, n=60):
    """Prose of two languages with copies, near copies, empty and null texts, and one long text."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = "de" if k % 3 == 0 else "en"
        rows.append([k, "\n".join(prose(rng, lang, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))), lang, f"s{k % 2}"])
    for k in range(6):
        base = rows[k * 4][1].split(" ")
        near = base[:]
        near[len(near) // 2] = "changed"
        rows += [[n + 2 * k, rows[k * 4][1], "en", "copy"], [n + 2 * k + 1, " ".join(near), "en", "near"]]
    rows += [[900, None, None, None], [901, "", "en", "s"], [902, "7 !! 9", "en", "s"], [903, prose(rng, "en", 4000), "en", "long"]]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
