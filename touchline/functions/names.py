"""Keys of names: accents, marks, ligatures and letter forms of any script's Latin characters go by Unicode's own decompositions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(ch: str) -> str:
    """Compatibility decomposition without combining marks, in lower case."""
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)).lower()


@lru_cache(maxsize=1)
def tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters beyond ASCII that become one ASCII character, followed by marks that go; what the first become; and those of the
    Latin, ligature and Roman number blocks that become several letters. All follow from the decompositions."""
    one, marks, several = {}, [], []
    for at in (*range(0x80, 0xAC00), *range(0xF900, 0x1F200)):
        ch = chr(at)
        if 0xD800 <= at < 0xE000:
            continue
        plain = _plain(ch)
        if not plain and unicodedata.combining(ch):
            marks.append(ch)
        elif len(plain) == 1 and plain.isascii():
            one[ch] = plain
        elif len(plain) > 1 and (at < 0x250 or 0x2160 <= at < 0x2180 or 0xFB00 <= at < 0xFB07) and (spelled := "".join(x if x.isascii() and x.isalnum() else " " for x in plain)).strip():
            several.append((ch, spelled))
    return "".join([*one, *marks]), "".join(one.values()), several


def folded(name: Column) -> Column:
    """Lower case, decomposed, without combining marks; a null is an empty text."""
    start, to, several = tables()
    low = F.lower(F.coalesce(name.cast("string"), F.lit("")))
    spelled = low
    for ch, plain in several:
        spelled = F.replace(spelled, F.lit(ch), F.lit(plain))
    spelled = F.when(low.rlike("[" + "".join(ch for ch, _ in several) + "]"), spelled).otherwise(low)
    return F.when(spelled.rlike(r"[^\x00-\x7F]"), F.translate(spelled, start, to)).otherwise(spelled)


def name_key(name: Column) -> Column:
    """The key by which names are compared: folded, `&` as `and`, apostrophes kept, all else between words as one blank."""
    return F.btrim(F.regexp_replace(F.replace(folded(name), F.lit("&"), F.lit(" and ")), "[^a-z0-9']+", " "))


def plain_key(name: Column) -> Column:
    """The stricter key: folded, letters and digits only, one blank between words."""
    return F.btrim(F.regexp_replace(folded(name), "[^a-z0-9]+", " "))


def competition_key(name: Column) -> Column:
    """plain_key(); every kind of world cup is one."""
    key = plain_key(name)
    return F.when(F.contains(key, F.lit("world cup")), "world cup").otherwise(key)
