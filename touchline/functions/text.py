"""Text and identity expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't tell teams of an index apart.
NOISE = ("fc", "afc", "cf", "sc", "ac", "ca", "rc", "rcd", "ssc", "cfc", "us", "as", "ss", "ud", "sd", "cd", "bv", "sbv", "sv", "vv", "ogc", "aj", "es", "asc", "calcio", "balompie", "futbol", "fussball", "club", "de", "del", "der", "the", "and")
#: Legal forms at either end of a name.
LEGAL = ("ac", "acf", "afc", "as", "bc", "ca", "cf", "fc", "fsv", "osc", "rc", "sc", "sco", "ss", "ssc", "stade", "ud", "us", "vfb")
#: Affixes before and after a name.
AFFIX_PATTERN = r"(?i)^(afc|cf|1\.)\s+|\s+(fc|afc|cf|sc)$"
#: Legal forms and numbers before the first other word of a normalised name, and after the last (years at most).
LEADING, TRAILING = f"^(({'|'.join(LEGAL)}|[0-9]+)( |$))+", f"(( |^)({'|'.join(LEGAL)}|[0-9]{{1,4}}))+$"
#: Sentiment keywords.
POSITIVE = ("the", "and", "in")
NEGATIVE = ("of", "on", "er")


@cache
def decomposed() -> tuple[str, str, str, dict[str, str]]:
    """What compatibility decomposition without combining marks makes of characters, where that leaves ASCII letters or digits or nothing:
    those that become one character, these characters, those that go, and those that become several."""
    one, plain, gone, several = [], [], [], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        to = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if to == "":
            gone.append(c)
        elif to != c and any(x.isascii() and x.isalnum() for x in to):
            if len(to) == 1:
                one.append(c)
                plain.append(to)
            else:
                several[c] = to
    return "".join(one), "".join(plain), "".join(gone), several


def unaccented(text: Column) -> Column:
    """Compatibility decomposition without combining marks, as far as it leaves ASCII letters and digits."""
    one, plain, gone, several = decomposed()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    # few texts have a character that becomes several
    spelled = F.when(text.rlike(f"[{''.join(several)}]"), F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], c)), "")).otherwise(text)
    return F.translate(spelled, one + gone, plain)


def normalised(name: Column) -> Column:
    """Accents off, lower case, everything but a-z and 0-9 to single spaces."""
    return F.trim(F.regexp_replace(F.lower(unaccented(name)), "[^a-z0-9]+", " "))


#: Club designators at the beginning and at the end of a name, as whole words.
CLUB_BEFORE = r"^(a f c|c f)( |$)|^(afc|cf) "
CLUB_AFTER = r"((^| )a f c|(^| )(f c|c f|s c)| (football|soccer) club| (footballclub|soccerclub|afc|fc|cf|sc))$"


def club_key(name: Column) -> Column:
    """The letters and digits of a name without a club designator at either end; accented letters only separate, as providers spell them alike."""
    words = F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " "))
    return F.replace(F.regexp_replace(F.regexp_replace(words, CLUB_BEFORE, ""), CLUB_AFTER, ""), F.lit(" "), F.lit(""))


def tokens(name: Column) -> Column:
    """Words of a name but noise and numbers of up to four digits."""
    return F.filter(F.split(normalised(name), " "), lambda w: ~w.isin(*NOISE) & ~w.rlike("^[0-9]{1,4}$") & (w != ""))


def without_affixes(name: Column) -> Column:
    """Lower case without a club affix at either end; a name of nothing else stays."""
    cut = F.trim(F.regexp_replace(F.trim(name), AFFIX_PATTERN, ""))
    return F.lower(F.when(cut == "", F.trim(name)).otherwise(cut))


def identity_key(name: Column) -> Column:
    """The normalised name without legal forms and founding years at its ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalised(name), LEADING, ""), TRAILING, ""))


def stable_id(*parts: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def sentiment(text: Column) -> Column:
    """(positive - negative) / (positive + negative) keywords that occur; 0 without any."""
    hits = lambda words: sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))
    pos, neg = hits(POSITIVE), hits(NEGATIVE)
    return F.coalesce(F.try_divide(pos - neg, pos + neg), F.lit(0.0))


def redacted(text: Column) -> Column:
    """Secrets in query strings and assignments replaced."""
    return F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password|ref)=([^&\s]+)", "$1=***")
