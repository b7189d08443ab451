"""Keyed, type-consistent surrogates for personal data, distinct for distinct data (problem 9)."""

from __future__ import annotations

import hashlib
import hmac
import os
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.llm import pii
from tesseral.operators.skew import salted_join
from tesseral.session import cut_lineage

def run_key() -> str:
    """The key from the environment variable TESSERAL_PII_KEY; where it is unset a new one, known to this run alone."""
    return os.environ.get("TESSERAL_PII_KEY") or secrets.token_hex(32)


#: Rounds of new surrogates for those that collide; more than this means that the key space is used up.
MAX_ROUNDS = 20
#: From this round on numbers get more digits.
LONGER_FROM = 10
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[PERSON]"}

# Syllables that surrogate names are made of, by script; the last ones carry the gender.
_SYLLABLES = {
    "latin": ("ba be bi bo da de do fa fe ga ge ka ke ki la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se si ta te ti to va ve vi vo za ze".split(), {"f": ["la", "na", "ra", "sia"], "m": ["lo", "rin", "mas", "dor"], "": ["len", "ris", "nel", "ray"]}, ["berg", "dale", "field", "mann", "sen", "ton", "vik", "wood"]),
    "cyrillic": ("ба бе би да де ла ле ма ме на не ра ре са се та те ва ве".split(), {"f": ["на", "ра"], "m": ["рин", "дор"], "": ["лен", "рис"]}, ["ков", "вич", "ский", "ин"]),
    "han": ("田 山 川 森 林 石 木 水 高 小 大 中 北 南".split(), {"f": ["子", "美"], "m": ["郎", "男"], "": ["真", "光"]}, ["田", "川", "本", "村"]),
    "kana": ("ア イ カ キ サ シ タ ナ ハ マ ヤ ラ ミ ル".split(), {"f": ["コ", "ミ"], "m": ["ロウ", "オ"], "": ["ル", "ン"]}, ["タ", "カワ", "モト", "ムラ"]),
}


def _stream(kind: str, canon: str, attempt: int, key: str) -> Iterator[int]:
    """Endless bytes from the key, the kind and the datum: the same for the same datum in every text and run."""
    block = 0
    while True:
        yield from hmac.new(key.encode(), f"{kind}|{canon}|{attempt}|{block}".encode(), hashlib.sha256).digest()
        block += 1


def _script(word: str) -> str:
    """The script whose syllables a word's surrogate is made of; "other" for all without a table of their own."""
    import regex

    for name, rx in (("han", r"\p{Han}"), ("kana", r"[\p{Katakana}\p{Hiragana}]"), ("cyrillic", r"\p{Cyrillic}"), ("latin", r"\p{Latin}")):
        if regex.search(rx, word):
            return name
    return "other" if regex.search(r"\p{L}", word) else "latin"


@lru_cache(maxsize=4096)
def _alphabet(letter: str) -> str:
    """The letters of the same script and kind near a letter, which may stand in its place."""
    near = range(ord(letter) & ~0x7F, (ord(letter) & ~0x7F) + 0x80)
    # plain letters are named alike but for the last word
    named = lambda c: unicodedata.name(c, "").rpartition(" ")[0]
    return "".join(c for c in map(chr, near) if c.isalpha() and named(c) == named(letter))


def _like(word: str, bits: Iterator[int]) -> str:
    """A word of as many letters of the same script; marks and the rest stay."""
    return "".join(a[next(bits) % len(a)] if c.isalpha() and (a := _alphabet(c)) else c for c in word)


# Fixed value: the control letters of Spanish identity numbers, by the number's remainder of 23.
_DNI = "trwagmyfpdxbnjzsqvhlcke"


def _checked(made: str, canon: str) -> str:
    """The surrogate of a Spanish identity number with its right control letter, where the datum had it."""
    for s in (canon, made):
        n = s[:-1].translate(str.maketrans("xyz", "012"))
        if not (len(s) == 9 and s[-1].isalpha() and n.isdigit()):
            return made
    right = lambda s: _DNI[int(s[:-1].translate(str.maketrans("xyz", "012"))) % 23]
    return made[:-1] + right(made) if canon[-1] == right(canon) else made


def _calling_code(digits: str) -> int:
    """How many of the digits of a number in international form are the country's; 0 for a national one."""
    if len(digits) < 11 or digits[0] == "0":
        return 0
    if digits[0] in "17":
        return 1
    # The calling codes of two digits; all others have three.
    two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
    return 2 if digits[:2] in two else 3


def _word(script: str, gender: str | None, bits: Iterator[int]) -> str:
    """A given name (by gender) or, for None, a family name."""
    syllables, given, family = _SYLLABLES[script]
    n = 2 if script in ("latin", "cyrillic") else 1
    last = family if gender is None else given.get(gender, given[""])
    return "".join(syllables[next(bits) % len(syllables)] for _ in range(n + (gender is None))) + last[next(bits) % len(last)]


def surrogate(kind: str, canon: str, gender: str, attempt: int = 0, key: str = "") -> str:
    """The surrogate of a datum in its canonical form: as many words, digits and letters, of the same script.

    Numbers keep their country's calling code, identity numbers their leading letter's kind and a valid control letter;
    addresses of one mail host go to one host.
    """
    bits = _stream(kind, canon, attempt, key)
    if kind == "person_name":
        words = canon.split()
        # single letters stay single letters
        out = [_like(w, bits) if _script(w) == "other" else _word(_script(w), gender if i < max(1, len(words) - 1) else None, bits)[: None if len(w) > 1 else 1] for i, w in enumerate(words)]
        return " ".join(out)
    if kind == "email":
        host = _stream("host", canon.rpartition("@")[2], 0, key)
        return "".join(_word("latin", "", bits) for _ in range(2)) + str(next(bits) * 256 + next(bits)) + "@" + "".join(_word("latin", "", host) for _ in range(2)) + ".invalid"
    # digits become digits and letters letters; 0 at the front stays, so that a number keeps its kind
    out = []
    kept = _calling_code(canon) if kind == "phone" else 0
    for i, c in enumerate(canon):
        if i < kept or kind == "id_number" and i == 0 and c in "xyz" and canon[1:2].isdigit():
            out.append(c)
        elif c.isdigit():
            out.append("0" if c == "0" and i == 0 else str(next(bits) % 10))
        elif c.isalpha() and kind == "id_number":
            out.append(chr(97 + next(bits) % 26))
        else:
            out.append(c)
    # where all numbers of this length are taken, longer ones follow
    text = "".join(out) + "".join(str(next(bits) % 10) for _ in range(attempt - LONGER_FROM + 1))
    if kind == "id_number":
        text = _checked(text, canon)
    if kind == "street_address":
        stay = {w for r in (pii.STREET, pii.STREET_CAPITAL) for w in r.lower().split("|")} | set("flat unit apt rue calle plaza avda avenue impasse bd bis de la del des du c am hinterhaus bajo cottage".split())
        text = " ".join(w if w in stay or any(ch.isdigit() for ch in w) or len(w) < 3 else _like(w, bits) if _script(w) == "other" else _word(_script(w), None, bits) for w in text.split())
    return text


def render(kind: str, surface: str, canon: str, made: str) -> str:
    """The surrogate in the form of one mention: order, initials, capitals, separators."""
    import regex

    if kind == "email":
        local, _, host = made.partition("@")
        text = surface if "@" not in surface else None
        if text is None:
            out = f"{local}@{host}"
        else:
            at = regex.search(r"\s?[\[({<]\s?(?:at|@|arroba)\s?[\])}>]\s?| at ", surface, regex.I)
            dot = regex.search(r"\s?[\[({<]\s?dot\s?[\])}>]\s?| dot ", surface, regex.I)
            out = local + (at.group() if at else "@") + host.replace(".", dot.group() if dot else ".")
        return out.upper() if surface.isupper() else out
    if kind in ("phone", "id_number"):
        chars = [c for c in made if c.isalnum()]
        places = sum(c.isalnum() for c in surface)
        # a mention may carry more than the canonical form, such as 00 before or (0) inside: those digits stay
        spare, out = places - len(chars), []
        for c in surface:
            if not c.isalnum():
                out.append(c)
            elif spare > 0 and c in "0０":
                out.append(c)
                spare -= 1
            else:
                x = chars.pop(0) if chars else "0"
                out.append(x.upper() if c.isupper() else x)
        return "".join(out + chars)
    words, names = regex.findall(r"\p{L}[\p{L}\p{M}]*|\p{N}+\p{L}?", surface), made.split()
    olds = canon.split()
    low = [w.lower() for w in words]

    def match(i: int) -> str:
        w = low[i]
        for o, n in zip(olds, names):
            if w == o or kind == "person_name" and len(w) == 1 and o.startswith(w):
                return n
        return words[i]

    new = iter([_cased(n[0] if len(w) == 1 and kind == "person_name" and n.lower() != w.lower() else n, w) for w, n in ((w, match(i)) for i, w in enumerate(words))])
    return regex.sub(r"\p{L}[\p{L}\p{M}]*|\p{N}+\p{L}?", lambda m: next(new), surface)


def _cased(new: str, old: str) -> str:
    if len(old) > 1 and old.isupper():
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def assign(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, made): one surrogate for each distinct datum, no two alike and none that is itself a datum.

    Data are made distinct before the shuffle; a person's gender is the one most mentions show, by a title, else the one
    that the given name has with others. In each
    round the surrogates that collide are made again with the next attempt, all but the one of the smallest datum;
    rounds work on the colliding rows alone.
    """
    counts = found.groupBy("kind", "canon").agg(
        F.sum((F.col("gender") == "f").cast("int")).alias("f"), F.sum((F.col("gender") == "m").cast("int")).alias("m")
    )
    named = counts.select("kind", "canon", F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("").alias("own"), F.substring_index("canon", " ", 1).alias("_given"))
    # a given name that most bearers with a title have as women, or as men, tells the gender of the others
    person = (F.col("kind") == "person_name") & (F.length("_given") > 1)
    by_name = named.where(person & (F.col("own") != "")).groupBy("_given").agg((F.sum(F.when(F.col("own") == "f", 1).otherwise(-1))).alias("_n")).where("_n <> 0")
    both = named.join(by_name, "_given", "left")
    learned = F.when(person & (F.col("_n") > 0), "f").when(person & (F.col("_n") < 0), "m").otherwise("")
    data = cut_lineage(both.select("kind", "canon", F.when(F.col("own") != "", F.col("own")).otherwise(learned).alias("gender")))

    def make(attempt: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(made=[surrogate(k, c, g, attempt, key) for k, c, g in zip(pdf["kind"], pdf["canon"], pdf["gender"])])

        return run

    schema = "kind string, canon string, gender string, made string"
    real = data.select("kind", F.col("canon").alias("made"))
    done, todo = None, data
    for attempt in range(MAX_ROUNDS):
        new = cut_lineage(todo.mapInPandas(make(attempt), schema))
        taken = real if done is None else real.unionByName(done.select("kind", "made"))
        free = new.join(taken, ["kind", "made"], "left_anti")
        first = free.groupBy("kind", "made").agg(F.min("canon").alias("canon"))
        kept = cut_lineage(first)
        done = kept if done is None else done.unionByName(kept)
        todo = new.join(kept.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", "gender")
        if not todo.limit(1).count():
            return done
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} rounds")


def pseudonymised(docs: DataFrame, people: DataFrame, public: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Every mention with its surrogate: the columns of ``pii.mentions`` and replacement.

    All forms of one datum get one surrogate, in the form of the mention; data that differ get different ones. A person
    with a third of all mentions is a hot key of the join, which is salted.
    """
    found = cut_lineage(pii.mentions(docs, people, public))
    made = assign(found, key or run_key())
    both = salted_join(found, made, ["kind", "canon"], "inner", spread=["doc_id", "start_pos"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["replacement"] = [render(k, s, c, m) for k, s, c, m in zip(pdf["kind"], pdf["surface"], pdf["canon"], pdf["made"])]
            yield pdf.drop(columns="made")

    columns = [c.split()[0] for c in pii.MENTION.split(", ")]
    return both.select(*columns, "made").mapInPandas(run, f"{pii.MENTION}, replacement string")


def redacted(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, text, surrogate_text): each mention replaced by its typed placeholder, or by its surrogate; all else unchanged.

    Texts without mentions come out as they are, null as null.
    """
    spans = mentions.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start_pos", "end_pos", "kind", "replacement"))).alias("spans"))

    def cut(text: str, spans: list, word) -> str:
        out, at = [], 0
        for s in spans:
            out += [text[at : s["start_pos"]], word(s)]
            at = s["end_pos"]
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, t, t) if s is None or t is None else (d, cut(t, s, lambda x: PLACEHOLDERS[x["kind"]]), cut(t, s, lambda x: x["replacement"])) for d, t, s in zip(pdf["doc_id"], pdf["text"], pdf["spans"])]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "surrogate_text"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "doc_id", "left")
    return whole.mapInPandas(run, "doc_id long, text string, surrogate_text string")
