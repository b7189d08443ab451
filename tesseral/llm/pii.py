"""Personal information in free text: detection by form, context and a name table from the customers (problem 9).

The rules are written for support texts in English, German, French and Spanish, with Japanese names by honorifics and forms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.session import cut_lineage

#: Documents that one task of the detection reads, about.
DOCS_A_TASK = 4_000
MENTION = "doc_id long, kind string, start_pos int, end_pos int, surface string, canon string, gender string"

# Typographic variants, each replaced by one character, so that positions stay.
_VARIANTS = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | dict.fromkeys(map(ord, "\u00a0\u2007\u202f\u2009\u2002\u2003\u3000"), " ") | dict.fromkeys(map(ord, "\u2010\u2011\u2012\u2013\u2212"), "-") | dict.fromkeys(map(ord, "\u2019\u2018\u02bc"), "'")

# Words of the rules.
TITLES_F = r"Ms|Mrs|Miss|Frau|Madame|Mme|Mademoiselle|Mlle|señora|señorita|Sra|Srta"
TITLES_M = r"Mr|Mister|Herrn?|Monsieur|M|señor|Sr|Don"
TITLES_N = r"Dr|Prof|Mx"
PARTICLES = r"de la|de las|de los|van der|van den|van de|von der|von und zu|von|van|de|del|da|dos|di|du|la|le|el|al|bin|ibn|bint|ben|ter|ten|af|av|zu|y"
GREETINGS = r"Dear|Hi|Hello|Hey|Good (?:morning|evening|day)|Hallo|Guten (?:Tag|Morgen|Abend)|Liebe[r]?|Sehr geehrte[r]?|Bonjour|Bonsoir|Cher|Chère|Hola|Estimad[oa]|Querid[oa]|Buenos días|Buenas tardes"
CLOSINGS = r"Thanks|Thank you|Many thanks|Cheers|Regards|Kind regards|Best regards|Best wishes|Best|Yours sincerely|Yours faithfully|Sincerely|Yours|Warmly|Danke|Viele Grüße|Mit freundlichen Grüßen|Liebe Grüße|Beste Grüße|Gruß|Cordialement|Merci|Bien à vous|Amicalement|Un saludo|Saludos|Saludos cordiales|Atentamente|Gracias|Un abrazo"
NO_NAMES = frozenset(
    "sir madam all there team everyone both folks support office box customer guest agent the a an my our your this that these it he she they we you i not no order ticket tickets event hall desk nobody somebody someone anyone please bitte merci gracias danke hello hi dear and or und et y les la le el die der das un une ein eine und nous wir sie ich je on was is are were if in at by as of for with from doors card total nobody meet follow see send text call caller photo mi mon meine mein after before here had told found then who what when where".split()
)
CALENDAR = frozenset("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())
STREET = r"St|Street|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Rd|Road|Ln|Lane|Way|Close|Mews|Terrace|Crescent|Parkway|Pkwy|Highway|Hwy"
STREET_CAPITAL = r"Court|Ct|Place|Pl|Square|Sq|Row|Walk|Hill|Gardens|Grove|Park|Alley|Yard|Quay"
MONTHS = r"Jan|Feb|M[aä]r|Apr|Ma[iy]|Jun|Jul|Aug|Sep|O[ck]t|Nov|De[cz]"
ID_LABEL = r"social(?: security)?(?: (?:no|number))?|ssn|ni(?: (?:no|number))?|nino|national insurance(?: (?:no|number))?|national id(?:entity)?(?: card)?|id(?:entity)? card|passport(?: (?:no|number))?|passeport|pasaporte|reise ?pass(?:nummer)?|personalausweis|ausweis(?:nummer)?|führerschein|driv(?:ing|er'?s?) licen[cs]e|licen[cs]e (?:no|number)|permis(?: de conduire)?|carte d'identité|documento(?: de identidad)?|dni|nie|document"
ID_CONTEXT = r"wanted to see|asked (?:me )?(?:for|to see)|wollte|demandé|pidió|gave|documento es|pièce est|ausweisnummer ist|pass(?:nummer)? ist|(?:document|id|passport|licence) (?:number |no\.? )?is|attached|enclosed|show(?:ed)?"
PHONE_LABEL = r"phone|tel|telephone|mobile|cell|call|text me|number is|fax|whatsapp|teléfono|telefon|handy|téléphone|portable|joindre au|erreichen mich unter|says"


@lru_cache(maxsize=1)
def _rules() -> dict:
    import re

    import regex

    r = {}
    label = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    alnum = r"A-Za-z0-9_\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    local = rf"[{alnum}](?:[{alnum}.+'%-]{{0,63}}[{alnum}])?"
    dot = r"(?:\.|\s?[\[({<]\s?(?:dot|punto|punkt|point)\s?[\])}>]\s?)"
    at = r"\s?[\[({<]\s?(?:at|@|arroba)\s?[\])}>]\s?"
    spelled = rf"[{alnum}+-]{{1,64}}(?:(?:\.| dot )[{alnum}+-]{{1,64}}){{0,6}}"
    r["email"] = [
        regex.compile(rf"(?<![{alnum}.+%-]){local}(?:@| @ ){label}(?:\.{label})*\.[A-Za-z]{{2,}}(?![A-Za-z0-9_])", regex.I),
        regex.compile(rf"(?<![{alnum}.+%-])[{alnum}](?:[{alnum}+-]|{dot}){{0,80}}{at}{label}(?:{dot}{label}){{0,6}}{dot}[A-Za-z]{{2,}}(?![A-Za-z0-9_])", regex.I),
        regex.compile(rf"(?<![{alnum}.+%-]){spelled} at {label}(?: dot {label}){{0,6}} dot [A-Za-z]{{2,}}(?! (?:at|dot) )(?![A-Za-z0-9_@])", regex.I),
    ]
    r["url"] = regex.compile(r"(?:https?://|www\.)\S+|(?<![\w@])[@#][\w.]+")
    edge, stop = r"(?<![\p{L}\p{N}_#/=-])", r"(?![\p{L}\p{N}_]|-\p{N}|/\p{N})"
    forms = [
        r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",  # national insurance
        r"[A-Z]{2} ?\d{7}",  # passport
        r"\d{2}\.\d{3}\.\d{3}-?[A-Z]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]",  # Spanish identity cards
        r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}",  # social security
        r"(?=\p{L}+9* ?\d{6})[\p{L}9]{5} ?\d{6} ?[A-Z][A-Z0-9]\d[A-Z]{2}",  # driving licence
    ]
    r["id"] = regex.compile(f"{edge}(?:{'|'.join(forms)}){stop}", regex.I)
    r["id_cued"] = regex.compile(
        rf"(?:\b(?:{ID_LABEL})\b(?:\.?:?| ?\|)|(?:{ID_CONTEXT}))[ (|:]*(?:(?:{ID_LABEL})\.?:? *)?(?P<id>\d{{3}}[- ]?\d{{2}}[- ]?\d{{4}}|\d{{4}}[- ]?\d{{4}}[- ]?\d{{4}}|\d{{9}}){stop}", regex.I
    )
    # bounded, so that long runs of digits cost no more than their length
    r["phone"] = regex.compile(r"(?<![\p{L}\p{N}_#/=.:-])(?<!\p{Nd}[ .\-/])(?:\(?\+ ?|\()?\p{Nd}(?>(?>\.|[ \-/]{0,2}[()]?[ \-/]?)\p{Nd}){5,18}(?![ \-/]{0,2}\p{N}|\.\p{N})(?![\p{L}_%€$£]|[.,:-]\p{N})")
    r["phone_label"] = regex.compile(rf"(?:\b(?:{PHONE_LABEL})\b[ :(=|]*)$", regex.I)
    word = r"[\p{L}][\p{L}\p{M}'.-]*"
    flat = r"(?:Flat|Unit|Apt|Apartment|Suite|Ste|Floor|Room|Studio)\.? ?#?[A-Z]?\d*[A-Z]?"
    number = r"\d+[A-Z]?(?:-\d+[A-Z]?)?"
    ordinary = "|".join(sorted(NO_NAMES))
    inner = rf"(?:(?!(?:{ordinary})\b){word} ){{1,2}}"
    r["address"] = [
        regex.compile(rf"(?<![\p{{L}}\p{{N}}_-])(?:{flat},? )?{number} (?:[NSEW]{{1,2}}\.? )?{inner}(?:(?:{STREET})|(?-i:{STREET_CAPITAL}))\b(?:\.(?=,))?(?:,? {flat}(?![\p{{L}}\p{{N}}]))?", regex.I),
        regex.compile(rf"(?<![\p{{L}}\p{{N}}_])(?:\p{{Lu}}[\p{{L}}'-]+ ){{1,2}}(?:Cottage|House|Lodge|Farm|Manor|Barn|Villa|Hall), (?:\p{{Lu}}[\p{{L}}'-]+ ){{1,2}}(?:{STREET})\b"),
        regex.compile(rf"(?<![\p{{L}}\p{{N}}_])[\p{{L}}'-]+ cottage, (?:[\p{{L}}'-]+ ){{1,2}}(?:{STREET})\b", regex.I),
        regex.compile(
            rf"(?<![\p{{L}}\p{{N}}_-])(?:(?-i:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den|Hinter der) (?!{MONTHS})(?:\p{{L}}+e[nrms] )?\p{{L}}[\p{{L}}-]+|am (?!{MONTHS})\p{{L}}+en \p{{L}}+|[\p{{L}}-]*(?:gasse|stra(?:ß|ss)e|str\.|allee|weg|platz|ufer|damm|steig|pfad))"
            r" \d+(?: ?[a-z]\b)?(?![\p{L}\p{N}:]|[./]\p{N})(?:, (?:Hinterhaus|Vorderhaus|Seitenflügel|EG|DG|\d+\. ?(?:OG|Stock)|Whg\.? ?\d+))?",
            regex.I,
        ),
        regex.compile(r"(?<![\p{L}\p{N}_])\d+(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd\.?|impasse|place|allée|chemin|quai|route|cours|passage|square) (?:(?:de la|de l'|du|des|de|d') ?)?[\p{L}'-]+(?:, (?:b[âa]t(?:iment|\.)? ?\w+|appt?\.? ?\w+|esc(?:alier|\.)? ?\w+|\d+e étage))*", regex.I),
        regex.compile(r"(?<![\p{L}\p{N}_])(?:C/|Calle|Avda\.|Avenida|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Carrera|Travesía) ?(?:(?:del|de la|de los|de las|de) )?\p{L}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?,? (?:n\.?º ?)?\d+(?:, (?:\d+ ?[ºª°.] ?\p{L}?(?:\b|$)|bajo|ático|entresuelo|principal|izq\.?|dcha\.?))*", regex.I),
    ]
    # cheap tests, on the text in lower case, whether a rule can match at all
    # and if so where: a rule is tried only so far around its anchors
    r["email_hint"] = [(re.compile(p), a, b) for p, a, b in (("@", 80, 340), (r"[\[({<]\s?(?:at|@|arroba)\s?[\])}>]", 600, 600), (" dot ", 600, 600))]
    r["digits"] = re.compile(r"\d\d\d(?:[- ]?\d\d[- ]?\d{4}|\d[- ]?\d{4})")
    r["id_hint"] = (re.compile(r"\d(?:(?: ?\d){5}|\d\.\d{3}|\d\d[- ]\d\d[- ]\d{4})"), 24, 60)
    r["variants"] = re.compile("[" + "".join(map(chr, sorted(k for k in _VARIANTS if not 0xFF01 <= k < 0xFF5F))) + "\uff01-\uff5e]")
    r["letters"] = re.compile(r"[^\W\d_]+")
    r["address_hint"] = [
        (re.compile(p), before, after)
        for (before, after), p in zip(((90, 60), (80, 120), (80, 120), (100, 140), (60, 160), (20, 180)), (
            rf"\b(?:{STREET}|{STREET_CAPITAL})\b".lower().replace("\\B", "\\b"), r"cottage|house|lodge|farm|manor|barn|villa|hall", "cottage",
            r"\b(?:am|an de[rn]|auf de[mr]|im|in der|zum|zur|unter den|hinter der) |(?:gasse|stra(?:ß|ss)e|str\.|allee|weg|platz|ufer|damm|steig|pfad) \d",
            r"\b(?:rue|avenue|av\.|boulevard|bd\.?|impasse|place|allée|chemin|quai|route|cours|passage|square) ", r"c/|calle|avda|avenida|av\.|plaza|pza|paseo|p\.º|camino|ronda|carrera|travesía",
        ))
    ]
    # words without one of which a rule's anchors can't be there
    r["address_words"] = [
        frozenset(f"{STREET}|{STREET_CAPITAL}".lower().split("|")), frozenset("cottage house lodge farm manor barn villa hall".split()), frozenset(["cottage"]), None,
        frozenset("rue avenue av boulevard bd impasse place allée chemin quai route cours passage square".split()), None,
    ]
    # a name: given or family name or both, with initials and particles, in either order
    for case, first in (("cap", r"\p{Lu}"), ("low", r"\p{L}")):
        w = rf"{first}[\p{{L}}\p{{M}}]+(?:'(?!s\b){first}[\p{{L}}\p{{M}}]+)?"
        bound = rf"(?:(?i:{PARTICLES})[ -]|(?:al|el|Al|El)-)"
        unit = rf"(?:{w}(?:-{w})*|{first}\.)"
        r[case] = rf"{unit}(?:(?<=\.) ?{bound}?{unit}| {bound}?{unit}){{0,3}}(?:, {bound}?{unit}(?: {unit})?)?"
    cap, low = r["cap"], r["low"]
    title = rf"(?:(?:(?P<f>{TITLES_F})|(?P<m>{TITLES_M})|(?:{TITLES_N}))\.? )"
    end = r"(?= ?(?:[.,;:!?\n\"<(|]|$))"
    # words on the left, what must follow the name, and whether lower-case names are taken there
    left = [
        (rf"\b(?:{GREETINGS}),? ", r"(?= ?(?:[,:!\n]|$))", True),
        (rf"\b(?:{CLOSINGS})(?:[,!.]|\s*\n| -)\s*", r"(?=[ .]*(?:\n|$))", True),
        (r"-- ?\n", r"(?= *(?:\n|$))", True),
        (r"\b(?:full_name|name|holder|customer|contact|passenger|cc|from|attn)\b\"?(?::| ?=| ?\|) ?\"?", r"(?= ?(?:[\n;|\"<(]|$))", True),
        (r"\b(?:asked|written|signed|reported|sent|paid|booked|requested) by ", r"(?=[,.;\n]| [\p{Ll}(]|$)", True),
        (r"\b(?:name on the (?:booking|order|ticket|account) is|läuft auf(?: den namen)?|au nom de|a nombre de) ", end, True),
        (r"\b(?:instead of|held for|says|said|ask for|speak (?:to|with)|poster for|key is with|deliver to|care of|c/o|regards to|married to|belongs to|on behalf of) ", rf"(?:{end}|(?= (?:at|after|and|before|was|is|on|to|who|in)\b))", True),
        (r"\bthe (?:steward|usher|manager|caller|guest|agent|driver|cashier), ", r"(?=,)", True),
        (r"\b(?:our|the|my|your|her|his) (?:usher|steward|partner|husband|wife|son|daughter|brother|sister|mother|father|friend|colleague|neighbou?r|boss|cousin) ", r"(?= \p{Ll}|[.,;\n!?'])", True),
        (r"\b(?:both|i met|we met) ", r"(?= (?:and|in|at|were|was|on|about)\b)", True),
        (r"\b(?:queue|both [^\n.]{2,50}?),? and ", r"(?= (?:had|were|was)\b)", True),
        (rf"(?<![\w'])(?={TITLES_F}|{TITLES_M}|{TITLES_N})", r"(?![\p{L}\p{M}])", False),
    ]
    r["left"] = [re.compile(a, re.I) for a, _, _ in left]
    first = lambda words: {w.split()[0].split("_")[0].lower() for p in words for w in re.sub(r"\[.\]\??|\(\?:[^)]*\)", "", p).split("|") if w.strip()}
    lists = [
        {"good", "guten", "liebe", "lieber", "sehr", "estimado", "estimada", "querido", "querida", *first([GREETINGS])}, first([CLOSINGS]), set(),
        set("full name holder customer contact passenger cc from attn".split()), set("asked written signed reported sent paid booked requested".split()),
        set("name läuft au a".split()), set("instead held says said ask speak poster key deliver care c regards married belongs on".split()), {"the"},
        set("our the my your her his".split()), set("both i we".split()), set("queue both".split()),
        {w.lower() for t in (TITLES_F, TITLES_M, TITLES_N) for w in t.split("|")} | {"herrn", "herr"},
    ]
    r["triggers"] = {}
    for k, words in enumerate(lists):
        for w in words:
            r["triggers"].setdefault(w, []).append(k)
    need = ["?"] * (len(left) - 1) + [""]
    r["after"] = [(regex.compile(rf"(?i:{title}){n}(?P<n>{cap}){b}"), regex.compile(rf"{title}{n}(?P<n>{low}){end if i == 4 else b}", regex.I) if lower else None) for i, ((_, b, lower), n) in enumerate(zip(left, need))]
    # words on the right of a name that begins a sentence
    r["right"] = re.compile(
        r" was supposed|'s \w+ was| vive en| habite\b| wohnt\b| lives? (?:at|in|on)\b| here, from| paid with the same| had the same| \((?=[+(]?\d[^()\n]{0,4}[()]?[^()\n]{3,20}\)(?: has| is| was| will| hat| a | tiene))", re.I
    )
    lead = r"(?:^|\n|[.!?;:。…»\"] {0,2}|[^\p{L}\p{N}'\",-] |  )"
    r["before"] = (regex.compile(rf"{lead}(?P<n>{cap})$"), regex.compile(rf"{lead}(?P<n>{low})$"))
    r["cap_run"] = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_@.])(?:{cap})(?![\p{{L}}\p{{M}}\p{{N}}_@])")
    # Japanese: before an honorific, or where a form or a caller gives the name
    ja = r"(?:[\p{Han}々]{2,5}|[\p{Katakana}ー]{2,8}[・ ]?[\p{Katakana}ー]{0,8})"
    r["japanese"] = [regex.compile(rf"(?<![\p{{Han}}\p{{Katakana}}ー])(?P<n>{ja})(?= ?(?:様|さん|さま|氏(?![名\p{{Han}}])))"), regex.compile(rf"(?:お?名前は|氏名(?:は|[:：]) ?|名前[:：] ?)(?P<n>{ja})(?=です|でござい|と申し|[、。\s]|$)"), regex.compile(rf"(?<![\p{{Han}}\p{{Katakana}}ー])(?P<n>{ja})(?=と申します|と言います)")]
    r["kana"] = re.compile("[\u3041-\u30fa]")
    r["no_japanese"] = frozenset("皆 お客 客 担当者 担当 奥 旦那 子供 息子 娘 店員 駅員 係員 運転手 医者 先生 神 王".split())
    r["word"] = regex.compile(r"\p{L}[\p{L}\p{M}]*")
    r["particle"] = regex.compile(rf"(?:{'|'.join(sorted(set(PARTICLES.replace('|', ' ').split())))})", regex.I)
    r["low_pair"] = regex.compile(rf"(?<![\p{{L}}\p{{N}}_@.])(\p{{L}}[\p{{L}}\p{{M}}]+) {bound}?(\p{{L}}[\p{{L}}\p{{M}}]+)(?![\p{{L}}\p{{N}}_@])")
    return r


@dataclass
class _Span:
    kind: str
    start: int
    end: int
    gender: str = ""


def _around(rx, anchor: tuple, text: str, low: str):
    """The matches of ``rx`` near the anchor's own, from left to right; the windows around anchors are joined where they meet."""
    hint, before, after = anchor
    lo = hi = -1
    for m in hint.finditer(low):
        a, b = max(0, m.start() - before), m.end() + after
        if a > hi:
            if hi >= 0:
                yield from rx.finditer(text, lo, hi)
            lo = a
        hi = b
    if hi >= 0:
        yield from rx.finditer(text, lo, hi)


class _Claims:
    """Spans found so far; a later rule never takes characters of an earlier one."""

    def __init__(self, size: int):
        self.taken, self.spans = bytearray(size), []

    def free(self, a: int, b: int) -> bool:
        return a < b and not any(self.taken[a:b])

    def take(self, kind: str, a: int, b: int, gender: str = "") -> bool:
        if not self.free(a, b):
            return False
        self.taken[a:b] = b"\1" * (b - a)
        if kind:
            self.spans.append(_Span(kind, a, b, gender))
        return True


@lru_cache(maxsize=1)
def _phone_forms() -> dict:
    import re

    return {
        "no": re.compile(r"\(?\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d\b|(?:19|20)\d\d-\d\d-\d\d|\d{4}-\d{4}-\d{2,4}$"),
        "america": re.compile(r"(?:1[ .-]?)?\(?[2-9]\d\d\)?[ .-]?\d{3}[ .-]?\d{4}"),
        "short": re.compile(r"\d(?: \d){6,11}|\d{3}[ -]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{3}|\d{3}(?:[ .-]\d\d){3}"),
        "any": re.compile(r"[\d ().-]+"),
    }


def _is_phone(s: str, labelled: bool) -> bool:
    digits = "".join(c for c in s if c.isdigit())
    n, forms = len(digits), _phone_forms()
    if n < 7 or n > 16 or forms["no"].match(s):
        return False
    if s.lstrip("(").startswith("+"):
        return 8 <= n <= 15
    if digits.startswith("00") and digits[2:3] != "0" and 11 <= n <= 16:
        return True
    plain = s.isdigit()
    if digits.startswith("0") and digits[1:2] != "0":
        return 10 <= n <= (11 if plain else 12)
    if forms["america"].fullmatch(s):
        return not plain or n == 11 or labelled
    if forms["short"].fullmatch(s):
        return True
    return labelled and n <= 11 and bool(forms["any"].fullmatch(s))


def _phones(text: str, rules: dict, claims: _Claims) -> None:
    for m in rules["phone"].finditer(text):
        a, b = m.span()
        s = text[a:b]
        if s.startswith("(") and s.count("(") > s.count(")"):
            a, s = a + 1, s[1:]
        elif s.endswith(")"):
            b, s = b - 1, s[:-1]
        if b - a >= 7 and _is_phone(s, bool(rules["phone_label"].search(text[max(0, a - 30) : a]))):
            claims.take("phone", a, b)


def _stripped(text: str, a: int, b: int, rules: dict) -> tuple[int, int]:
    """The part of a..b up to the first word that is no name, without such words and particles at its ends."""
    words = [(a + m.start(), a + m.end()) for m in rules["word"].finditer(text[a:b])]
    low = [text[x:y].lower() + ("." if y - x == 1 and text[y : y + 1] == "." else "") for x, y in words]
    particle = [bool(rules["particle"].fullmatch(w)) for w in low]
    i = 0
    while i < len(words) and low[i] in NO_NAMES:
        i += 1
    j = i
    while j < len(words) and (low[j] not in NO_NAMES or particle[j] and j > i):
        j += 1
    whole = j == len(words)
    while j > i and particle[j - 1] and low[j - 1] in NO_NAMES:
        j, whole = j - 1, False
    if j <= i:
        return b, b
    if words[j - 1][1] < b and low[j - 1].endswith("."):
        words[j - 1] = (words[j - 1][0], words[j - 1][1] + 1)
    return words[i][0], b if whole else words[j - 1][1]


def _names(text: str, words: set[str], rules: dict, claims: _Claims, known: dict[str, tuple[bool, bool, bool]]) -> None:
    """known: lower-case word -> (given, family, safe); safe: hardly ever an ordinary word."""
    found: list[tuple[int, int]] = []

    def take(a: int, b: int, gender: str = "") -> None:
        a, b = _stripped(text, a, b, rules)
        if b - a > 1 and claims.take("person_name", a, b, gender):
            found.append((a, b))

    def is_name(s: str) -> bool:
        words = [w.lower() for w in rules["word"].findall(s)]
        return bool(words) and words[0] not in NO_NAMES and any(w in known for w in words)

    starts = []
    for w in words:
        kinds = rules["triggers"].get(w.lower())
        if kinds:
            at = text.find(w)
            while at >= 0:
                end = at + len(w)
                if not (at and text[at - 1].isalpha()) and not text[end : end + 1].isalpha():
                    starts += [(at, k) for k in kinds]
                at = text.find(w, end)
    at = text.find("--")
    while at >= 0:
        starts.append((at, 2))
        at = text.find("--", at + 2)
    for at, k in sorted(starts):
        m = rules["left"][k].match(text, at)
        if not m:
            continue
        cap, low = rules["after"][k]
        n = cap.match(text, m.end())
        if not n and low and (n := low.match(text, m.end())) and not is_name(n.group("n")):
            n = None
        if n:
            take(*n.span("n"), "f" if n.group("f") else "m" if n.group("m") else "")
    ends = [m.start() for m in rules["right"].finditer(text)] + [s.start - 2 for s in claims.spans if s.kind in ("street_address", "phone") and text[s.start - 2 : s.start] == ", "]
    for at in ends:
        part = text[max(0, at - 60) : at]
        cap, low = rules["before"]
        n = cap.search(part)
        if not n and (n := low.search(part)) and not is_name(n.group("n")):
            n = None
        if n:
            take(at - len(part) + n.start("n"), at)

    if not text.isascii() and rules["kana"].search(text):
        for rx in rules["japanese"]:
            for m in rx.finditer(text):
                if m.group("n") not in rules["no_japanese"]:
                    take(*m.span("n"))

    # words of the names found so far hold in the rest of this text
    lows = {w for w in words if w.islower()}
    here = dict(known)
    for a, b in list(found):
        ws = [w for w in rules["word"].findall(text[a:b]) if len(w) > 2 and w.lower() not in NO_NAMES and not rules["particle"].fullmatch(w)]
        for i, w in enumerate(ws):
            if w[0].isupper() and w.lower() not in lows and w.lower() not in here:
                here[w.lower()] = (i == 0, i > 0, True)

    caps = {w.lower() for w in words if not w.islower()}
    for m in rules["cap_run"].finditer(text) if not caps.isdisjoint(here) else ():
        if not any(w in here for w in rules["letters"].findall(m.group().lower())):
            continue
        a, b = m.span()
        b = a + (bytes(claims.taken[a:b]) + b"\1").index(1)
        parts = [(a + w.start(), a + w.end()) for w in rules["word"].finditer(text[a:b])]
        hits = [i for i, (x, y) in enumerate(parts) if text[x:y].lower() in here]
        if not hits:
            continue
        i, j = hits[0], hits[-1]
        if len(hits) == 1 and text[slice(*parts[i])].lower() in CALENDAR:
            continue
        facts = [here[text[parts[k][0] : parts[k][1]].lower()] for k in hits]
        pair = len(hits) > 1 and any(f[0] for f in facts) and any(f[1] for f in facts)
        if not pair and not any(f[2] for f in facts):
            continue
        # an unknown capitalised word beside a known given name is likely the family name
        if not pair and j + 1 < len(parts) and facts[-1][0] and text[parts[j][1] : parts[j + 1][0]] in (" ", "-") and text[parts[j + 1][0] : parts[j + 1][1]].lower() not in lows | NO_NAMES:
            j += 1
        while i > 0 and parts[i - 1][1] - parts[i - 1][0] == 1 and text[parts[i - 1][1] : parts[i][0]] in (". ", "."):
            i -= 1
        take(parts[i][0], parts[j][1])
    firsts = [w for w in lows if w in known and known[w][0]]
    if firsts and any(known[w][1] for w in lows if w in known):
        places = []
        for w in firsts:
            at = text.find(w)
            while at >= 0:
                places.append(at)
                at = text.find(w, at + 1)
        for at in sorted(places):
            m = rules["low_pair"].match(text, at)
            if m:
                x, y = (known.get(m.group(k).lower()) for k in (1, 2))
                if x and y and x[0] and y[1] and (x[2] or y[2]) and m.group(1).islower():
                    take(*m.span())


def _canon(kind: str, s: str) -> str:
    import regex

    low = s.lower()
    if kind == "email":
        low = regex.sub(r"\s?[\[({<]\s?(?:at|@|arroba)\s?[\])}>]\s?| at | @ ", "@", low)
        return regex.sub(r"\s?[\[({<]\s?(?:dot|punto|punkt|point)\s?[\])}>]\s?| dot ", ".", low)
    if kind == "phone":
        digits = "".join(c for c in regex.sub(r"\(0\)", "", low) if c.isdigit())
        return digits[2:] if digits.startswith("00") else digits
    if kind == "id_number":
        return "".join(c for c in low if c.isalnum())
    if kind == "street_address":
        return " ".join(regex.findall(r"[\p{L}\p{N}]+", low))
    if "," in low:
        low = " ".join(reversed([p.strip() for p in low.split(",", 1)]))
    return " ".join(w for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", low))


def _coreferent(canons: list[str]) -> dict[str, str]:
    """Within one text: a shorter form (one name, or an initial and a name) stands for the only longer one that it fits."""
    full = sorted({c for c in canons if len(c.split()) > 1 and len(c.split()[0]) > 1})
    out = {}
    for c in set(canons):
        words = c.split()
        if c in full:
            continue
        fits = [f for f in full if all(any(w == x or len(w) == 1 and x.startswith(w) for x in f.split()) for w in words)]
        if len(fits) == 1:
            out[c] = fits[0]
    return out


def detect(text: str | None, known: dict[str, tuple[bool, bool, bool]]) -> list[tuple[str, int, int, str, str, str]]:
    """(kind, start, end, surface, canon, gender) of each personal datum, in code points; nothing for null or empty texts."""
    if not text:
        return []
    rules = _rules()
    plain = text if text.isascii() or not rules["variants"].search(text) else text.translate(_VARIANTS)
    claims = _Claims(len(plain))
    low = plain.lower()
    if len(low) != len(plain):
        # a few capitals have longer lower forms; anchors must keep their places
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in plain)
    for anchor, rx in zip(rules["email_hint"], rules["email"]):
        for m in _around(rx, anchor, plain, low):
            claims.take("email", *m.span())
    for m in rules["url"].finditer(plain):
        claims.take("", *m.span())
    for m in _around(rules["id"], rules["id_hint"], plain, low):
        claims.take("id_number", *m.span())
    for m in _around(rules["id_cued"], (rules["digits"], 120, 40), plain, low):
        claims.take("id_number", *m.span("id"))
    words = set(rules["letters"].findall(plain))
    lows = {w.lower() for w in words}
    for anchor, rx, need in zip(rules["address_hint"], rules["address"], rules["address_words"]):
        if need is None or not need.isdisjoint(lows):
            for m in _around(rx, anchor, plain, low):
                claims.take("street_address", *m.span())
    _phones(plain, rules, claims)
    _names(plain, words, rules, claims, known)
    spans = sorted(claims.spans, key=lambda s: s.start)
    canons = [_canon(s.kind, plain[s.start : s.end]) for s in spans]
    same = _coreferent([c for s, c in zip(spans, canons) if s.kind == "person_name"])
    return [(s.kind, s.start, s.end, text[s.start : s.end], same.get(c, c) if s.kind == "person_name" else c, s.gender) for s, c in zip(spans, canons)]


_WORDS = r"\p{L}[\p{L}\p{M}]+"
#: The same, but for words inside addresses and codes.
_FREE_WORDS = r"(?<![\p{L}\p{N}@._+-])\p{L}[\p{L}\p{M}]+(?![\p{L}\p{N}@_+]|\.\p{L}| dot )"


def name_words(people: DataFrame, name: str = "full_name") -> DataFrame:
    """(token, given, family): the words of all names, in lower case; a name's first word is given, its last one family."""
    words = F.regexp_extract_all(F.lower(F.col(name)), F.lit(_WORDS), F.lit(0))
    rows = people.select(words.alias("w")).where(F.size("w") > 1).select(F.inline(F.array(F.struct(F.get("w", F.lit(0)).alias("token"), F.lit(1).alias("g"), F.lit(0).alias("f")), F.struct(F.element_at("w", -1).alias("token"), F.lit(0).alias("g"), F.lit(1).alias("f")))))
    return rows.groupBy("token").agg(F.max("g").alias("given"), F.max("f").alias("family"))


def known_words(docs: DataFrame, people: DataFrame) -> DataFrame:
    """(doc_id, known): the words of each text that are names of people, as (token, given, family, safe).

    A word is safe when, over all texts, fewer texts have it in lower case than capitalised. The name table is joined by
    word and may be of any size; adaptive execution splits a word that most texts share.
    """
    raw = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(_FREE_WORDS), F.lit(0)))
    words = docs.select("doc_id", F.explode(raw).alias("w")).select("doc_id", F.lower("w").alias("token"), (F.lower("w") == F.col("w")).cast("int").alias("low"))
    # used twice: the few words that are names are written once, texts are read and cut once
    hits = cut_lineage(words.join(name_words(people), "token"))
    use = hits.groupBy("token").agg((F.sum("low") < F.count(F.lit(1)) - F.sum("low")).alias("safe"))
    by_doc = hits.groupBy("doc_id", "token").agg(F.max("given").alias("given"), F.max("family").alias("family"))
    return by_doc.join(use, "token").groupBy("doc_id").agg(F.collect_set(F.struct("token", "given", "family", "safe")).alias("known"))


def mentions(docs: DataFrame, people: DataFrame, public: DataFrame | None = None) -> DataFrame:
    """Every mention of personal data: (doc_id, kind, start_pos, end_pos, surface, canon, gender).

    ``docs`` holds (doc_id, text), ``people`` full_name; ``public`` holds in ``name`` what is no private person: acts,
    venues, towns. Whole texts are read, in Arrow batches. Positions count code points. Null and empty texts have no
    mentions; repeated rows of a document count once. canon is one for all forms of a datum, so a first name in a text
    that has the full name once is that person.
    """
    n_docs = docs.count()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.rsplit(" ", 1)[0] for c in MENTION.split(", ")]
        for pdf in batches:
            rows = []
            for doc_id, text, known in zip(pdf["doc_id"], pdf["text"], pdf["known"]):
                table = {} if known is None else {k["token"]: (bool(k["given"]), bool(k["family"]), bool(k["safe"])) for k in known}
                rows += [(doc_id, kind, a, b, s, c, g) for kind, a, b, s, c, g in detect(text, table)]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "int64", "start_pos": "int32", "end_pos": "int32"})

    # rules cost time by the character, not by the shuffled byte, so the number of pieces is set here
    pieces = max(docs.sparkSession.sparkContext.defaultParallelism * 2, -(-n_docs // DOCS_A_TASK))
    found = docs.repartition(pieces, "doc_id").join(known_words(docs, people), "doc_id", "left").select("doc_id", "text", "known").mapInPandas(run, MENTION).distinct()
    if public is None:
        return found
    no_person = public.where("name is not null").select(F.lower(F.trim("name")).alias("_name")).distinct().withColumn("_kind", F.lit("person_name"))
    return found.join(no_person, (F.lower("surface") == F.col("_name")) & (F.col("kind") == F.col("_kind")), "left_anti")
