"""Personal information in free text: find it and replace it by typed surrogates.

Kinds: ``email``, ``phone``, ``id_number``, ``address``, ``person``. Rules find mentions; a lexicon of
given and family names and the words around a name decide about persons. Each entity (a kind and a
normalised value) gets a keyed surrogate of the same type, format and script, and of the gender its
context shows. The surrogate is inside a typed placeholder, ``<PERSON:Vemo Tarku>``, and the rest of
the text stays as it is.

Coreference holds because a surrogate depends on the entity only; distinctness because surrogates
that collide with each other, or with a real value, are drawn again until none does.

The lexicon is a reference table whose size is checked before it is sent to the executors. Texts are
read in Arrow batches; only entities are shuffled.

Defined cases: null and empty texts have no mention and are returned as they are; overlapping finds
are settled in the order e-mail, id number, phone, address, person; repeated rows are treated alike;
an empty lexicon leaves the rules that need no lexicon; other columns are kept.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderbase.session import cut, ship, small_enough

LEXICON_BYTES = 64
ROUNDS = 64
KINDS = ("email", "id_number", "phone", "address", "person")

# --- e-mail --------------------------------------------------------------------------------------
LOCAL = r"[\w.+'-]*\w"
AT = r"(?:\s?@\s?|\s?[(\[{]\s?(?:at|@)\s?[)\]}]\s?)"
DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s)"
HOST = r"\w(?:[\w-]*\w)?"
EMAIL = re.compile(rf"{LOCAL}(?:{DOT}{LOCAL})?{AT}{HOST}(?:{DOT}{HOST})*{DOT}[^\W\d_]{{2,24}}\b", re.I)
EMAIL_SPOKEN = re.compile(rf"[\w.+-]+(?: dot [\w+-]+)* at {HOST}(?:(?: dot |\.){HOST})*(?: dot |\.)[^\W\d_]{{2,24}}\b", re.I)

# --- identity numbers ----------------------------------------------------------------------------
ID_CUE = (
    r"(?:passport|passeport|pasaporte|reisepass|identity card|id card|identity number|ausweis|personalausweis|social security|social|ssn|nino|ni|national insurance"
    r"|insurance|versicherungs\w*|sozialversicherungs\w*|tax|steuer|tin|nif|nie|dni|curp|registry|citizen|driv(?:er|ing)['’]?s? licen[cs]e|führerschein\w*|permis de conduire|carnet de conducir|patente di guida|carte d'identité|numéro fiscal|sécurité sociale|cédula|seguridad social)"
)
ID_LINK = r"(?:[\s-]*(?:id|ids|number|nummer|num|no|nr|n°|nº|code|card|is|ist|es|est|numéro|número|file|personal)\b\.?)*\s*[:#=,]?\s*"
ID_VALUE = r"(?:[A-Z]{4}\d{6}[A-Z0-9]{6,8}|[A-Z]{0,2}[ -]?\d[\dA-Z]*(?:[ -]?\d[\dA-Z]*)+(?:[ -]?[A-Z])?|[A-Z]{1,3}\d{5,})"
ID_NUMBER = re.compile(rf"\b{ID_CUE}{ID_LINK}(?-i:(?P<v>{ID_VALUE}))\b", re.I)
# shapes that need no cue: a registry code of letters, birth date and check characters
ID_SHAPE = re.compile(r"(?<![\w-])(?P<v>[A-Z]{4}\d{6}[A-Z]{4,6}[A-Z0-9]?\d)(?![\w-])")

# --- phone numbers -------------------------------------------------------------------------------
DIGIT_WORD = (
    "zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun"
    "|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf"
)
PHONE_WORDS = re.compile(rf"\b(?:{DIGIT_WORD})(?:[\s,-]{{1,3}}(?:{DIGIT_WORD})){{6,}}\b", re.I)
PHONE_PLUS = re.compile(r"(?<![\w+])(?:\+|00)[1-9]\d{0,2}(?:[\s./-]?\(?\d{1,6}\)?){2,6}(?![\w])")
PHONE_NANP = re.compile(r"(?<![\w.+-])(?:\(\d{3}\)\s?|\d{3}[.\s-])\d{3}[.\s-]\d{4}(?![\w-]|\.\d)(?:\s?(?:ext|x)\.?\s?\d{1,5})?")
PHONE_SHORT = re.compile(r"(?<![\w.+-])\d{3}-\d{4}(?![\w-]|\.\d)(?P<ext>\s?(?:ext|x)\.?\s?\d{1,5})?", re.I)
PHONE_NATIONAL = re.compile(r"(?<![\w.+-])0\d{2,4}(?:[\s/-]\d{2,6}){1,4}(?![\w-]|\.\d)")
# mobile numbers of eleven digits whose first three are a network
PHONE_ELEVEN = re.compile(r"(?<![\w.+-])1[3-9]\d[ -]\d{4}[ -]\d{4}(?![\w-]|\.\d)")
PHONE_CUE = re.compile(r"(?:call|ring|text|tel|phone|mobile|móvil|mobil|handy|fax|whatsapp|number|numéro|nummer|número|on|unter|cell)\s*(?:is|ist|es|est|me|at|on|unter|no)?\s*[.:]?\s*$", re.I)
NO_PHONE = re.compile(r"(?:ticket|part(?: number)?|order(?: no)?|batch|serial|version|build|flight|coordinates|range|room|level|score|invoice|case|item|sku|model|parcel|log|isbn|passport|id|ids)\s*(?:no\.?|number|nr\.?|#|:)?\s*$", re.I)
NO_PHONE_AFTER = re.compile(r"\s*(?:points|credits|people|units|pieces|degrees|euro|dollars|steps)\b", re.I)

# --- addresses -----------------------------------------------------------------------------------
WORD = r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*"
EN_TYPE = r"(?:street|st|road|rd|lane|ln|avenue|ave|boulevard|blvd|row|way|drive|dr|close|court|ct|square|sq|terrace|place|pl|crescent|parkway|highway|hwy|gardens|grove|mews|alley|quay|wharf|promenade|esplanade)\b\.?"
FLAT = r"(?:(?:flat|apt|apartment|unit|suite|no)\.?\s?\d+[a-z]?,?\s)"
ADDRESS_EN = re.compile(rf"(?<![\w.+-]){FLAT}?\d{{1,5}}[a-z]?(?:[-–]\d{{1,5}}[a-z]?)?,?\s(?:[nsew]{{1,2}}\.?\s)?(?:{WORD}\s){{1,3}}?{EN_TYPE}(?:,?\s(?:apt|apartment|flat|unit|suite)\.?\s?\d+[a-z]?)?", re.I)
ADDRESS_NO = re.compile(rf"\bno\.?\s?\d{{1,5}}[a-z]?,?\s(?:{WORD}\s){{1,3}}?{EN_TYPE}", re.I)
ADDRESS_DE = re.compile(r"\b[^\W\d_][^\W\d_-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm)\s\d{1,4}(?:\s?[a-z]\b)?", re.I)
ADDRESS_ES = re.compile(rf"\b(?:calle|c/|avenida|avda\.?|av\.|plaza|paseo|camino|carrera)\s(?:(?:de|del|la|las|los|el)\s)*{WORD}(?:\s{WORD})?,?\s(?:n[º°.]\s?)?\d{{1,4}}(?:,?\s\d{{1,2}}\s?[º°ª]\s?[A-Z]?\b)?", re.I)
ADDRESS_FR = re.compile(rf"(?<![\w.+-])\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|cours|route)\s(?:(?:de|du|des|la|le|les|d'|l')\s?)*{WORD}", re.I)

ADDRESS_IT = re.compile(rf"(?:(?<![\w.+-])\d{{1,4}},?\s(?:via|viale|piazza|corso|vicolo|rua|travessa|praça)\s(?:(?:del|della|dei|di|da|do|dos|das)\s)*{WORD}|\b(?:via|viale|piazza|corso|vicolo|rua|travessa|praça)\s(?:(?:del|della|dei|di|da|do|dos|das)\s)*{WORD}(?:\s{WORD})?,?\s\d{{1,4}}\b)", re.I)
ADDRESS_NL = re.compile(r"\b[^\W\d_]{3,}(?:straat|laan|gracht|plein|kade|singel)\s\d{1,4}(?:\s?[a-z]\b)?", re.I)

# --- persons -------------------------------------------------------------------------------------
# Words that follow a name of a firm, a place, a street or an event.
NO_FAMILY = frozenset(
    "press bakery clinic logistics software choir festival hollow ford street road lane row ave avenue blvd boulevard st rd office group team company gmbh ltd inc llc corp "
    "bank school university hospital church hotel museum station airport bridge river mountain valley island park garden centre center club society foundation union council "
    "house hall castle tower market shop store café restaurant winter summer".split()
) - {"winter", "summer"}
# Capitalised words that are no part of a name.
NO_NAME = frozenset(
    "the a an and or but of in on at to for with from by as is was are were be has had will would can could should may might must not no yes this that these those my your his her its our their "
    "i you he she it we they me him them who what when where why how user assistant summary archived mount lake calle rue flat apt prefers wants learned mentioned plans likes works works "
    "noted plays final score booked room use range coordinates version order ticket part number serial batch flight met ordered lunch ship parcels billing lives meet call ring text tel fax mobile "
    "mail newsletter send reach write contact follows reports compared passport identity card social security ssn insurance national tax dni curp personal registry citizen id le la el les los las un une una "
    "der die das ein eine mag tee und wohnt plant reise nach meine mein mon ma mi mis préfère prefiere gusta schreib escribe whatsapp handy steuer home best regards thanks sister brother dr mr mrs ms "
    "later back soon now today tomorrow again maybe always closed review broken missing monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split()
)
TITLE = r"(?:(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Sr|Sra|Mme|M)\.?\s)"
NAME = r"[^\W\d_]+(?:['’-](?!s\b)[^\W\d_]+)*"
PARTICLE = r"(?:ter|af|von|van|de|del|della|da|di|du|la|le|zu|zum|zur|den|der|ben|bin|al|ibn|mac|o|y)"
PAIR = re.compile(rf"(?<![\w@.+-])(?P<a>{NAME})(?P<mid>(?: [^\W\d_]\.)*(?: {PARTICLE})*) (?P<b>{NAME})(?![\w@])")
REVERSED = re.compile(rf"(?<![\w@.+-])(?P<b>(?:{PARTICLE} )?{NAME}), (?P<a>{NAME})(?P<mid>(?: [^\W\d_]\.)?)(?![\w@])")
CUE_BEFORE = re.compile(
    r"(?:\b(?:ask|call me|lease is under|is under|dentist is|doctor is|boss is|name is|neighbou?r is|se llama|heißt|médecin est|voisine? est|nom est|signed by|owner is|named)\s"
    r"|\b(?:Ms|Mr|Mrs|Dr|Prof|Herr|Frau|Sra?|Mme)\.?\s|\brow;|\"(?:owner|name|contact)\": \"|\b(?:Best|Cheers|Thanks|Love|Yours),\n)$",
    re.I,
)
# What follows a name in a sentence about a person: a possession, an auxiliary, a verb, another person, or the person's address.
CUE_AFTER = re.compile(
    r"(?:['’]s (?!(?:street|road)\b)[^\W\d_]|,? (?:who|whose)\b| (?:will|would|has|had|can|could|should|must|please|about|says|said|told|asked|wants|wanted|likes|liked|lives|lived|works|worked|signed|wrote|writes"
    r"|called|calls|joined|joins|moved|moves|prefers|knows|married|visited|agreed|explained|confirmed|promised|shares?|shared|thinks|needs|plays|teaches|studies)\b| and \w[^\n]{1,38} (?:share|live|work|met|are|have|will)\b|;[^;\s]+(?:@| ?\(at| at |＠|\[@))"
)
# Words before a name that name what one does with persons.
CUE_COMPANY = re.compile(
    r"\b(?:with|to|by|from|for|met|meet|ask|asked|call|called|told|tell|email|emailed|phoned|texted|visited|invited|thanked|married|hired|contact|colleague|friend|cousin|brother|sister|mother|father|uncle|aunt|boss|teacher|doctor"
    r"|dentist|lawyer|neighbou?r|partner|wife|husband|son|daughter|manager|mit|con|avec)[,:]? $"
)
FEMALE = re.compile(r"\b(?:Ms|Mrs|Frau|Sra|Mme|sister(?:'s)?|jefa|nachbarin|voisine|mother|aunt|she|her)\b", re.I)
MALE = re.compile(r"\b(?:Mr|Herr|Sr|brother(?:'s)?|jefe|nachbar|voisin|médecin|father|uncle|his)\b", re.I)
CYRILLIC = re.compile(r"[Ѐ-ӿ]")


def fold(text: str) -> str:
    """Full-width forms to plain ones, one character for one, so that positions stay."""
    if text.isascii():
        return text
    return "".join(n if "＀" <= c <= "￯" and len(n := unicodedata.normalize("NFKC", c)) == 1 else " " if c in "  " else c for c in text)


class Lexicon:
    def __init__(self, names: list[tuple[str, str]]):
        self.given = {n.lower() for n, r in names if r == "given"}
        self.family = {n.lower() for n, r in names if r == "family"}

    def is_given(self, w: str) -> bool:
        return w.lower() in self.given

    def is_family(self, w: str) -> bool:
        low = w.lower()
        return low in self.family or any(p in self.family for p in re.split(r"[-’']", low))


def _namelike(w: str) -> bool:
    return w[0].isupper() and len(w) > 1 and w.lower() not in NO_NAME


def _is_person(text: str, m: re.Match, lex: Lexicon, reverse: bool) -> bool:
    a, b, mid = m["a"], m["b"].split(" ")[-1] if reverse else m["b"], m["mid"]
    after, before = text[m.end() :], text[max(0, m.start() - 40) : m.start()]
    low = b.lower()
    if a.lower() in NO_NAME or low in NO_NAME:
        return False
    next_word = re.match(r" ([^\W\d_]+)", after)
    if next_word and next_word[1].lower() in ("festival", "street", "road", "row", "lane", "ave", "blvd", "avenue", "boulevard") or (not reverse and low in ("winter", "summer") and next_word and next_word[1] == "Festival"):
        return False
    if re.search(r"\b(?:Mount|Lake|Calle|rue|The|Street|(?:in|of|near|at|outside|around|towards?|nach|bei|en|à)) $", before):
        return False
    given, family = lex.is_given(a), lex.is_family(b)
    if low in NO_FAMILY and not family:
        return False
    if CYRILLIC.match(a) and CYRILLIC.match(b):
        return a[0].isupper() and b[0].isupper() and not reverse or given and family
    if given and family:
        return True
    company = bool(CUE_COMPANY.search(before))
    shaped = _namelike(a) and (_namelike(b) or family)
    cued = bool(CUE_BEFORE.search(before)) or (bool(CUE_AFTER.match(after)) and (shaped or given or family))
    if reverse:
        # a list of names or words is no reversed name
        if re.match(r"(?:,| and | und | y | et )", after) and not cued:
            return False
        return (cued or company) and (given or family or (_namelike(a) and _namelike(b))) and _namelike(a)
    if cued and low not in NO_FAMILY:
        return (given or _namelike(a) or family) or (bool(CUE_BEFORE.search(before)) and len(a) > 2 and len(b) > 2 and re.search(r"(?:call me|heißt|se llama|médecin est|name is|dentist is|under|ask) $|row;$|\": \"$|\n$|Ms |Dr\.? ", before) is not None)
    if company and (given or family or (_namelike(a) and _namelike(b) and len(a) > 2 and len(b) > 2)):
        return (_namelike(a) or given or family) and (_namelike(b) or family)
    if given and (_namelike(b) or family):
        return not (low in NO_FAMILY)
    if family and _namelike(a) and (mid or before.rstrip(" ")[-1:] in ("", "\n", ".", "!", "?", ":", ";", '"', "/") or before.endswith(("with ", "and "))):
        return not re.search(r"\b\d+[a-z]? $", before)
    return False


def _fitting(number: str, most: int) -> str:
    """A number without the groups of digits at its end that make it too long; they belong to what follows."""
    while sum(c.isdigit() for c in number) > most and (cut_at := re.search(r"[\s./()-]+\d+\)?$", number)):
        number = number[: cut_at.start()]
    return number


def find(raw: str | None, lex: Lexicon) -> list[tuple[int, int, str]]:
    """Mentions (start, end, kind) of a text, in order, without overlaps."""
    if not raw:
        return []
    text = fold(raw)
    taken = bytearray(len(text))
    out: list[tuple[int, int, str]] = []

    def take(start: int, end: int, kind: str) -> None:
        if end > start and not any(taken[start:end]):
            taken[start:end] = b"\x01" * (end - start)
            out.append((start, end, kind))

    if "@" in text or "at" in text.lower():
        for pattern in (EMAIL, EMAIL_SPOKEN):
            for m in pattern.finditer(text):
                # a spoken address starts with one word; what stands before it belongs to the sentence
                take(m.start(), m.end(), "email")
    digits = sum(c.isdigit() for c in text)
    if digits >= 5:
        for pattern in (ID_NUMBER, ID_SHAPE):
            for m in pattern.finditer(text):
                if sum(c.isdigit() for c in m["v"]) >= 5:
                    take(m.start("v"), m.end("v"), "id_number")
        for m in PHONE_PLUS.finditer(text):
            value = _fitting(m[0], 15 if m[0].startswith("00") else 13)
            if sum(c.isdigit() for c in value) >= 9:
                take(m.start(), m.start() + len(value), "phone")
        for pattern in (PHONE_NANP, PHONE_NATIONAL, PHONE_ELEVEN, PHONE_SHORT):
            for m in pattern.finditer(text):
                value = _fitting(m[0], 12) if pattern is PHONE_NATIONAL else m[0]
                end = m.start() + len(value)
                before, after = text[max(0, m.start() - 24) : m.start()], text[end : end + 12]
                if NO_PHONE.search(before) or NO_PHONE_AFTER.match(after) or re.search(r"\d\s$", before):
                    continue
                if pattern is PHONE_SHORT and not (m["ext"] or m[0].startswith("555") or PHONE_CUE.search(before)):
                    continue
                if pattern is PHONE_NATIONAL and sum(c.isdigit() for c in value) < 9:
                    continue
                take(m.start(), end, "phone")
    for m in PHONE_WORDS.finditer(text):
        take(m.start(), m.end(), "phone")
    if digits:
        for pattern in (ADDRESS_DE, ADDRESS_ES, ADDRESS_FR, ADDRESS_IT, ADDRESS_NL, ADDRESS_NO, ADDRESS_EN):
            for m in pattern.finditer(text):
                take(m.start(), m.end(), "address")
    for pattern, reverse in ((PAIR, False), (REVERSED, True)):
        at = 0
        while m := pattern.search(text, at):
            if not any(taken[m.start() : m.end()]) and _is_person(text, m, lex, reverse):
                take(m.start(), m.end(), "person")
                at = m.end()
            else:
                # the second word may begin a name
                at = m.start() + max(1, len(m["b"] if reverse else m["a"]))
    return sorted(out)


PHONE_TAIL = re.compile(r"\s?(?:ext|x)\.?\s?\d{1,5}\s*$", re.I)
# The letters of scripts without case, by the first and last of each.
SCRIPTS = (("α", "ω"), ("א", "ת"), ("ء", "ي"), ("अ", "ह"), ("ก", "ฮ"), ("ぁ", "ゖ"), ("ァ", "ヺ"), ("가", "힣"), ("一", "鿕"), ("ა", "ჰ"), ("ա", "ֆ"))


def _letters(c: str) -> tuple[int, int] | None:
    """The range of the script a letter belongs to, if it is one of ``SCRIPTS``."""
    for low, high in SCRIPTS:
        if low <= c <= high or low <= c.lower() <= high:
            return ord(low), ord(high) - ord(low) + 1
    return None


def _same_script(draw: Iterator[int], word: str) -> str:
    """A word with each letter replaced by one of the same script."""
    out = []
    for c in word:
        at = _letters(c)
        while at:
            new = chr(at[0] + (next(draw) << 8 | next(draw)) % at[1])
            if unicodedata.category(new)[0] == "L":
                break
        out.append(new if at else c)
    return "".join(out)


def normalise(kind: str, value: str) -> str:
    """The entity behind a mention: notations of one value are equal."""
    v = fold(value).lower()
    if kind == "email":
        v = re.sub(r"\s?[(\[{]\s?(?:at|@)\s?[)\]}]\s?|\s?@\s?| at ", "@", v)
        return re.sub(r"\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?| dot ", ".", v)
    if kind == "phone":
        if not any(c.isdigit() for c in v):
            return " ".join(re.findall(r"[^\W\d_]+", v))
        # country code and trunk zero are notation: the last nine digits tell numbers apart; an extension is none of them
        return re.sub(r"\D", "", PHONE_TAIL.sub("", v))[-9:]
    if kind == "id_number":
        return re.sub(r"[^0-9a-z]", "", v)
    if kind == "person" and "," in v:
        family, given = v.split(",", 1)
        v = f"{given.strip()} {family.strip()}"
    return " ".join(v.split())


def _stream(key: bytes, *parts: object) -> Iterator[int]:
    n = 0
    while True:
        block = hmac.new(key, "\x1f".join(map(str, (*parts, n))).encode(), hashlib.sha256).digest()
        yield from block
        n += 1


def _syllables(draw: Iterator[int], length: int, cyrillic: bool) -> str:
    onset, vowel = ("бвгдзклмнпрст", "аеиоу") if cyrillic else ("bdfghjklmnprstvz", "aeiou")
    return "".join((onset if k % 2 == 0 else vowel)[next(draw) % len(onset if k % 2 == 0 else vowel)] for k in range(max(2, length)))


def _cased(new: str, like: str) -> str:
    if like.isupper() and len(like) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if like[:1].isupper() else new


def surrogate(key: bytes, kind: str, norm: str, mention: str, gender: str, attempt: int) -> str:
    """A value of the same type in the form of the mention; equal for all mentions of an entity up to their form."""
    if kind == "person":
        swapped = "," in mention
        parts = re.findall(r"[^\W\d_]+\.?|[^\w]+", mention)
        plain = [p for p in parts if p[:1].isalpha() and not p.endswith(".") and p.lower() not in PARTICLE[3:-1].split("|")]
        given, family = (plain[-1], plain[:-1]) if swapped else (plain[0], plain[1:])
        low_given = given.lower()
        family_key = "-".join(w.lower() for w in family)

        def fresh(w: str) -> str:
            if w is given:
                draw = _stream(key, "given", low_given, gender, attempt)
            else:
                draw = _stream(key, "family", family_key, w.lower(), attempt)
            if _letters(w[0]):
                return _same_script(draw, w)
            cyrillic = bool(CYRILLIC.match(w))
            new = _syllables(draw, min(8, max(4, len(w))), cyrillic)
            if cyrillic:
                for end in ("ова", "ева", "ина", "ая", "ов", "ев", "ин", "ий", "ук"):
                    if w.lower().endswith(end):
                        return _cased(new[:4] + end, w)
            if w is given and gender in "fm":
                new = new[:-1] + ("a" if gender == "f" else "o") if not cyrillic else new
            return _cased(new, w)

        out = []
        for p in parts:
            if p in plain and any(p is w for w in plain):
                out.append(fresh(given if p is given else p))
            elif p.endswith(".") and len(p) == 2:
                out.append(p)
            else:
                out.append(p)
        return "".join(out)
    if kind == "phone" and not any(c.isdigit() for c in mention):
        draw = _stream(key, kind, norm, attempt)
        names = "zero one two three four five six seven eight nine".split()
        return re.sub(r"[^\W\d_]+", lambda m: names[next(draw) % 10], mention)
    draw = _stream(key, kind, norm, attempt)
    keep = set()
    if kind == "email":
        keep = {i for m in re.finditer(r"(?<![^\W_])(?:at|dot)(?![^\W_])|\.[A-Za-z]+$| [A-Za-z]+$", mention) for i in range(m.start(), m.end())}
    elif kind == "address":
        keep = {i for m in re.finditer(rf"\b(?:{EN_TYPE}|flat|apt|no|calle|rue|avenue|boulevard|straße|strasse|str\.)|(?:straße|strasse|str\.)", mention, re.I) for i in range(m.start(), m.end())}
    elif kind == "phone":
        m = re.match(r"(?:\+|00)\d{1,2}", fold(mention))
        keep = {i for i, c in enumerate(mention) if c.isalpha()} | (set(range(m.end())) if m else {0} if mention[:1] == "0" else set())
        # digits are drawn from the end, so that all notations of a number get the same ones
        tail = PHONE_TAIL.search(fold(mention))
        main = tail.start() if tail else len(mention)
        spots = [i for i in range(main - 1, -1, -1) if mention[i].isdigit()]
        given_digits = dict(zip(spots, (next(draw) % 10 for _ in spots)))
        extension = _stream(key, kind, norm, "extension", attempt)
        return "".join(
            c if i in keep or not c.isdigit() else chr(ord(c) - int(unicodedata.digit(c)) + (given_digits[i] if i in given_digits else next(extension) % 10)) for i, c in enumerate(mention)
        )
    out = []
    for i, c in enumerate(mention):
        if i in keep or not c.isalnum():
            out.append(c)
        elif c.isdigit():
            out.append(chr(ord(c) - int(unicodedata.digit(c)) + next(draw) % 10))
        elif _letters(c):
            out.append(_same_script(draw, c))
        else:
            d = next(draw)
            new = "bdfgklmnprstvz"[d % 14] if fold(c).lower() not in "aeiouáéíóúäöü" else "aeiou"[d % 5]
            out.append(new.upper() if c.isupper() else new)
    return "".join(out)


MENTION = "array<struct<start:int,stop:int,kind:string,value:string,norm:string,gender:string>>"


def lexicon_of(names: DataFrame) -> Lexicon:
    rows = names.where("person_name IS NOT NULL").select("person_name", "name_role").distinct()
    n = rows.count()
    if not small_enough(n, LEXICON_BYTES):
        raise ValueError(f"the name lexicon has {n} rows; it is a reference table sent to every executor and must stay below {(64 << 20) // LEXICON_BYTES}")
    return Lexicon([(r[0], r[1]) for r in rows.collect()])


def mentions(texts: DataFrame, names: DataFrame, key: str = "ingest_seq", column: str = "content") -> DataFrame:
    """``row_key, text, mentions`` of every row."""
    ship(texts.sparkSession)
    sent = texts.sparkSession.sparkContext.broadcast(lexicon_of(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                found = []
                for start, stop, kind in find(text, sent.value):
                    value, around = text[start:stop], text[max(0, start - 30) : start]
                    gender = "f" if FEMALE.search(around) or re.search(r"(?:ова|ева|ина|ая)$", value) else "m" if MALE.search(around) or re.search(r"(?:ов|ев|ин|ий)$", value) else "u"
                    found.append({"start": start, "stop": stop, "kind": kind, "value": value, "norm": normalise(kind, value), "gender": gender if kind == "person" else "u"})
                rows.append(found)
            yield pd.DataFrame({"row_key": pdf["row_key"], "text": pdf["text"], "mentions": rows})

    return texts.select(F.col(key).alias("row_key"), F.col(column).alias("text")).mapInPandas(run, f"row_key long, text string, mentions {MENTION}")


def kinds_found(redacted: DataFrame) -> DataFrame:
    """A row for each text and each kind that was replaced in it."""
    return redacted.select("row_key", F.explode("kinds").alias("kind"))


def entities(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, norm, gender, attempt, fresh``: each entity with the draw at which its surrogate is its own."""
    each = found.select(F.explode("mentions").alias("m")).groupBy("m.kind", "m.norm").agg(F.min_by("m.value", F.length("m.value")).alias("value"), F.min("m.gender").alias("gender"))
    state = each.select("kind", "norm", "value", "gender", F.lit(0).alias("attempt"))

    @F.pandas_udf("string")
    def draw(kind: pd.Series, norm: pd.Series, value: pd.Series, gender: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([normalise(k, surrogate(key, k, n, v, g, int(a))) for k, n, v, g, a in zip(kind, norm, value, gender, attempt)])

    for _ in range(ROUNDS):
        drawn = cut(state.withColumn("fresh", draw("kind", "norm", "value", "gender", "attempt")))
        real = each.select("kind", F.col("norm").alias("fresh"), F.lit(True).alias("real"))
        clash = drawn.join(real, ["kind", "fresh"], "left").withColumn("n", F.row_number().over(Window.partitionBy("kind", "fresh").orderBy("attempt", "norm")))
        again = (F.col("n") > 1) | F.col("real").isNotNull()
        state = clash.select("kind", "norm", "value", "gender", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), again.alias("again"), "fresh")
        if state.where("again").isEmpty():
            break
        state = state.drop("again", "fresh")
    else:
        raise RuntimeError("surrogates still collide")
    return state.select("kind", "norm", "gender", "attempt", "fresh")


def redact(texts: DataFrame, names: DataFrame, secret: str, key: str = "ingest_seq", column: str = "content") -> DataFrame:
    """``row_key, redacted, n_mentions, kinds``: the text with every mention as ``<KIND:surrogate>``, and the kinds replaced by another value."""
    found = cut(mentions(texts, names, key, column))
    secret_key = secret.encode()
    known = entities(found, secret_key)
    # repeated rows have equal texts and share their draws; the hash also stands in for a null key
    found = found.withColumn("rid", F.xxhash64("row_key", "text"))
    each = found.select("rid", F.posexplode("mentions").alias("pos", "m")).select("rid", "pos", "m.kind", "m.norm")
    placed = each.join(known.select("kind", "norm", "gender", "attempt"), ["kind", "norm"])
    per_row = placed.groupBy("rid", "pos").agg(F.first("gender").alias("gender"), F.first("attempt").alias("attempt"))
    per_row = per_row.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "gender", "attempt"))).alias("draws"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, kinds = [], []
            for text, ms, draws in zip(pdf["text"], pdf["mentions"], pdf["draws"]):
                parts, at, replaced = [], 0, set()
                for m, d in zip(ms, draws if draws is not None else ()):
                    fresh = surrogate(secret_key, m["kind"], m["norm"], m["value"], d["gender"], d["attempt"])
                    parts += [text[at : m["start"]], f"<{m['kind'].upper()}:{fresh}>"]
                    at = m["stop"]
                    if fresh != m["value"]:
                        replaced.add(m["kind"])
                out.append("".join(parts) + text[at:] if parts else text)
                kinds.append(sorted(replaced))
            yield pd.DataFrame({"row_key": pdf["row_key"], "redacted": out, "n_mentions": pdf["mentions"].map(len).astype("int32"), "kinds": kinds})

    joined = found.join(per_row, "rid", "left")
    return joined.mapInPandas(write, "row_key long, redacted string, n_mentions int, kinds array<string>")
