"""Personal information in free text: find it, put typed placeholders or keyed surrogates in its place.

Line ends with their quote marks, soft line breaks and HTML line tags are blanked to the same length first, so that a value that
was wrapped is seen whole and every place is a place of the raw text. Encoded attachments and message identifiers are blanked too.
Then each kind has its patterns; names are looked up in a lexicon that is learned from the display names beside addresses of the whole
corpus and from name_parts. Detection is one pass in Arrow batches; surrogates are made per distinct entity, by Spark.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators.positions import with_positions
from cellweave.session import Stored

KINDS = ("email", "phone", "id_number", "address", "name")
#: Entries of each kind of the learned lexicon that are shared with every task, the most frequent; the rest reach their texts by a join.
SHARED_LEXICON = 100_000

# fixed values: words of display names that are no person's
ROLE_WORDS = frozenset(
    "admin administrator alerts announce billing bot build cron daemon desk digest facility group help helpdesk info lab list lists mailer mailman "
    "monitor news no-reply noreply office ops orders postmaster project root sales security service server staff support system team users webmaster".split()
)
# fixed values: capitalised words that follow or precede a given name without being a family name
NOT_FAMILY = frozenset(
    "a about all also am an and analysis any are as at avenue ave best besten bis blvd bonjour both but by can cc cheers close cordialement "
    "could court date dear der die dr el en fax fon for friday from fwd group hall hallo have he hello hi hola i if ihr il in institut is it "
    "lab lane le les liebe lieber m mail many may message mit mobil monday mr mrs ms my next no nobody not of on or original our phone "
    "please prof rd re regards road room sent sie so st street subject sunday saturday tel thanks that the they this thursday to "
    "tuesday una und unit until viele von vous was we wednesday what when who why will wir wiss with you your zentrum".split()
)

_G = r"(?:[ \t\xa0]{1,40}(?:\x1f[ \t\xa0]{0,80})?|\x1f[ \t\xa0]{0,80})"
_O = rf"{_G}?"

_BASE64 = re.compile(r"(?m)\n[>| \t]*(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{48,}={0,2}[ \t\r]*(?:\n[>| \t]*[A-Za-z0-9+/]{1,76}={0,2}[ \t\r]*$)*")
_UUENCODE = re.compile(r"(?m)^[>| \t]*begin [0-7]{3} [^\n]*\n(?:[>| \t]*[\x20-\x60]{1,62}[ \t\r]*\n?)*?(?:[>| \t]*end\b|(?=\n\n|\Z))")
_TAG = re.compile(r"</?(?:p|div|br|span|td|tr|li|blockquote|html|head|body|font|b|i|P|DIV|BR)\b[^<>\n]*>")
_QUOTE = re.compile(r"\n(?=[>|: \t&])(?:(?:[>|:]|&gt;)[ \t]?)*[ \t]*(?:(?:[>|:]|&gt;)[ \t]?)*[ \t]*")
_ID_FIELD = re.compile(r"(?i)(?:[\w-]*message-id|in-reply-to|references|content-id|[\w-]*thread-index)[ \t]*:")

_LOCAL = r"[A-Za-z0-9](?:[\w.+'-]*\w)?"
_DOMAIN = re.compile(rf"@[A-Za-z0-9-]+(?:(?:\.|\[\.\]|\(\.\)|{_O}[\[(]dot[\])]{_O})[A-Za-z0-9-]+)+", re.ASCII)
_LOCAL_END = re.compile(rf"(?:3D(?<==3D))?({_LOCAL})\Z", re.ASCII)
_LOCAL_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+'-"
_DOT = rf"(?:{_O}[\[({{](?:dot|DOT|Dot|\.)[\])}}]{_O}|{_G}DOT{_G}|\.)"
_SPOKEN = re.compile(rf"(?:[\[({{<](?:at|AT|At|@)[\])}}>]{_O}|(?<=[ \t\xa0\x1f])AT{_G})([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+)")
_SPOKEN_LOW = re.compile(rf"(?<=[ \t\xa0\x1f])(?:at|arobase){_G}([A-Za-z0-9-]+(?:{_G}(?:dot|point|punkt|punto){_G}[A-Za-z0-9-]+)+)")
_BEFORE = re.compile(rf"(?<![\w.+'-]){_LOCAL}{_O}\Z", re.ASCII)

_LABEL = re.compile(
    rf"(?i)(?:tax{_G}(?:id|number)|personal{_G}(?:id{_G})?(?:number|no\.?)|social{_G}security{_G}(?:number|no\.?)|(?:national|health){_G}insurance{_G}(?:number|no\.?)"
    rf"|passport{_G}(?:no\.?|number)|\bssn\b|passnummer|reisepass\w*|versicherten-?nummer|versicherungsnummer|steuer-?(?:id|nummer|identifikationsnummer)\w*|(?:personal)?ausweis\w*"
    rf"|s(?:é|=C3=A9|=E9|e|.{{1,3}})curit(?:é|=C3=A9|=E9|e|.{{1,3}}){_G}sociale|passeport|\b(?:NIE|DNI|NIF|NIR)\b|pasaporte|n(?:ú|=C3=BA|.)mero{_G}fiscal)"
)
_VALUE = re.compile(
    rf"(?<![\w-])(?=[A-Za-z]{{0,2}}(?:-|{_O})\d)(?:[12]{_O}\d\d{_O}\d\d{_O}(?:\d\d|2[ABab]){_O}\d{{3}}{_O}\d{{3}}(?:{_O}|-)\d\d|[XYZxyz][- ]?\d{{7}}[- ]?[A-Za-z]|\d{{8}}(?:-|{_O})[A-Za-z]|\d\d\.\d{{3}}\.\d{{3}}(?:-|{_O})[A-Za-z]"
    rf"|[A-Za-z]{{2}}(?:-|{_O})\d\d(?:-|{_O})\d\d(?:-|{_O})\d\d(?:-|{_O})[A-Da-d]|\d{{3}}-\d\d-\d{{4}}|\d{{3}}\.\d\d\.\d{{4}}|\d{{3}}{_G}\d\d{_G}\d{{4}}"
    rf"|\d\d{_G}\d{{3}}{_G}\d{{3}}{_G}\d{{3}}|\d{_G}\d{{3}}{_G}\d{{3}}{_G}\d{{4}}|[A-Za-z]{_O}\d{{3}}{_G}\d{{3}}{_G}\d{{3}}|[A-Za-z]\d[A-Za-z0-9]\d\d[A-Za-z0-9]\d{{3}}|[A-Za-z]{{1,2}}\d{{6,9}}|\d{{9,11}})(?![\w-]|\.\d)"
)
# fixed values: what every label holds, in lower case; and labels that are words of other languages unless in capitals
_HINTS = ("tax", "ersonal", "curit", "nsurance", "assport", "asseport", "assnummer", "eisepass", "ersicher", "teuer", "usweis", "asaporte", "ssn", "fiscal")
_SHORT_HINTS = ("NIE", "DNI", "NIF", "NIR")
#: The longest label, and the longest number, that the patterns below can match, with the widest gaps they allow.
LABEL_REACH = 600
# fixed values: how far before what it holds a label begins, or before the gap in front of that
_LABEL_STARTS, _LABEL_GAP_STARTS = 9, 11
_AND = re.compile(rf"{_O}(?:[,;/&]|{_G}(?:and|or|und|oder|et|ou|y|o)(?={_G})){_O}")
_LONE_LETTER = re.compile(r"[A-Za-z]?\d{7,8}[ \x1f][A-Za-z]")
_DIGIT, _NUMBER, _ENCODED = re.compile(r"\d"), re.compile(r"\d+"), re.compile(r"=[0-9A-F]{2}")
_IS_DIGIT = bytes(48 <= c < 58 for c in range(256))
_BARE_ID = re.compile(
    rf"[A-Z](?<![\w./-].)(?:[A-Z](?:([ -])\d\d\1\d\d\1\d\d\1|\d{{6}})[A-D]|(?<=[XYZ])\d{{7}}-?[A-Z])(?![\w-])|[12](?<![\w./-].){_G}\d\d{_G}\d\d{_G}(?:\d\d|2[AB]){_G}\d{{3}}{_G}\d{{3}}(?:{_G}|-)\d\d(?![\w-])"
)

_P = rf"(?:[-./]|{_G})"
_PHONE = re.compile(
    rf"(?:\(?\+\d{{1,3}}\)?{_P}?(?:\(0\){_P}?)?(?:\(?\d{{1,5}}\)?)(?:{_P}?\d{{2,8}}){{1,5}}"
    rf"|00[1-9]\d{{1,2}}{_P}?(?:\(0\){_P}?)?\d{{1,5}}(?:{_P}?\d{{2,8}}){{1,5}}"
    rf"|(?:1{_P})?(?:\(\d{{3}}\){_O}|\d{{3}}[-.])\d{{3}}[-.]\d{{4}}|(?:1{_P})?\(\d{{3}}\){_G}\d{{3}}{_G}\d{{4}}|[2-9]\d{{9}}"
    rf"|\(0\d{{1,5}}\){_P}?\d{{2,8}}(?:{_P}\d{{2,8}})*|0[1-9]\d{{7,10}}|0[1-9]\d{{0,4}}(?:{_P}\d{{2,8}}){{1,5}}"
    rf"|[46789]\d\d(?:{_G}\d{{3}}{_G}\d{{3}}|(?:{_G}\d\d){{3}}|(?:\.\d\d){{3}}))(?![\w:@=-]|[.,]\d)(?:{_O}(?:ext\.?|extension|Durchwahl|poste|x){_O}\d{{1,5}}(?!\w))?"
)
# fixed values: what is between the digits of a phone number, and how an extension begins
_PHONE_GAPS, _EXTENSIONS = "+()-./ \t\xa0\x1f", "eDpx"
_NO_PHONE = re.compile(
    rf"(?i)(?:order|lot|ticket|ref|grant|run|checksum|frames?|part|version|host|bestellung|commande|pedido|serial|invoice|job|id)\b\.?(?:{_G}(?:no|nr|number|n°)\b\.?)?[ :#\x1f\t]*\Z"
)
_UNITS = re.compile(rf"{_G}(?:bytes?|s|ms|px|rows|items|GB|MB|KB)\b")

_TYPE = r"(?i:Street|Str|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Boulevard|Blvd|Close|Drive|Dr|Terrace|Square|Crescent|Gardens|Mews|Way|Row)"
_UP = r"[A-ZÀ-Þ]"
_W = r"(?:[\w'’]|=[0-9A-F]{2})"
# any number of those, possibly none
_WS = r"[\w'’]*(?:=[0-9A-F]{2}[\w'’]*)*"
_HOUSE_FIRST = re.compile(
    rf"\d(?<![\w./-].)(?:\d{{0,3}}[A-Za-z]?{_G}(?:(?:[NSEW]\.?|(?i:North|South|East|West)){_G})?(?:(?:{_UP}{_WS}(?:-{_UP}{_WS})?|\d+(?i:st|nd|rd|th)){_G}){{1,3}}?{_TYPE}(?:(?<=St)\.|(?<=ST)\.|(?<=Rd)\.|(?<=Ave)\.)?(?!\w)"
    rf"(?!{_G}{_TYPE}\b)(?:,?{_G}(?:(?i:Suite|Apt|Unit|Flat|Floor|Room)\.?{_G}\w+|#{_O}\w+)|,{_G}\d+(?:st|nd|rd|th){_G}(?i:floor))?"
    rf"|\d{{0,3}}(?:{_G}?(?:bis|ter|quater)\b)?,?{_G}(?i:rue|avenue|av\.|bd|boulevard|impasse|place|chemin|all(?:é|=C3=A9|=E9)e|quai|route){_G}(?i:(?:de{_G}la|de|du|des|de{_G}l['’]|d['’]){_G}?)?"
    rf"(?:(?i:Trois|Quatre|Deux|Cinq|Sept|Saint|Sainte|Grande?|Vieux|Vieille|Petite?|Haute?){_G})?{_UP}{_WS}(?:-{_W}+)*(?:,{_G}b(?:â|=C3=A2|=E2|a)t\.?{_G}\w+)?)"
)
_FLAT = re.compile(rf"(?<![\w./-])(?i:Flat|Apt|Unit){_G}\d+[A-Za-z]?,?{_G}\Z")
_HOUSE_LAST = re.compile(
    rf"(?<!\w)(?:(?:(?:Obere|Untere|Alte|Neue|Große|Kleine|Hohe){_G})?{_UP}(?:\w|=[0-9A-F]{{2}})*?(?:stra(?:ß|ss|=C3=9F|=DF)e|STRA(?:SS|ß)E|str\.|weg|gasse|allee|platz|ring|damm|ufer|grund|steig|pfad|markt|wall)"
    rf"){_G}\d{{1,4}}[a-z]?(?:-\d{{1,4}}[a-z]?)?(?!\w)(?:,{_G}(?:\d{{1,2}}\.{_G}(?:OG|Stock|Etage)|EG|DG|UG|Hinterhaus)\b)?"
)
# streets named by where they lie: after a label, or a line of their own
_HOUSE_PLACED = re.compile(
    rf"(?:Am|An{_G}der|Im|In{_G}der|Zum|Zur|Auf{_G}de[rm]|Unter{_G}den){_G}(?:{_UP}(?:\w|=[0-9A-F]{{2}})+{_G}){{1,2}}\d{{1,4}}[a-z]?(?!\w)(?:,{_G}(?:\d{{1,2}}\.{_G}(?:OG|Stock|Etage)|EG|DG|UG|Hinterhaus)\b)?"
)
_PLACE_LABEL = re.compile(rf"(?:[Aa]dresse|wohnhaft|[Aa]nschrift):?{_G}\Z")
_HOUSE_SPANISH = re.compile(
    rf"(?<!\w)(?:[Cc]alle|CALLE|C/|Avda\.|Av\.|Avenida|AVENIDA|AVDA\.|[Pp]laza|PLAZA|Pza\.|Paseo)(?:{_G}(?:(?i:de|del|la|las|los|el|y)|{_UP}{_WS})){{1,6}},?{_G}(?:n(?:º|°|\.|=C2=BA|=BA){_O})?\d{{1,4}}(?!\w)(?:,{_G}(?:\d{{1,2}}(?:º|°|ª|=C2=BA|=BA){_O}[A-Z](?!\w)|bajo|(?:á|=C3=A1)tico|entresuelo))?"
)
_HOUSE_END = re.compile(r"(?:aße|asse|TRASSE|STRAßE|9Fe|DFe|str\.|weg|gasse|allee|platz|ring|damm|ufer|grund|steig|pfad|markt|wall)[ \t\xa0\x1f]+\d\Z")
_STREETS = ("Calle", "calle", "CALLE", "C/", "Avda", "AVDA", "Av.", "Avenida", "AVENIDA", "laza", "PLAZA", "Pza", "Paseo")

_WORD = re.compile(r"[A-ZÀ-ÞŠŽ](?<![\w@.'’=/+-].)[\w'’]*(?:-[A-Z][\w'’]*)*(?![\w@])")
_PARTICLE = r"(?:(?i:De(?:{0})la|Van(?:{0})der|Van(?:{0})den|Von(?:{0})der|De(?:{0})los|Von|Van|Del|Di|Da|Dos|Mac){0})?".replace("{0}", _G)
_NEXT = re.compile(rf"(?:({_G})[A-Z]\.)?({_G})({_PARTICLE}([A-ZÀ-ÞŠŽ][\w'’]*(?:-[A-Z][\w'’]*)*))(?![\w@])(?!\.\w|[+][\w])")
_COMMA = re.compile(rf",{_G}([A-ZÀ-ÞŠŽ][\w'’]*(?:-[A-Z][\w'’]*)*)({_G}[A-Z]\.)?(?![\w@])")
_COMMA_INITIAL = re.compile(rf",{_G}[A-Z]\.(?!\w)")
_INITIAL = re.compile(rf"(?<![\w.'’-])[A-Z]\.(?:{_O}[A-Z]\.)?{_O}\Z")
_PARTICLE_BEFORE = re.compile(rf"(?<!\w)(?i:De{_G}la|Van{_G}der|Van{_G}den|Von{_G}der|Von|Van|Del){_G}\Z")
_LOWER = re.compile(rf"\x1f[ \t]*(([a-zà-ÿ]{{2,}}(?:-[a-z]+)?)((?:{_G}[a-z]\.)?{_G}((?:(?:de{_G}la|van{_G}der|von){_G})?[a-zà-ÿ][a-zà-ÿ'’-]{{2,}})))[ \t]*(?=\x1f|\Z)")


_MIDDLE = re.compile(rf"\A{_G}[a-z]\.")
_BLANKS = " \t\xa0\x1f"


def _same_length(m: re.Match) -> str:
    return "\x1f" + " " * (len(m.group()) - 1)


def _spaces(m: re.Match) -> str:
    return " " * len(m.group())


def _blank(m: re.Match) -> str:
    return "\x00" * len(m.group())


def _blank_lines(m: re.Match) -> str:
    return "\n" + "\x00" * (len(m.group()) - 1)


def readable(text: str) -> str:
    """The text with attachments and line ends blanked, each to its own length; a line end is \\x1f and blanks, what is left out is \\x00."""
    t = _BASE64.sub(_blank_lines, "\n" + text)[1:]
    if "begin " in t:
        t = _UUENCODE.sub(_blank, t)
    if "\r" in t:
        t = t.replace("\r\n", " \n")
    if "=\n" in t or "= \n" in t:
        t = t.replace("=\n", " \n").replace("= \n", "  \n")
    if "<" in t:
        t = _TAG.sub(_spaces, t)
    if "&nbsp;" in t:
        t = t.replace("&nbsp;", "      ")
    return _QUOTE.sub(_same_length, t).replace("\n", "\x1f")


class Lexicon:
    """Given and family names in lower case; pairs are given names that count only beside a family name of theirs."""

    def __init__(self, given: Iterable[str], family: Iterable[str], pairs: Iterable[tuple[str, str]] = ()):
        self.given = {g.lower() for g in given}
        self.family = {re.sub(r"\s+", " ", f.lower()) for f in family}
        self.pairs: dict[str, set[str]] = {}
        for g, f in pairs:
            self.pairs.setdefault(g.lower(), set()).add(re.sub(r"\s+", " ", f.lower()))

    @contextmanager
    def also(self, entries: Iterable[tuple[str, str, str]]) -> Iterator[None]:
        """With further (kind, w, family) for the time of the block."""
        added = []
        for kind, w, f in entries:
            if kind == "pair":
                if f not in self.pairs.setdefault(w, set()):
                    self.pairs[w].add(f)
                    added.append((self.pairs[w], f))
            elif w not in (known := self.given if kind == "given" else self.family):
                known.add(w)
                added.append((known, w))
        try:
            yield
        finally:
            for known, w in added:
                known.discard(w)

    def is_given(self, word: str) -> bool:
        w = word.lower()
        return w in self.given or "-" in w and all(p in self.given for p in w.split("-"))

    def is_family(self, word: str) -> bool:
        return re.sub(r"[\s\x1f]+", " ", word.lower()) in self.family if (" " in word or "\x1f" in word) else word.lower() in self.family

    def is_pair(self, given: str, family: str) -> bool:
        families = self.pairs.get(given.lower())
        return bool(families) and re.sub(r"[\s\x1f]+", " ", family.lower()) in families


def _is_identifier(t: str, s: int, fields: dict[int, bool]) -> bool:
    """Whether the address at s is an identifier of a message or part: after cid:, or in such a field, over folded lines. fields: what
    is known of lines seen so far, by the place of the line end before them."""
    if t[s - 4 : s].lower() == "cid:":
        return True
    if t[s - 1 : s] != "<":
        line = t.rfind("\x1f", 0, s) + 1
        return bool(_ID_FIELD.match(t, line + len(t[line:s]) - len(t[line:s].lstrip())))
    line, passed = s, []
    while True:
        line = t.rfind("\x1f", 0, line)
        if line in fields:
            found = fields[line]
            break
        passed.append(line)
        start = line + 1
        while start < s and t[start] in " \t":
            start += 1
        if t[start : start + 1] != "<" or line < 0:
            found = bool(_ID_FIELD.match(t, start))
            break
    fields.update(dict.fromkeys(passed, found))
    return found


def _before(pattern: re.Pattern, t: str, at: int, width: int = 80) -> re.Match | None:
    """The match of the pattern that ends at `at`, in a window that is widened for as long as it begins inside a word."""
    while True:
        low = max(0, at - width)
        m = pattern.search(t, low, at)
        if m or not low or not (t[low].isalnum() or t[low] in "_.+'-"):
            return m
        width *= 8


def _local(t: str, at: int) -> re.Match | None:
    """The match of the local part that ends at `at`."""
    width = 40
    while True:
        low = max(0, at - width)
        run = len(t[low:at].rstrip(_LOCAL_CHARS))
        if run or not low:
            return _LOCAL_END.match(t, low + run, at)
        width *= 8


def _emails(t: str) -> list[tuple[int, int]]:
    out = []
    fields: dict[int, bool] = {}
    at = t.find("@")
    while at >= 0:
        domain = _DOMAIN.match(t, at)
        local = domain and _local(t, at)
        if local and not _is_identifier(t, local.start(1), fields):
            out.append((local.start(1), domain.end()))
        at = t.find("@", domain.end() if domain else at + 1)
    patterns = []
    if any(x in t for x in ("at)", "at]", "AT", "At)", "At]", "at}", "at>", "(@)", "[@]")):
        patterns.append(_SPOKEN)
    if " dot " in t or "arobase" in t:
        patterns.append(_SPOKEN_LOW)
    for p in patterns:
        for m in p.finditer(t):
            before = _before(_BEFORE, t, m.start())
            if before:
                out.append((before.start(), m.end()))
    return out


def _places(t: str, parts: Iterable[str]) -> list[int]:
    out = []
    for x in parts:
        at = t.find(x)
        while at >= 0:
            out.append(at)
            at = t.find(x, at + 1)
    return out


def _numbers(t: str) -> list[tuple[int, int]]:
    """The runs of digits."""
    try:
        coded = t.encode("latin-1")
    except UnicodeEncodeError:
        # there may be digits of other scripts
        return [m.span() for m in _NUMBER.finditer(t)]
    digit = np.frombuffer(b"\0" + coded.translate(_IS_DIGIT) + b"\0", np.int8)
    edges = np.flatnonzero(digit[1:] != digit[:-1]).tolist()
    return list(zip(edges[::2], edges[1::2]))


def _bare_ids(t: str, numbers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The values that need no label. numbers: the runs of digits, which tell where one can begin."""
    out = []
    done = 0
    for s, e in numbers:
        n = e - s
        if n == 2:
            if s < 3 or t[s - 1] not in " -" or not "A" <= t[s - 2] <= "Z":
                continue
            s -= 3
        elif n == 1:
            if t[s] not in "12" or t[e : e + 1] not in _BLANKS:
                continue
        elif n == 6 and s > 1:
            s -= 2
        elif n == 7 and s:
            s -= 1
        else:
            continue
        m = _BARE_ID.match(t, s) if s >= done else None
        if m:
            out.append(m.span())
            done = m.end()
    return out


def _label(t: str, at: int, done: int) -> re.Match | None:
    """The label, from `done` on, that holds what stands at `at`."""
    starts = range(max(done, at - _LABEL_STARTS), at + 1)
    # two words, and the gap between them: of the second one, up to two letters stand before `at`
    for low in (at - 2, at - 1, at):
        before = t[max(0, low - LABEL_REACH) : max(0, low)]
        gap = len(before) - len(before.rstrip(_BLANKS))
        if gap:
            starts = [*range(max(done, low - gap - _LABEL_GAP_STARTS), low - gap), *starts]
    return next((m for s in sorted(starts) if (m := _LABEL.match(t, s, at + LABEL_REACH)) and m.end() > at), None)


def _ids(t: str, numbers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = _bare_ids(t, numbers)
    done = 0
    # of all letters only this one changes its length
    for at in sorted(_places(t.replace("\u0130", "i").lower(), _HINTS) + _places(t, _SHORT_HINTS)):
        if at < done:
            continue
        label = _label(t, at, done)
        if not label:
            continue
        done = label.end()
        # the value is the first number after the label, in its line or one of the two after it
        stop = done
        for _ in range(3):
            stop = t.find("\x1f", stop + 1)
            if stop < 0:
                stop = len(t)
                break
        digit = next((d.start() for d in _DIGIT.finditer(t, done, stop) if not _in_encoded(t, d.start())), -1)
        value = _VALUE.search(t, max(done, digit - 130), digit + LABEL_REACH) if digit >= 0 else None
        while value and value.start() <= digit < value.end():
            s, e = value.span()
            # a lone letter after a number belongs to it in Spanish numbers only
            if _LONE_LETTER.fullmatch(value.group()) and label.group().upper() not in ("NIE", "DNI", "NIF"):
                e -= 2
            out.append((s, e))
            # further numbers of the same label
            more = _AND.match(t, e)
            value = more and _VALUE.match(t, more.end())
            digit = value.end() - 1 if value else -1
            while value and not t[digit].isdigit():
                digit -= 1
    return out


def _in_encoded(t: str, at: int) -> bool:
    """Whether the digit at `at` belongs to a quoted-printable byte such as =C3."""
    return bool(_ENCODED.match(t, at - 1) or _ENCODED.match(t, at - 2))


def _phones(t: str, numbers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    # how many digits follow each other from a run of digits on, with nothing else between than a phone number has; many before an extension
    follow = [0] * len(numbers)
    digits, after = 0, len(t)
    for k in range(len(numbers) - 1, -1, -1):
        s, e = numbers[k]
        rest = t[e:after].lstrip(_PHONE_GAPS)
        digits = e - s + (9 if rest and rest[0] in _EXTENSIONS else 0 if rest else digits)
        follow[k], after = digits, s
    out = []
    done = 0
    for k, (s, _) in enumerate(numbers):
        if follow[k] < 9:
            continue
        m = None
        for start in range(s - 2 if t[max(0, s - 2) : s] == "(+" else s - 1 if t[max(0, s - 1) : s] in ("+", "(") else s, s + 1):
            if start >= done and not (start and ((c := t[start - 1]).isalnum() or c in "_.@/=#-")) and (m := _PHONE.match(t, start)):
                break
        if not m:
            continue
        s, e = m.span()
        done = e
        number = re.split(r"(?i)ext|x|durchwahl|poste", m.group())[0]
        digits = sum(c.isdigit() for c in number)
        if not 9 <= digits <= 15 or _NO_PHONE.search(t, max(0, s - 30), s) or _UNITS.match(t, e) or number.count("\x1f") > 1:
            continue
        if number.count("(") != number.count(")"):
            if t[s] == "(" and ")" not in number:
                s += 1
            else:
                continue
        out.append((s, e))
    return out


def _addresses(t: str, numbers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    first = last = ended = 0
    for s, e in numbers:
        before, after = t[s - 1] if s else "", t[e : e + 1]
        if e - s <= 4 and s >= first and after and (after in " \t\xa0\x1f," or after.isalpha()) and not (before and (before.isalnum() or before in "_./-")) and (m := _HOUSE_FIRST.match(t, s)):
            flat = _FLAT.search(t, max(0, s - 30), s)
            out.append((flat.start() if flat else s, m.end()))
            first = m.end()
        if before and before in _BLANKS:
            word = s - 1
            while word and t[word - 1] in _BLANKS:
                word -= 1
            end = _HOUSE_END.search(t, max(ended, word - 6), s + 1) if word and t[word - 1] in "eE.gzmrdtl" else None
            if not end:
                continue
            ended = end.end()
            m = _HOUSE_LAST.search(t, max(last, end.start() - 60), ended + 60)
            if m and m.end() >= ended:
                out.append(m.span())
                last = m.end()
    if any(x in t for x in _STREETS):
        out += [m.span() for m in _HOUSE_SPANISH.finditer(t)]
    for m in _HOUSE_PLACED.finditer(t):
        s, e = m.span()
        line = t.rfind("\x1f", 0, s)
        own = not t[line + 1 : s].strip(" \t") and t[e : e + 80].lstrip(" \t")[:1] in ("", ",", "\x1f")
        if own or _PLACE_LABEL.search(t, max(0, s - 60), s):
            out.append((s, e))
    return [(s, e) for s, e in out if t.count("\x1f", s, e) <= 2]


def _names(t: str, lex: Lexicon) -> list[tuple[int, int]]:
    out = []
    at = 0
    given, family, pairs = lex.given, lex.family, lex.pairs
    for m in _WORD.finditer(t):
        w = m[0]
        low = w.lower()
        if not (low in given or low in family or low in pairs or "-" in low):
            continue
        s, e = m.span()
        if s < at:
            continue
        if low in given or "-" in low and lex.is_given(low):
            n = _NEXT.match(t, e)
            if n:
                gap, last = n.group(2), n.group(4).lower()
                known = lex.is_family(n.group(3)) or last in family
                wrapped = "\x1f" in gap
                if known or not wrapped and last not in NOT_FAMILY and len(last) > 2 and not lex.is_given(last):
                    out.append((s, n.end(3)))
                    at = n.end(3)
                    continue
                if lex.is_given(last) and not wrapped:
                    n2 = _NEXT.match(t, n.end(3))
                    if n2 and lex.is_family(n2.group(3)):
                        out.append((s, n2.end(3)))
                        at = n2.end(3)
                        continue
        elif pairs.get(low):
            n = _NEXT.match(t, e)
            if n and lex.is_pair(low, n.group(3)):
                out.append((s, n.end(3)))
                at = n.end(3)
                continue
        if low in family:
            start = s
            p = _PARTICLE_BEFORE.search(t, max(0, s - 30), s)
            if p:
                start = p.start()
            c = _COMMA.match(t, e)
            if c and (lex.is_given(c.group(1)) or lex.is_pair(c.group(1), w)):
                following = _NEXT.match(t, c.end())
                if not (following and "\x1f" not in following.group(2) and following.group(4).lower() in family) or t[max(0, start - 1)] == '"':
                    out.append((start, c.end()))
                    at = c.end()
                    continue
            i = _INITIAL.search(t, max(0, start - 12), start)
            if i and "\x1f" not in i.group():
                out.append((i.start(), e))
                at = e
                continue
            if i or (c := _COMMA_INITIAL.match(t, e)):
                span = (i.start(), e) if i else (start, c.end())
                out.append(span)
                at = span[1]
    for m in _LOWER.finditer(t):
        if lex.is_given(m.group(2)) and lex.is_family(m.group(4)) or lex.is_pair(m.group(2), _MIDDLE.sub("", m.group(3)).strip(" \t\xa0\x1f")):
            out.append(m.span(1))
    return out


def detect(text: str | None, lex: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal values of a text in order, none overlapping; of two that do, the kind earlier in
    email, id_number, address, phone, name stays. NULL and empty texts have none."""
    if not text or text.isspace():
        return []
    t = readable(text)
    numbers = _numbers(t)
    taken: list[tuple[int, int, str]] = []
    for kind, spans in (("email", _emails(t)), ("id_number", _ids(t, numbers)), ("address", _addresses(t, numbers)), ("phone", _phones(t, numbers)), ("name", _names(t, lex))):
        for s, e in spans:
            # those taken are in order and apart, so only the neighbours can overlap
            at = bisect.bisect_left(taken, (s,))
            if (at == len(taken) or taken[at][0] >= e) and (not at or taken[at - 1][1] <= s):
                taken.insert(at, (s, e, kind))
    return taken


# each looks back only where the next characters fit, since that costs more than all the rest
_DISPLAY = r"(?=[\p{Lu}])(?<![\p{L}'’-])([\p{Lu}][\p{L}'’-]+) ((?:(?:De la|Van der|Van den|Von der|Von|Van|Del) )?[\p{Lu}][\p{L}'’-]+) <([^<>\s@]+)@"
_QUOTED = r'"((?:(?:De la|Van der|Van den|Von der|Von|Van|Del) )?[\p{Lu}][\p{L}\'’-]+), ([\p{Lu}][\p{L}\'’-]+)" <([^<>\s@]+)@'
_COMMENT = r"@(?=[\w.-]+ \([\p{Lu}])(?:(?<=(?<![\w.+-])([\w.+-]{1,64})@))?[\w.-]+ \(([\p{Lu}][\p{L}'’-]+) ((?:(?:De la|Van der|Van den|Von der|Von|Van|Del) )?[\p{Lu}][\p{L}'’-]+)\)"
_COMMENTED = r"^([^@]*)@[\w.-]+ \(([\p{Lu}][\p{L}'’-]+) (.+)\)$"
_SHORT = r"(?=[\p{Lu}]\. )(?<![\p{L}.'’-])([\p{Lu}])\. ((?:(?:De la|Van der|Van den|Von der|Von|Van|Del) )?[\p{Lu}][\p{L}'’-]+)"
# fixed values: accented letters and what addresses have for them; beginnings of family names that a display pattern may take for a given name
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýšž", "aaaaaaceeeeiiiinoooooouuuuysz"
PARTICLES = frozenset("da de del den der di dos la las los mac van von".split())


def _person(given: Column, family: Column, local: Column, form: Column) -> tuple[Column, Column]:
    """Whether a display name and the local part beside it are those of a person: clearly (Family, Given; both names, or family name and
    initial, in the local part), and perhaps (one of the names is in it). Both names joined by a hyphen, as in disk-watch, tell nothing."""

    def folded(c: Column) -> list[Column]:
        german = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "ä", "ae"), "ö", "oe"), "ü", "ue")
        return [F.regexp_replace(F.translate(F.regexp_replace(x, "ß", "ss"), _ACCENTED, _PLAIN), r"[^\p{L}]", "") for x in (c, german)]

    base = F.regexp_replace(F.lower(local), r"\+.*$|[0-9]+", "")
    flat = folded(base)[0]
    named = base != F.concat_ws("-", given, F.regexp_replace(family, " ", "-"))
    clear, perhaps = form == "quoted", F.lit(False)
    for g, f in itertools.product(folded(given), folded(family)):
        initial = F.substring(g, 1, 1)
        has_f, has_g = (F.length(f) > 2) & flat.contains(f), (F.length(g) > 2) & flat.contains(g)
        clear = clear | named & (has_f & has_g | (F.length(f) > 2) & flat.isin(F.concat(initial, f), F.concat(f, initial)))
        perhaps = perhaps | named & (has_f | has_g)
    return clear, perhaps


def lexicon_entries(documents: DataFrame, name_parts: DataFrame, text: str = "text") -> DataFrame:
    """(kind, w, family, n): given and family names, and given names that count beside one family name only, with the number of family names or documents.

    They are learned from the display names beside addresses in all texts, plus name_parts. A given name must stand before two family names, or before one of
    name_parts, or be in name_parts itself. A person whose given name is theirs alone is a pair: told from a role by the address's local part, by the form
    "Family, Given", or by an initial with the family name in any text.
    """

    def matches(pattern: str, within: str, group: int = 0) -> Column:
        # within: what every match holds; texts without it needn't be searched
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
        return F.when(F.col(text).contains(within), found).otherwise(F.array().cast("array<string>"))

    def part(form: str, given: int, family: int, local: int, pattern: str) -> Column:
        at = [F.lower(F.regexp_extract("m", pattern, i) if i else F.lit("")).alias(n) for n, i in (("g", given), ("f", family), ("local", local))]
        return F.struct(F.lit(form).alias("form"), *at)

    # the texts are searched once per pattern (comments twice, for the local part before them); the parts are taken from the matches
    comments = F.zip_with(matches(_COMMENT, " (", 1), matches(_COMMENT, " ("), lambda local, m: F.concat(local, m))
    beside = F.array_distinct(F.concat(matches(_DISPLAY, " <"), matches(_QUOTED, '" <'), comments, matches(_SHORT, ". ")))
    found = documents.where(F.col(text).isNotNull()).select(F.explode(beside).alias("m"))
    forms = F.when(F.col("m").startswith('"'), part("quoted", 2, 1, 3, _QUOTED)).when(F.col("m").endswith(")"), part("comment", 2, 3, 1, _COMMENTED)).when(F.substring("m", 2, 1) == ".", part("short", 1, 2, 0, _SHORT))
    parts = forms.otherwise(part("plain", 1, 2, 3, _DISPLAY))
    shown = found.groupBy("m").count().select(parts.alias("x"), "count").select("x.*", "count")
    clear, perhaps = _person(F.col("g"), F.col("f"), F.col("local"), F.col("form"))
    shown = shown.groupBy((F.col("form") == "short").alias("short"), "g", "f").agg(F.sum("count").alias("count"), F.bool_or(clear).alias("clear"), F.bool_or(perhaps).alias("perhaps"))
    shown = Stored(shown).df
    roles = [*ROLE_WORDS]
    persons = shown.where(~F.col("short") & ~F.col("g").isin(roles) & ~F.col("f").isin(roles)).drop("short")
    known = name_parts.where("name_part IS NOT NULL").select(F.lower("name_part").alias("w"), "kind").distinct()
    sure = known.where("kind = 'family'").select(F.col("w").alias("f"), F.lit(True).alias("sure"))
    words = persons.select(F.explode(F.split("g", "-")).alias("w"), "f").join(sure, "f", "left").groupBy("w").agg(F.countDistinct("f").alias("n"), F.bool_or("sure").alias("sure"))
    given = words.where("n >= 2 OR sure").select("w", "n").union(known.where("kind = 'given'").select("w", F.lit(1 << 40))).groupBy("w").agg(F.max("n").alias("n"))
    given = Stored(given).df
    family = persons.groupBy(F.col("f").alias("w")).agg(F.sum("count").alias("n")).union(known.where("kind = 'family'").select("w", F.lit(1 << 40))).groupBy("w").agg(F.max("n").alias("n"))
    no_name = [*NOT_FAMILY, *PARTICLES]
    alone = persons.where(~F.col("g").isin(no_name) & ~F.col("f").isin(no_name)).withColumn("w", F.explode(F.split("g", "-"))).join(given, "w", "left_anti").drop("w").distinct()
    # a word before a given name is no given name, so what only perhaps is a person must not end in one
    first = persons.select(F.explode(F.split("g", "-")).alias("f")).union(given.select(F.col("w").alias("f"))).distinct().withColumn("is_first", F.lit(True))
    initials = shown.where("short").select(F.col("g").alias("i"), "f", F.lit(True).alias("initial"))
    judged = alone.withColumn("i", F.substring("g", 1, 1)).join(initials, ["i", "f"], "left").join(first, "f", "left")
    pairs = judged.where("clear OR initial OR perhaps AND is_first IS NULL").select("g", "f", "count")
    rows = [given.select(F.lit("given").alias("kind"), "w", F.lit("").alias("family"), "n"), family.select(F.lit("family"), "w", F.lit(""), "n"), pairs.select(F.lit("pair"), "g", "f", "count")]
    return Stored(rows[0].union(rows[1]).union(rows[2])).df


def learn_lexicon(documents: DataFrame, name_parts: DataFrame, text: str = "text", shared: int = SHARED_LEXICON) -> tuple[Lexicon, DataFrame | None]:
    """The lexicon of `lexicon_entries`: of each kind the most frequent entries, whose number bounds what every task holds, and a table
    (kind, w, family) of all others, or None."""
    entries = lexicon_entries(documents, name_parts, text)
    ranked = with_positions(entries, ["kind"], [F.desc("n"), F.col("w"), F.col("family")], "place")
    first = ranked.where(F.col("place") < shared).select("kind", "w", "family").collect()
    by = {k: [(r["w"], r["family"]) for r in first if r["kind"] == k] for k in ("given", "family", "pair")}
    rest = Stored(ranked.where(F.col("place") >= shared).select("kind", "w", "family")).df if any(len(x) >= shared for x in by.values()) else None
    return Lexicon([w for w, _ in by["given"]], [w for w, _ in by["family"]], by["pair"]), rest


def _with_rest(texts: DataFrame, rest: DataFrame) -> DataFrame:
    """texts(_text, ...) with _more, the entries of `rest` whose last word stands in the text: a join on words, so that no task holds them all."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}[\p{L}'’]*"), F.lit(0)))
    said = texts.select(F.xxhash64("_text").alias("_h"), F.explode(words).alias("_word")).distinct()
    last = rest.withColumn("_word", F.element_at(F.split(F.col("w"), "[ -]"), -1))
    more = said.join(last, "_word").groupBy("_h").agg(F.collect_set(F.struct("kind", "w", "family")).alias("_more"))
    return texts.withColumn("_h", F.xxhash64("_text")).join(more, "_h", "left").drop("_h")


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("found_text", T.StringType())]))


def entities(documents: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, with_canon: bool = False, shared: int = SHARED_LEXICON) -> DataFrame:
    """(key, entities[, redacted][, text_hash]): the personal values of each text with kind, place and raw spelling; with_text adds the text with a
    placeholder such as [EMAIL] for each; with_canon adds to each value what its spellings have in common, and the hash of the text. A NULL text
    has no values and stays NULL; every row of `documents` comes back."""
    lexicon, rest = learn_lexicon(documents, name_parts, text, shared)
    sent = documents.sparkSession.sparkContext.broadcast(lexicon)
    found = T.ArrayType(T.StructType([*FOUND.elementType.fields, *([T.StructField("canon", T.StringType())] if with_canon else [])]))
    extra = [T.StructField("redacted", T.StringType())] * with_text + [T.StructField("text_hash", T.LongType())] * with_canon
    schema = T.StructType([documents.schema[key], T.StructField("entities", found), *extra])
    names, kinds = found.elementType.fieldNames(), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())

    def run(batches):
        lex = sent.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            if "_more" in batch.schema.names:
                spans = []
                for x, more in zip(texts, batch.column("_more").to_pylist()):
                    with lex.also((m["kind"], m["w"], m["family"]) for m in more or ()):
                        spans.append(detect(x, lex))
            else:
                spans = [detect(x, lex) for x in texts]
            flat = [(k, a, b, x[a:b], *([canonical(k, x[a:b])] if with_canon else [])) for x, s in zip(texts, spans) for a, b, k in s]
            parts = [pa.array(v, t) for v, t in zip(zip(*flat) if flat else [()] * len(names), kinds)]
            offsets = pa.array([0, *itertools.accumulate(map(len, spans))], pa.int32())
            columns = [batch.column(0), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names))]
            if with_text:
                columns.append(pa.array([redact(x, s) for x, s in zip(texts, spans)], pa.string()))
            if with_canon:
                columns.append(batch.column("_hash"))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = documents.select(F.col(key), F.col(text).alias("_text"), *([F.xxhash64(text).alias("_hash")] if with_canon else []))
    return (rows if rest is None else _with_rest(rows, rest)).mapInArrow(run, schema)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def found_values(documents: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(doc_id, kind, found_text), once per document, kind and spelling."""
    e = entities(documents, name_parts)
    one = F.array_distinct(F.transform("entities", lambda x: F.struct(x["kind"].alias("kind"), x["found_text"].alias("found_text"))))
    return e.select("doc_id", F.explode(one).alias("x")).select("doc_id", "x.kind", "x.found_text").distinct()


# fixed values: parts that surrogate names and streets are put together from; endings of given names by gender
_STEMS = ("Al", "Bre", "Cor", "Dan", "El", "Far", "Gal", "Hes", "Il", "Jor", "Kal", "Lan", "Mar", "Nor", "Or", "Per", "Quin", "Ros", "Sel", "Tor", "Ul", "Ver", "Wen", "Yor", "Zan")
_TAILS = ("abel", "adine", "amon", "aris", "elin", "enor", "eska", "etta", "iana", "ibert", "idor", "ilka", "imar", "inde", "isco", "olan", "omir", "onia", "orin", "ulla")
_FEMALE, _MALE = ("adine", "eska", "etta", "iana", "ilka", "inde", "onia", "ulla"), ("amon", "ibert", "idor", "imar", "isco", "olan", "omir", "orin")
# fixed values: letters of other scripts for those of the parts
_CYRILLIC = str.maketrans(dict(zip("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопкрстуввхиз")))
_GREEK = str.maketrans(dict(zip("abcdefghijklmnopqrstuvwxyz", "αβκδεφγηιικλμνοπκρστυβωξυζ")))
# fixed values: titles and salutations that tell the gender of the given name after them
_HE = r"(?:Mr\.?|Herrn?|Monsieur|M\.|Señor|Sr\.|Lieber|Cher|Estimado|Querido)"
_SHE = r"(?:Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme\.?|Mlle\.?|Señora|Sra\.|Liebe|Chère|Estimada|Querida)"


def script_of(text: str) -> str:
    """Latin, Cyrillic or Greek, by the first letter that is of one of them."""
    for c in text:
        if "\u0400" <= c <= "\u052f":
            return "Cyrillic"
        if "\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff":
            return "Greek"
        if c.isalpha() and c < "\u0250":
            return "Latin"
    return "Latin"


def _name(v: str) -> tuple[str, str]:
    """(given, family) of a name in lower case: a full given name, or an initial with its dot; middle initials are left out."""
    if "," in v:
        family, given = (x.strip() for x in v.split(",", 1))
        words = given.split()
    else:
        words = v.replace(".", ". ").split()
        # the family name is the last word with the particles before it
        at = len(words) - 1
        while at > 1 and words[at - 1] in PARTICLES:
            at -= 1
        words, family = words[:at], " ".join(words[at:])
    full = [w for w in words if not w.endswith(".")]
    return " ".join(full) if full else words[0] if words else "", family


def canonical(kind: str, found: str) -> str:
    """What spellings of one entity have in common within a kind: case, spaces, separators and disguises don't count. A name is given
    name and family name, without middle initials; "i. family" is what an initial form says of it."""
    v = re.sub(r"[\s\x1f>|]+", " ", found).strip().lower()
    if kind == "email":
        v = re.sub(r"\s*[\[({<]at[\])}>]\s*|\s+at\s+|\s+arobase\s+|\s*[\[(]@[\])]\s*", "@", v)
        return re.sub(r"\s*[\[({]dot[\])}]\s*|\s+dot\s+|[\[(]\.[\])]|\s+(?:point|punkt|punto)\s+", ".", v)
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9a-z+]", "", re.sub(r"\(0\)", "", v))
    return " ".join(_name(v)).strip() if kind == "name" else v


def surrogate(kind: str, canon: str, secret: str, salt: int = 0, gender: str = "") -> str:
    """A keyed replacement of an entity, the same for all its spellings: a name of its gender ("m", "f" or unknown) and script, an address of
    ours, or digits and letters in the same format. Another salt gives another one; names, streets and numbers grow with it, so that there are
    always more."""
    h = hashlib.blake2b(f"{salt}\x00{kind}\x00{canon}".encode(), key=secret.encode()[:64], digest_size=32).digest()
    n = int.from_bytes(h, "big")

    def draw(of: Sequence[str]) -> str:
        nonlocal n
        n, at = divmod(n, len(of))
        return of[at]

    def word(tails: int = 2) -> str:
        return draw(_STEMS) + "".join(draw(_TAILS) for _ in range(tails + min(salt // 4, 8)))

    if kind == "name":
        given = draw(_STEMS) + draw(_TAILS)[:2] + draw({"f": _FEMALE, "m": _MALE}.get(gender, _TAILS))
        new = f"{given} {word()}"
        letters = {"Cyrillic": _CYRILLIC, "Greek": _GREEK}.get(script_of(canon))
        return new.lower().translate(letters).title() if letters else new
    if kind == "email":
        return f"{word()}.{word()}{n % 1000}@surrogate.example".lower()
    out = []
    for i, c in enumerate(canon):
        n, d = divmod(n, 10) if n else (int.from_bytes(hashlib.blake2b(h + bytes([i % 256]), digest_size=16).digest(), "big"), 7)
        if c.isdigit():
            out.append(c if kind == "phone" and i < 3 and len(canon) > 8 and canon.startswith(("+", "00")) else str(d))
        else:
            out.append(chr(97 + (ord(c) - 97 + d + 1) % 26) if kind == "id_number" and "a" <= c <= "z" else c)
    if kind == "address":
        return re.sub(r"[^\W\d_]{4,}", lambda m: m.group() if m.group() in _KEPT else word(1), "".join(out), count=3)
    return "".join(out) + str(salt)[: salt // 32]


_KEPT = frozenset("street road lane avenue court blvd close flat suite calle avda plaza avenue boulevard impasse straße strasse bajo".split())


def mark_of(kind: str, value: str) -> str:
    """What must differ between two entities: of a name the initial with the family name, since that is all that some spellings show."""
    if kind != "name":
        return value
    given, family = value.split(" ", 1) if " " in value else ("", value)
    return f"{given[:1]}. {family}".lower()


def in_format(kind: str, found: str, new: str) -> str:
    """The surrogate in the spelling of the value it replaces: separators and letter case of numbers, order and case of names."""
    if kind in ("phone", "id_number"):
        chars = iter(new)
        kept = re.sub(r"\(0\)", "\x02", found)
        out = "".join(next(chars, "0") if c.isalnum() or c == "+" else c for c in kept) + "".join(chars)
        out = "".join(o.upper() if c.isupper() else o for c, o in zip(kept, out)) + out[len(kept) :]
        return out.replace("\x02", "(0)")
    if kind == "name":
        given, family = new.split(" ", 1)
        # the only given name is an initial
        if _name(re.sub(r"[\s\x1f>|]+", " ", found).strip().lower())[0].endswith("."):
            given = given[0] + "."
        new = f"{family}, {given}" if "," in found else f"{given} {family}"
    if found.isupper():
        return new.upper()
    if found.islower():
        return new.lower()
    return new.title() if kind == "address" else new


def genders(documents: DataFrame, text: str = "text") -> DataFrame:
    """(given, gender) of the words that stand after titles and salutations of one gender at least twice as often as after those of the other."""
    name = r"\s+([\p{Lu}][\p{L}'’-]+)"

    def after(gender: str, title: str) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(rf"(?<![\p{{L}}.]){title}{name}"), F.lit(1))
        return F.transform(found, lambda w: F.struct(F.lower(w).alias("given"), F.lit(gender).alias("g")))

    said = [after("m", _HE), after("f", _SHE)]
    each = documents.where(F.col(text).isNotNull()).select(F.explode(F.concat(*said)).alias("x")).groupBy("x.given").agg(F.sum((F.col("x.g") == "m").cast("int")).alias("m"), F.sum((F.col("x.g") == "f").cast("int")).alias("f"))
    return each.select("given", F.when(F.col("m") >= 2 * F.col("f"), "m").when(F.col("f") >= 2 * F.col("m"), "f").alias("gender")).where("gender IS NOT NULL")


def one_entity(spans: DataFrame, document: Sequence[str]) -> DataFrame:
    """spans(*document, kind, canon, ...) with `entity`: canon, but of an initial form the one full name of that initial and family name in its
    document, else in all documents; where there are several or none, the initial form is an entity of its own."""
    is_initial = (F.col("kind") == "name") & F.col("canon").rlike(r"^\p{L}\. ")
    given, family = F.substring_index("canon", " ", 1), F.expr("substring(canon, instr(canon, ' ') + 1)")
    known = spans.where((F.col("kind") == "name") & ~is_initial & F.col("canon").contains(" "))
    known = known.select(*document, F.substring(given, 1, 1).alias("_i"), _family(F.col("canon")).alias("_f"), "canon").distinct()

    def single(of: Sequence[str], out: str) -> DataFrame:
        return known.groupBy(*of, "_i", "_f").agg(F.min("canon").alias(out), F.max("canon").alias("_most")).where(F.col(out) == F.col("_most")).drop("_most")

    rest = spans.where(~is_initial).withColumn("entity", F.col("canon"))
    initial = spans.where(is_initial).withColumn("_i", F.substring(given, 1, 1)).withColumn("_f", family)
    near = initial.join(single(document, "_near"), [*document, "_i", "_f"], "left").join(single([], "_far"), ["_i", "_f"], "left")
    return rest.unionByName(near.withColumn("entity", F.coalesce("_near", "_far", "canon")).select(*rest.columns))


def _family(canon: Column) -> Column:
    """The family name of a full canonical name: its last word with the particles before it."""
    return F.regexp_extract(canon, rf"((?:(?:{'|'.join(sorted(PARTICLES))}) )*[^ ]+)$", 1)


def surrogates(found: DataFrame, secret: str) -> DataFrame:
    """(kind, entity, surrogate) of every distinct entity of found(kind, entity[, gender]), no two entities of a kind with one surrogate, even
    where only an initial of the given name is written.

    Entities that collide, with another or with a value that occurs, take the next salt until none is left; the first in order of a
    colliding set keeps its surrogate. A NULL gender is an unknown one.
    """
    gender = F.max("gender") if "gender" in found.columns else F.lit("")
    real = Stored(found.groupBy("kind", "entity").agg(F.coalesce(gender, F.lit("")).alias("gender"))).df

    def marks(batches):
        for pdf in batches:
            yield pd.DataFrame({"kind": pdf["kind"], "mark": [mark_of(k, e) for k, e in zip(pdf["kind"], pdf["entity"])]})

    def draw(batches):
        for pdf in batches:
            drawn = [surrogate(k, e, secret, s, g) for k, e, s, g in zip(pdf["kind"], pdf["entity"], pdf["salt"], pdf["gender"])]
            yield pdf.assign(surrogate=drawn, mark=[mark_of(k, x) for k, x in zip(pdf["kind"], drawn)])

    state = "kind STRING, entity STRING, gender STRING, salt INT, surrogate STRING, mark STRING"
    taken = Stored(real.mapInPandas(marks, "kind STRING, mark STRING").distinct().withColumn("occurs", F.lit(True))).df
    done, open_ = None, real.withColumn("salt", F.lit(0))
    while True:
        drawn = open_.mapInPandas(draw, state).withColumn("old", F.lit(1))
        both = Stored(drawn if done is None else drawn.unionByName(done.withColumn("old", F.lit(0)))).df
        first = both.groupBy("kind", "mark").agg(F.min(F.struct("old", "entity")).alias("w"))
        judged = both.join(first, ["kind", "mark"]).join(taken, ["kind", "mark"], "left")
        good = (F.col("w.entity") == F.col("entity")) & F.col("occurs").isNull() | (F.col("old") == 0)
        settled = Stored(judged.select("kind", "entity", "gender", "salt", "surrogate", "mark", good.alias("good"))).df
        done = settled.where("good").drop("good")
        open_ = settled.where("NOT good").select("kind", "entity", "gender", (F.col("salt") + 1).alias("salt"))
        if open_.isEmpty():
            return done.select("kind", "entity", "surrogate")


def pseudonymise(documents: DataFrame, name_parts: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with every personal value replaced by its surrogate: same entity, same surrogate, in all texts; names keep their gender, as far
    as titles in the texts tell it, and script. Texts without values and NULL texts come back as they are, repeated rows and NULL keys too."""
    found = Stored(entities(documents, name_parts, key, text, with_canon=True)).df
    document = ["_k", "_hash"]
    spans = found.select(F.col(key).alias("_k"), F.col("text_hash").alias("_hash"), F.explode("entities").alias("x")).select(*document, "x.*").distinct()
    named = Stored(one_entity(spans, document).withColumn("given", F.when(F.col("kind") == "name", F.substring_index("entity", " ", 1)))).df
    of = named.select("kind", "entity", "given").distinct().join(genders(documents, text), "given", "left")
    mapped = surrogates(of, secret)
    put = F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("_spans")
    placed = named.join(mapped, ["kind", "entity"]).groupBy(*document).agg(put).withColumnRenamed("_hash", "_h")

    def rewrite(batches):
        for batch in batches:
            out = []
            for t, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()):
                parts, at = [], 0
                for s in spans or ():
                    parts += [t[at : s["start"]], in_format(s["kind"], t[s["start"] : s["end"]], s["surrogate"])]
                    at = s["end"]
                out.append("".join([*parts, t[at:]]) if spans else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, text])

    joined = documents.select(F.col(key), F.col(text).alias("_text")).join(placed, F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64("_text") == F.col("_h")), "left")
    return joined.select(key, "_text", "_spans").mapInArrow(rewrite, T.StructType([documents.schema[key], T.StructField(text, T.StringType())]))
