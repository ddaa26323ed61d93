"""Personal information inside free text: found with its place in the source, and replaced by placeholders.

A text is first rewritten by transducers that keep, for every character they write, the place it came
from: invisible characters vanish, homoglyphs, full-width forms, odd blanks and dashes become plain
ones, runs of spelled digits become digits, and at/dot disguises of mailboxes become signs. Detectors
run on the rewritten text, and what they find is mapped back to the characters of the source.

Names are judged with a lexicon of given and family names and with its morphology: stems and endings
that recur in the lexicon also form names that it lacks. The lexicon has a stated bound (max_names);
it is a fixed list of a few hundred entries, not a table that grows with the texts.

Defined cases: null or empty texts hold nothing, and stay as they are when placeholders are put in;
the same value is listed once per document and type; texts may be of any length; an empty lexicon
finds no names. Only the id and the text are read; other columns do not matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.words import invisible_class
from graphlens.session import parallel

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Spoken digits.
_SPOKEN = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
# Particles of family names.
_PARTICLES = "van von der den de del della di da dos du la le ter ten zu zum al bin ibn af av y".split()


@lru_cache(1)
def _plain() -> dict[int, str]:
    """One character for one: compatible forms, digits of other scripts, blanks, dashes, quotes."""
    out: dict[int, str] = {}
    for c in [*range(0x80, 0x3000), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)]:
        ch = chr(c)
        k = unicodedata.category(ch)
        if k == "Nd":
            out[c] = str(unicodedata.decimal(ch))
        elif k == "Zs":
            out[c] = " "
        elif k == "Pd":
            out[c] = "-"
        else:
            n = unicodedata.normalize("NFKC", ch)
            if len(n) == 1 and n != ch and n.isascii():
                out[c] = n
    out |= {0x2212: "-", 0x2019: "'", 0x2018: "'", 0x3000: " "}
    return out


@lru_cache(1)
def _unseen() -> re.Pattern:
    return re.compile(f"[{invisible_class()}]")


_OTHER_SCRIPT = re.compile("[Ͱ-ӿԁԛԝ]")
_MIXED = re.compile(r"\w*(?:[A-Za-z0-9@.][Ͱ-ӿԁԛԝ]|[Ͱ-ӿԁԛԝ][A-Za-z0-9@.])[\w@.]*")
_SPELLED = re.compile(r"\b(?:%s)(?:[ -]+(?:%s)){5,}\b" % (("|".join(_SPOKEN),) * 2), re.I)


class Tape:
    """A rewritten text and where each of its characters came from."""

    def __init__(self, source: str):
        self.source = self.text = source
        self.starts: list[int] | None = None  # None: character i came from i
        self.ends: list[int] | None = None
        if not source.isascii():
            if _unseen().search(source):
                keep = [i for i, ch in enumerate(source) if not _unseen().match(ch)]
                self.text = "".join([source[i] for i in keep])
                self.starts, self.ends = keep, [i + 1 for i in keep]
            self.text = self.text.translate(_plain())
            if _OTHER_SCRIPT.search(self.text):
                self.text = _MIXED.sub(lambda m: "".join(_LOOKALIKES.get(c, c) for c in m.group()), self.text)
        low = self.text.lower()
        if ("at" in low or "@" in low) and ("dot" in low or _BRACKETED_AT.search(low)):
            self.rewrite(_DISGUISED, _undisguised)
        self.spelled: list[tuple[int, int]] = []  # blocks of digits that were words, in the rewritten text
        if sum(map(low.count, _SPOKEN)) >= 6 and _SPELLED.search(self.text):
            self.spelled = self.rewrite(_SPELLED, lambda m: "".join(_SPOKEN[w.lower()] for w in re.findall(r"[A-Za-z]+", m.group())))

    def rewrite(self, pattern: re.Pattern, by) -> list[tuple[int, int]]:
        """Replace matches (where by gives a text); all characters written for a match stand for the whole of it. Gives the places written to."""
        starts, ends, text, ns, ne, at, size, places = self.starts, self.ends, [], [], [], 0, 0, []
        for m in pattern.finditer(self.text):
            new = by(m)
            if new is None:
                continue
            if starts is None:
                starts, ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
            a, b = m.span()
            text += [self.text[at:a], new]
            ns += starts[at:a] + [starts[a]] * len(new)
            ne += ends[at:a] + [ends[b - 1]] * len(new)
            size += a - at + len(new)
            places.append((size - len(new), size))
            at = b
        if places:
            text.append(self.text[at:])
            self.text, self.starts, self.ends = "".join(text), ns + starts[at:], ne + ends[at:]
        return places

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])


def fold_name(name: str) -> str:
    out = unicodedata.normalize("NFKD", name.translate({0x142: "l", 0x141: "l", 0xF8: "o", 0xD8: "o", 0x111: "d", 0x110: "d"}))
    return "".join(c for c in out if not unicodedata.combining(c)).casefold()


class Names:
    """Judges words as given and family names."""

    GIVEN, FAMILY = 1, 2

    def __init__(self, given: Iterable[str], family: Iterable[str]):
        self.lists = {self.GIVEN: {fold_name(n) for n in given if n}, self.FAMILY: {fold_name(n) for n in family if n}}
        self.parts = {k: self._parts(ns) for k, ns in self.lists.items()}
        self.known: dict[str, int] = {}
        self.tokens: dict[str, int] = {}

    @staticmethod
    def _parts(names: set[str], count: int = 4, letters: int = 3) -> tuple[set[str], set[str]]:
        """Stems and endings: an ending follows several letters in several names, a stem is what it leaves of a name."""
        before: dict[str, list[str]] = {}
        for n in names:
            for i in range(2, len(n) - 1):
                before.setdefault(n[i:], []).append(n[i - 1])
        tails = {t for t, ls in before.items() if len(ls) >= count and len(set(ls)) >= letters}
        return {n[:i] for n in names for i in range(2, len(n) - 1) if n[i:] in tails}, tails

    def of_token(self, token: str) -> int:
        """Kind of a word, or of a hyphenated one whose parts agree; words of one or two letters are none."""
        got = self.tokens.get(token)
        if got is None:
            if "-" in token:
                ks = [self.kind(p) for p in token.split("-")]
                got = self.FAMILY if all(k & self.FAMILY for k in ks) else self.GIVEN if all(k & self.GIVEN for k in ks) else 0
            else:
                got = self.kind(token) if len(token) > 2 else 0
            if len(self.tokens) > 500_000:
                self.tokens.clear()
            self.tokens[token] = got
        return got

    def kind(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            w, got = fold_name(word), 0
            for k, names in self.lists.items():
                heads, tails = self.parts[k]
                if w in names or any(w[:i] in heads and w[i:] in tails for i in range(2, len(w) - 1)):
                    got |= k
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = got
        return got


_EDGE = r"(?<![\w@.+-])"
_MAILBOX = r"[A-Za-z0-9][\w.+%-]*"
_EMAIL = re.compile(_EDGE + rf"{_MAILBOX}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}", re.A)
_AT = r"(?: ?[\[({<] ?at ?[\])}>] ?| at |@| @ )"
_DOT = r"(?: ?[\[({<] ?dot ?[\])}>] ?| dot |\.| \. )"
# the local part may spell its dots too
_SPOKEN_MAILBOX = rf"{_MAILBOX}(?:(?: ?[\[({{<] ?dot ?[\])}}>] ?| dot ){_MAILBOX})*"
_DISGUISED = re.compile(_EDGE + rf"({_SPOKEN_MAILBOX})({_AT})((?:[A-Za-z0-9-]+{_DOT})+?[A-Za-z]{{2,}})(?=$|[^\w.@-]|[.-](?:\W|$))(?! ?[\[({{<] ?dot| dot )", re.I | re.A)
_BRACKETED_AT = re.compile(r"[\[({<] ?at ?[\])}>]")
_SPOKEN_DOT = re.compile(r" ?[\[({<] ?dot ?[\])}>] ?| dot | \. ", re.I)


def _undisguised(m: re.Match) -> str | None:
    """The mailbox that a disguise spells; None where the words are none."""
    at = m.group(2).strip().lower()
    spoken = bool(re.search(r"dot" if at == "@" else r"\bdot\b", m.group(3), re.I))
    if at in ("at", "@") and not spoken:
        return None  # "file at www.site.org": words, not a mailbox
    # a top domain may be any word, but "look at the dot plot" is no mailbox: then the local part must tell, or the domain be a known one
    if at == "at" and m.group(3).split()[-1].lower() not in _SPOKEN_DOMAINS and not re.search(r"[.\d_]| dot |[\[({<] ?dot", m.group(1), re.I):
        return None
    return _SPOKEN_DOT.sub(".", m.group(1)) + "@" + _SPOKEN_DOT.sub(".", m.group(3))


_NO_MAILBOX = re.compile(r"(?:\w+://\S*|(?:git|ssh|scp|rsync)[+:]\S*)$", re.I)
# Top domains that a mailbox spelled in words may end in.
_SPOKEN_DOMAINS = frozenset(
    "com org net edu gov mil int info biz io dev app co ai tv xyz cloud tech online site example test invalid localhost local eu de fr uk us ca au nl es pl se dk fi jp cn kr br ru ch cz pt gr hu ro "
    "ie nz mx ar cl za tr ua il".split())
# Accounts of repository hosts.
_SERVICE_ACCOUNTS = {"git", "hg", "svn", "gitea", "gitlab"}

_NUM = r"(?<![\w.+/-])(?<!\d[ -])"
_END = r"(?![\w/-])(?!\.\d)(?! ?\d)"
_PHONES = [re.compile(_NUM + p + _END, re.A) for p in (
    r"(?:\+1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4}",
    r"(?:\+44 ?(?:\(0\) ?)?|0)(?:\d{2}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}|\d{4}[ -]\d{3}[ -]\d{3}|\d{3}[ -]\d{3}[ -]\d{4})",
    r"(?:\+33 ?(?:\(0\) ?)?|0)[1-9](?:[ .-]\d{2}){4}",
    r"(?:\+49 ?(?:\(0\) ?)?|0)[1-9]\d{1,4}(?:[ /-]|(?<=\d) ?[/-] ?)\d{4,8}(?:[ -]\d{1,4})?",
    r"\(0\d{1,4}\) ?\d{3,8}(?:[ -]\d{2,5})?",
    r"\+(?:[2-9]\d{1,2})[ .-]?(?:\(0\) ?)?\d{1,4}(?:[ .-]?\d{2,4}){2,4}",
    r"\+\d{9,14}",
)]
_IDS = [re.compile(p, re.A) for p in (
    _NUM + r"\d{3}-\d{2}-\d{4}" + _END,
    r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])",
    r"(?<![\w-])[A-Z]{2}-\d{6}-\d(?![\w-])",
    r"(?<![\w-])[A-Z]\d{7,8}(?![\w-])",
)]
_LABELS = r"(?:tax|personal|national|identity|id|identification|TIN|Steuer|SSN|social|soc\.? ?sec|passport|Reisepass|Ausweis|NINO|insurance|fiscal)"
_LABELLED_ID = re.compile(
    rf"\b{_LABELS}\b[\w. -]{{0,24}}?(?:no\.?|number|nr\.?|#|:|=| )\s?(\d{{2}} \d{{3}} \d{{3}} \d{{3}}|\d{{9,12}}|\d{{3}} \d{{2}} \d{{4}})(?![\w-])(?! ?\d)", re.I | re.A)
_GROUPED_ID = re.compile(_NUM + r"\d{2} \d{3} \d{3} \d{3}(?![\w/-])(?!\.\d)(?! ?\d)(?! ?(?:bytes|[kKMG]i?B|bits|rows|ms|s)\b)", re.A)

_DIGIT = re.compile(r"\d")
# every phone number, and every identity number without letters, holds six digits with at most two other characters between them
_LONG_NUMBER = re.compile(r"\d(?:\D{0,4}\d){5}", re.A)
_PHONE_LABEL = re.compile(r"\b(?:phone|tel|telephone|mobile|cell|fax)(?: (?:no|number))?\W*(?:is\W*)?$", re.I)

_CAP = r"[A-ZÀ-ÖØ-ÞŁŚŻŒ][\w'-]*"
_HOUSE = r"\d{1,4} ?-? ?\d{0,4}[A-Za-z]?"
_NO = r"\d{1,4}[A-Za-z]?(?:-\d{1,4}[A-Za-z]?)?"
_KINDS = r"(?:Street|Str|St|Road|Rd|Lane|Ln|Close|Cl|Avenue|Ave|Drive|Dr|Court|Ct|Crescent|Terrace|Place|Pl|Way|Square|Sq|Boulevard|Blvd|Parkway|Gardens|Grove|Row|Hill|Walk|Mews)"
_ADDRESSES = [re.compile(p) for p in (
    rf"(?<![\w.-]){_NO},? (?:{_CAP} ){{1,3}}?(?:{_KINDS}|{_KINDS.upper()})\b(?![-'])",
    rf"(?<![\w.-]){_NO},? (?:bis |ter )?(?:[Rr]ue|RUE|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Qq]uai|[Aa]llée|[Ii]mpasse) (?:(?:de la|de l'|des|du|de|DES|DE|DU|d') ?)?{_CAP}",
    rf"\b(?:(?:Calle|CALLE|Avenida|Avda\.|Plaza|Paseo|Camino|Via|Viale|Rua|Piazza) |C/ ?)(?:(?:del|de la|de los|de las|de|di|da|do|della|DEL|DE) )?{_CAP}(?: {_CAP})?,? {_NO}(?!\w)",
)]
# street names written in one word, or ending in a word for street: the number is found first, then the name before it
_AFTER_STREET = re.compile(
    rf"(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|ufer|damm|steig|pfad|STRASSE|WEG|ALLEE|GASSE|[ -](?:Straße|Strasse|Str\.|Weg|Allee|Gasse|Platz|Ring|Ufer|Damm)) ?,? {_NO}(?![\w-])")
_BEFORE_STREET = re.compile(rf"(?<![\w-])(?:(?:Alte|Neue|Obere|Untere|Große|Kleine|Am|An der|Zum|Zur) )?{_CAP}$")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_INITIAL = re.compile(r"[^\W\d_]\.?(?:-?[^\W\d_]\.)*")
_WORDISH = set("@_/\\")

TYPES = ("email", "address", "phone", "id_number", "name")


def _names(t: str, names: Names) -> Iterator[tuple[int, int]]:
    """Given and family name together, in either order."""
    kinds = [names.of_token(w) for w in _TOKEN.findall(t)]
    at = [i for i, k in enumerate(kinds) if k]
    # a name is two words of the lexicon at most seven apart
    if not any(b - a <= 7 for a, b in zip(at, at[1:])):
        return
    toks = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(t)]

    def clear(a: int, b: int) -> bool:
        """No handle, path or identifier around."""
        before, after = t[a - 1:a], t[b:b + 1]
        return before not in _WORDISH and after not in _WORDISH and not (before in (".", "-") and a > 1 and t[a - 2].isalnum()) and not (
            after in (".", "-", "+") and b + 1 < len(t) and t[b + 1].isalnum())

    def gap(i: int, j: int) -> str:
        return t[toks[i][1]:toks[j][0]]

    i, n = 0, len(toks)
    while i < n:
        k = kinds[i]
        if not k:
            i += 1
            continue
        hit = None
        j = i + 1
        # first, further given names, initials, particles, last
        more = 0
        while j < n and j - i <= 7:
            between = gap(j - 1, j)
            w = toks[j][2]
            if between not in (" ", "  ", ". ", " '", ".") or (between in (". ", ".") and len(toks[j - 1][2]) > 2):
                break
            if between == "." and not (len(toks[j - 1][2]) == 1):
                break
            need = Names.FAMILY if k & Names.GIVEN else Names.GIVEN
            if kinds[j] & need or (k == 3 and kinds[j]):
                hit = j
                break
            if len(w) == 1 or w.lower() in _PARTICLES or (kinds[j] & Names.GIVEN and k & Names.GIVEN and more < 2):
                more += kinds[j] > 0
                j += 1
                continue
            break
        if hit is None and k & Names.FAMILY and i + 1 < n and re.fullmatch(r" ?, ?", gap(i, i + 1)) and kinds[i + 1] & Names.GIVEN:
            hit = i + 1
            # initials after the given name belong to it
            m = re.compile(r"(?: [^\W\d_]\.(?!\w))+").match(t, toks[hit][1])
            b = m.end() if m else toks[hit][1]
            if clear(toks[i][0], b):
                yield toks[i][0], b
                i = hit + 1
                continue
            hit = None
        if hit is not None:
            a, b = toks[i][0], toks[hit][1]
            # particles before a family name that comes first
            if clear(a, b):
                yield a, b
                i = hit + 1
                continue
        i += 1


def detect(source: str, names: Names | None) -> list[tuple[int, int, str]]:
    """(start, end, type) in the source, in order, not overlapping."""
    tape = Tape(source)
    t = tape.text
    taken: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in taken)

    blocked: list[tuple[int, int]] = []
    if "@" in t:
        for m in _EMAIL.finditer(t):
            a, b = m.span()
            local = m.group().split("@")[0]
            start = max(t.rfind(" ", 0, a), t.rfind("\n", 0, a), t.rfind("<", 0, a), t.rfind("(", 0, a)) + 1
            if local.lower() in _SERVICE_ACCOUNTS or _NO_MAILBOX.match(t[start:a] + "x") and "://" in t[start:a] or t[b:b + 1] == ":" and t[b + 1:b + 2].strip() and not t[b + 1:b + 2].isspace():
                blocked.append((a, b))
                continue
            if re.match(r"\d+x\.", m.group()[len(local) + 1:]) or not free(a, b):
                continue
            taken.append((a, b, "email"))
    if _DIGIT.search(t):
        for pattern in _ADDRESSES:
            for m in pattern.finditer(t):
                if free(*m.span()):
                    taken.append((*m.span(), "address"))
        for m in _AFTER_STREET.finditer(t):
            head = _BEFORE_STREET.search(t[t.rfind("\n", 0, m.start()) + 1:m.start()])
            if head and free(m.start() - len(head.group()), m.end()):
                taken.append((m.start() - len(head.group()), m.end(), "address"))
        long = _LONG_NUMBER.search(t) is not None
        if long:
            for m in _LABELLED_ID.finditer(t):
                if free(*m.span(1)):
                    taken.append((*m.span(1), "id_number"))
            for m in _IDS[0].finditer(t):
                if free(*m.span()):
                    taken.append((*m.span(), "id_number"))
        for pattern in _IDS[1:]:
            for m in pattern.finditer(t):
                if free(*m.span()):
                    taken.append((*m.span(), "id_number"))
        if long:
            for m in _GROUPED_ID.finditer(t):
                if free(*m.span()):
                    taken.append((*m.span(), "id_number"))
            for pattern in _PHONES:
                for m in pattern.finditer(t):
                    if free(*m.span()):
                        taken.append((*m.span(), "phone"))
        for a, b in tape.spelled:  # spoken digits come as one block, which only a label tells from other numbers
            if 7 <= b - a <= 15 and _PHONE_LABEL.search(t[t.rfind("\n", 0, a) + 1:a]) and free(a, b):
                taken.append((a, b, "phone"))
    if names is not None:
        for a, b in _names(t, names):
            if free(a, b):
                taken.append((a, b, "name"))
    return sorted((*tape.span(a, b), k) for a, b, k in taken)


def replace(source: str, names: Names | None, form: str = "[{}]") -> str:
    out, at = [], 0
    for a, b, k in detect(source, names):
        out += [source[at:a], form.format(k.upper())]
        at = b
    return "".join(out) + source[at:] if out else source


def _lexicon(names: DataFrame | None, max_names: int) -> tuple[list[str], list[str]]:
    if names is None:
        return [], []
    rows = names.select("name", "name_kind").where("name is not null").distinct().limit(max_names + 1).collect()
    if len(rows) > max_names:
        raise ValueError(f"the lexicon has more than max_names={max_names} entries")
    return [r.name for r in rows if r.name_kind == "given"], [r.name for r in rows if r.name_kind == "family"]


_JUDGES: dict = {}


def _judge(lex: tuple[list[str], list[str]]) -> Names:
    key = (len(lex[0]), len(lex[1]), hash((tuple(lex[0]), tuple(lex[1]))))
    if key not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[key] = Names(*lex)
    return _JUDGES[key]


def find_personal(docs: DataFrame, names: DataFrame | None, doc_col: str = "doc_id", text_col: str = "text",
                  max_names: int = 100_000) -> DataFrame:
    """(doc_id, pii_type, pii_value, start, end): every place, in characters of the source."""
    lex = _lexicon(names, max_names)
    kind = docs.schema[doc_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(lex)
        for batch in batches:
            rows = [(d, k, t[a:b], a, b) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t
                    for a, b, k in detect(t, judge)]
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], batch.column(0).type), pa.array(c[1]), pa.array(c[2]), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())],
                    names=["doc", "pii_type", "pii_value", "start", "end"])

    rows = parallel(docs.select(F.col(doc_col).alias("doc"), F.col(text_col).cast("string").alias("text")))
    out = rows.mapInArrow(run, f"doc {kind}, pii_type string, pii_value string, start int, end int")
    return out.withColumnRenamed("doc", doc_col)


def replace_personal(docs: DataFrame, names: DataFrame | None, doc_col: str = "doc_id", text_col: str = "text",
                     max_names: int = 100_000) -> DataFrame:
    """(doc_id, text): one row per input row, with placeholders like [EMAIL]; null stays null."""
    lex = _lexicon(names, max_names)
    kind = docs.schema[doc_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(lex)
        for batch in batches:
            texts = [t if not t else replace(t, judge) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])

    rows = parallel(docs.select(F.col(doc_col).alias("doc"), F.col(text_col).cast("string").alias("text")))
    return rows.mapInArrow(run, f"doc {kind}, text string").withColumnRenamed("doc", doc_col)
