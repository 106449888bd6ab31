"""PII surrogates: detected entities get keyed replacements of the same type, format, script and gender.

1. Detection, one pass over the texts where they lie: emails, phone numbers, IPv4 addresses, card and other long
   numbers, US social security numbers, IBANs, secrets (long hex strings and API keys) and names of persons (after a
   title, or beginning with a known first name). Each mention has a canonical form: letter case, separators and, for
   phone numbers, the country code don't matter; a surname or first name alone stands for the person of that name whose
   full name is in the same text, where there is just one. So all mentions of an entity, in all texts, share one
   canonical form: coreference is kept.
2. Surrogates are made once for each distinct entity, from an HMAC of (type, canonical form, attempt) under the key:
   digits give digits, letters give letters of the same script; a Luhn-valid number stays Luhn-valid, an IBAN keeps
   valid check digits, a private address stays private; a person gets a first name of the same gender and script.
3. Collision checks: in each round, a surrogate that equals any original entity of its type, one given out before, or
   one that another entity of the same round also drew is refused, except to the smallest of those that drew it; the
   others draw again. So different entities keep different surrogates. What is compared is what a text shows: persons
   of any gender and script differ in the surname, and it is no word of an original name. First names are few, so a
   first name that stands alone may be shared, as among originals.
4. Replacement in the mention's own format and letter case. Texts meet their replacements by a hash of id and text.

Entities are handled as a distributed table; nothing is collected or broadcast. ``KEY`` is a parameter: the same key
gives the same surrogates wherever the set of entities is the same.

Null text stays null, without entities. Repeated rows are replaced alike. Overlapping matches: the one that begins
first, then the type listed first; names of persons come last. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadre.llm.common import stage

KEY = "surrogate-1"
MOST_ROUNDS = 40

#: First names by script and gender, endings of generated surnames, titles by gender.
FIRST_NAMES = {
    ("Latin", "f"): "Anna Maria Laura Julia Sofia Elena Clara Emma Marta Alice Sarah Emily Claire Camille Ingrid Petra Carmen Lucia Jane Mary".split(),
    ("Latin", "m"): "John James Peter Paul Thomas David Daniel Martin Carlos Pablo Diego Hans Karl Pierre Louis Antoine Marco Luca Robert Michael".split(),
    ("Cyrillic", "f"): "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("Cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Павел".split(),
    ("Greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Γεωργία".split(),
    ("Greek", "m"): "Γεώργιος Ιωάννης Δημήτριος Νικόλαος Παναγιώτης Κωνσταντίνος".split(),
}
SYLLABLES = {
    "Latin": "ba bel car dan der fel gar hol jen kel lan mar mol nor par ran sel tor val wen".split(),
    "Cyrillic": "ба вол гор дан жар кол лан мир нов пет рад сан тал хар шев".split(),
    "Greek": "βα γο δη κα λα μα νι πα ρα σα το φι χρ ψα".split(),
}
SURNAME_END = {("Latin", "f"): "son", ("Latin", "m"): "son", ("Cyrillic", "f"): "ова", ("Cyrillic", "m"): "ов", ("Greek", "f"): "ου", ("Greek", "m"): "ος"}
TITLES = {"mr": "m", "mrs": "f", "ms": "f", "miss": "f", "herr": "m", "frau": "f", "monsieur": "m", "madame": "f", "mme": "f",
          "señor": "m", "señora": "f", "sr": "m", "sra": "f", "don": "m", "doña": "f", "dr": "", "prof": "", "г-н": "m", "г-жа": "f",
          "κύριος": "m", "κυρία": "f"}
GENDER = {n.lower(): (s, g) for (s, g), names in FIRST_NAMES.items() for n in names}

_NAME = r"\p{Lu}\p{L}+"
_TITLE = "(?i:" + "|".join(regex.escape(t) for t in sorted(TITLES, key=len, reverse=True)) + ")"
_FIRST = "(?:" + "|".join(n for names in FIRST_NAMES.values() for n in names) + ")"
ENTITY = regex.compile("|".join((
    r"(?P<email>[\p{L}\p{N}_.+%-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+)",
    r"(?P<secret>(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,}|(?:sk|pk|ghp|xox[bp])[-_][\p{L}\p{N}_-]{16,}|AKIA[0-9A-Z]{16})(?![\p{L}\p{N}]))",
    r"(?P<iban>(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}]))",
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))",
    r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    r"(?P<phone>(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\d])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d))",
    r"(?P<number>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))",
)))
PERSON = regex.compile(rf"(?P<titled>(?<!\p{{L}}){_TITLE}\.? {_NAME}(?: {_NAME}){{0,2}})|(?P<named>(?<!\p{{L}}){_FIRST}(?: {_NAME}){{1,2}})")
#: Where an entity other than a person may be: it has a digit or "@", begins like an API key or is a long run of hex letters.
SPOT = re.compile(r"[@\d]+|sk[-_]|pk[-_]|ghp[-_]|xox[bp]|AKIA|[a-fA-F]{32,}")
AROUND = 48
WORDS = regex.compile(r"\p{L}+")
#: Words of which one must be in a text that names a person, in folded case; of a title with a hyphen its first word.
NAME_WORDS = {WORDS.search(n).group().casefold() for n in (*TITLES, *GENDER)}
#: The one character besides letters that equals a letter (iota) when case is ignored.
ODD_IOTA = "\u0345"


def may_name(text: str) -> bool:
    """Whether PERSON may match: a title or first name is a whole run of letters, whatever marks are around it."""
    return ODD_IOTA in text or not NAME_WORDS.isdisjoint(w.casefold() for w in set(WORDS.findall(text)))


def places(text: str):
    """Stretches of the text, from white space to white space, around every spot."""
    a = b = 0
    for m in SPOT.finditer(text):
        if m.start() - AROUND > b:
            if b > a:
                yield a, b
            a = max(0, m.start() - AROUND, b)
            while a > 0 and not text[a - 1].isspace():
                a -= 1
        b = min(len(text), m.end() + AROUND)
        while b < len(text) and not text[b].isspace():
            b += 1
    if b > a:
        yield a, b


def script_of(word: str) -> str:
    c = ord(word[0])
    return "Cyrillic" if 0x400 <= c < 0x530 else "Greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "Latin"


def digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(number: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


def iban_check(body: str) -> str:
    """Check digits for country and account, ``body`` without its own."""
    n = int("".join(str(int(c, 36)) for c in body[2:] + body[:2] + "00"))
    return f"{98 - n % 97:02d}"


def mentions(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, canonical form, part); a person's form is "script|gender|first|surname"."""
    if not text:
        return []
    found, people = [], []
    matches = [m for a, b in places(text) for m in ENTITY.finditer(text, a, b)]
    if may_name(text):
        ends = [m.span() for m in matches]
        matches += [m for m in PERSON.finditer(text) if not any(a < m.end() and m.start() < b for a, b in ends)]
        matches.sort(key=lambda m: m.start())
    for m in matches:
        kind, raw = m.lastgroup, m.group()
        a, b = m.span()
        if kind in ("titled", "named"):
            words = raw.split(" ")
            title = words.pop(0) if kind == "titled" else ""
            gender = TITLES.get(title.lower().rstrip("."), "")
            first = words[0] if len(words) > 1 else ""
            known = GENDER.get(first.lower())
            gender = gender or (known[1] if known else "")
            a += len(title) + 1 if title else 0
            people.append(len(found))
            found.append([a, b, "person", [script_of(words[-1]), gender, " ".join(words[:-1]).lower(), words[-1].lower()]])
            continue
        if kind == "email":
            canon = raw.lower()
        elif kind in ("phone", "number", "ssn"):
            canon = digits(raw)
            if kind == "phone" and len(canon) == 11 and canon[0] == "1":
                canon = canon[1:]
        elif kind == "iban":
            canon = raw.replace(" ", "")
        elif kind == "ip":
            canon = ".".join(str(int(p)) for p in raw.split("."))
        else:
            canon = raw.lower() if regex.fullmatch("[0-9a-fA-F]+", raw) else raw
        found.append([a, b, kind, canon])
    full = {tuple(found[i][3]) for i in people if found[i][3][2]}
    named = {}  # a name alone, and the one person whose full name has it
    for p in full:
        for part, form in ((p[3], "last"), (p[2], "first")):
            named.setdefault(part, set()).add((p, form))
    for i in people:
        p = found[i][3]
        fits = {x for x in named.get(p[3], ()) if x[1] == "last" and (not p[1] or x[0][1] in ("", p[1]))}
        if not p[2] and len(fits) == 1:
            found[i][3] = list(fits.pop()[0])
    out = [(a, b, k, "|".join(c) if k == "person" else c, "") for a, b, k, c in found]
    for name, who in named.items() if named else ():
        if len(who) == 1:
            (p, form), = who
            for m in regex.finditer(rf"(?<!\p{{L}})(?=\p{{Lu}})(?i:{regex.escape(name)})(?!\p{{L}})", text):
                if not any(a < m.end() and m.start() < b for a, b, *_ in out):
                    out.append((*m.span(), "person", "|".join(p), form))
    return sorted(out)


class Draw:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: str, kind: str, canon: str, attempt: int):
        self.seed = f"{kind}\x00{canon}\x00{attempt}".encode()
        self.key, self.pool, self.block = key.encode(), b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def like(self, c: str) -> str:
        """A character of the same class: digit, or letter of the same case and script."""
        if c.isdigit():
            return str(self.below(10))
        if not c.isalpha():
            return c
        low = "абвгдежзиклмнопрстуфхцчшэюя" if script_of(c) == "Cyrillic" else "αβγδεζηθικλμνξοπρστυφχψω" if script_of(c) == "Greek" else "abcdefghijklmnopqrstuvwxyz"
        new = low[self.below(len(low))]
        return new.upper() if c.isupper() else new


def surrogate(key: str, kind: str, canon: str, attempt: int) -> str:
    """A candidate in canonical form."""
    draw = Draw(key, kind, canon, attempt)
    if kind == "email":
        local, _, domain = canon.partition("@")
        host, _, top = domain.rpartition(".")
        return "".join(map(draw.like, local)) + "@" + "".join(map(draw.like, host)) + "." + top
    if kind == "ip":
        p = [int(x) for x in canon.split(".")]
        keep = 1 if p[0] in (10, 127) else 2 if (p[0], p[1]) == (192, 168) or p[0] == 172 and 16 <= p[1] < 32 else 0
        new = p[:keep] + [draw.below(254) + 1 for _ in p[keep:]]
        while not keep and (new[0] in (10, 127, 172, 192) or new[0] > 223):
            new[0] = draw.below(223) + 1
        return ".".join(map(str, new))
    if kind in ("phone", "number", "ssn"):
        keep = max(0, len(canon) - 10) if kind == "phone" else 1 if kind == "number" else 0
        new = canon[:keep] + "".join(str(draw.below(10)) for _ in canon[keep:])
        if kind == "number" and luhn(canon):
            new = next(new[:-1] + d for d in "0123456789" if luhn(new[:-1] + d))
        return new
    if kind == "iban":
        body = canon[:2] + "".join(map(draw.like, canon[4:]))
        return body[:2] + iban_check(body) + body[2:]
    if kind == "secret":
        if regex.fullmatch("[0-9a-f]+", canon):
            return "".join("0123456789abcdef"[draw.below(16)] for _ in canon)
        head = regex.match(r"(?:sk|pk|ghp|xox[bp])[-_]|AKIA", canon)
        start = head.end() if head else 0
        return canon[:start] + "".join(map(draw.like, canon[start:]))
    script, gender, first, last = canon.split("|")
    gender_drawn = gender or "fm"[draw.below(2)]
    names = FIRST_NAMES[script, gender_drawn]
    given = " ".join(names[draw.below(len(names))] for _ in first.split()).lower()
    surname = "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(3 + attempt)) + SURNAME_END[script, gender_drawn]
    return "|".join((script, gender, given, surname))


def rendered(mention: str, kind: str, new: str, part: str = "") -> str:
    """The surrogate in the format and letter case of a mention."""
    if kind == "person":
        _, _, first, last = new.split("|")
        words = mention.split(" ")
        out = first.split() if part == "first" else (first.split() + [last])[-len(words):]
        return " ".join(n.upper() if len(w) > 1 and w.isupper() else n.title() for w, n in zip(words, out))
    if kind in ("phone", "number", "ssn"):
        left = list(new)
        chars = [left.pop() if c.isdigit() and left else c for c in reversed(mention)]
        return "".join(reversed(chars))
    if kind == "iban":
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in mention)
    if kind == "ip":
        return new
    if kind == "email" and mention != mention.lower():
        return new.upper() if mention == mention.upper() else "".join(n.upper() if c.isupper() else n for n, c in zip(new, mention))
    if kind == "secret" and mention.lower() != mention and regex.fullmatch("[0-9A-F]+", mention):
        return new.upper()
    return new


def detect(docs: DataFrame) -> DataFrame:
    """(key, start, end, kind, canon, part) of every mention in ``docs`` (key, text)."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("key", "start", "end", "kind", "canon", "part")}
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for row in mentions(text):
                    for name, v in zip(out, (key, *row)):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.string()), pa.array(out["start"], pa.int32()), pa.array(out["end"], pa.int32()),
                                              pa.array(out["kind"], pa.string()), pa.array(out["canon"], pa.string()), pa.array(out["part"], pa.string())], names=list(out))

    return docs.mapInArrow(run, "key string, start int, end int, kind string, canon string, part string")


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, new): a surrogate for each distinct entity, different for different entities."""

    def draw(attempt):
        def run(batches):
            for batch in batches:
                kinds, canons = batch.column("kind").to_pylist(), batch.column("canon").to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("canon"), pa.array([surrogate(key, k, c, attempt) for k, c in zip(kinds, canons)], pa.string())],
                                                 names=["kind", "canon", "new"])
        return run

    def shown(form):
        """What tells entities apart in a text: of a person the surname."""
        return F.when(F.col("kind") == "person", F.element_at(F.split(form, r"\|"), -1)).otherwise(F.col(form)).alias("shown")

    entities = stage(entities.select("kind", "canon").distinct(), "entities")
    words = F.split(F.concat_ws(" ", F.slice(F.split("canon", r"\|"), 3, 2)), " ")
    taken = entities.select("kind", F.explode(F.when(F.col("kind") == "person", words).otherwise(F.array("canon"))).alias("shown")).distinct()
    left, given = entities, None
    for attempt in range(MOST_ROUNDS):
        drawn = left.mapInArrow(draw(attempt), "kind string, canon string, new string")
        first = drawn.groupBy("kind", shown("new")).agg(F.min(F.struct("canon", "new")).alias("m")).join(taken, ["kind", "shown"], "left_anti")
        good = stage(first.select("kind", "m.canon", "m.new", "shown"), "surrogates")
        given = good.drop("shown") if given is None else given.unionByName(good.drop("shown"))
        left = stage(left.join(good, ["kind", "canon"], "left_anti"), "left")
        if left.isEmpty():
            return given
        taken = taken.unionByName(good.select("kind", "shown"))
    raise ValueError(f"no free surrogates of the same format after {MOST_ROUNDS} draws")


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """Per row: doc_id, the text with surrogates, and ``entities`` (type, start and end in the new text)."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    src = src.withColumn("key", F.sha2(F.to_json(F.struct("doc_id", F.xxhash64("text").alias("h"))), 256))
    found = stage(detect(src.select("key", "text")).distinct(), "mentions")
    given = stage(assign(found, key), "given")
    spans = found.join(given, ["kind", "canon"]).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind", "new", "part"))).alias("spans"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, where = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                out, at, size, marks = [], 0, 0, []
                for s in spans or ():
                    new = rendered(text[s["start"]:s["end"]], s["kind"], s["new"], s["part"])
                    out += [text[at:s["start"]], new]
                    size += s["start"] - at + len(new)
                    marks.append({"kind": s["kind"], "start": size - len(new), "end": size})
                    at = s["end"]
                texts.append("".join(out) + text[at:] if out else text)
                where.append(marks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()),
                 pa.array(where, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "text", "entities"])

    both = src.join(spans, "key", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, f"doc_id {id_type}, text string, entities array<struct<kind string, start int, end int>>")
