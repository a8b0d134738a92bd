"""Personal data: every detected entity gets a keyed surrogate of its own type.

Detection gives spans of emails, account numbers (IBAN), phone numbers, IP addresses of both versions, payment card
numbers, social security numbers and names of persons.  A name is told by a title ("Dr. Smith"), by words that announce
one ("my name is ...") or by a given name of GIVEN that capitalised words follow.  Parts of a name that stand alone in
the same text belong to it ("Smith", "Mr Smith" and "John" after "John Smith": the nearest such name before, else the
first after), unless the text has the same word in small letters too, as it may be a common one.

Equal entities, however written, share one surrogate (coreference; a part of a name gets the same part of its
surrogate), and different ones never do (distinctness): surrogates
of all distinct entities are compared, and while two agree, or one equals an entity of the corpus, all but the first
are drawn anew.  A surrogate keeps the format: case, punctuation, number of digits, the country code, the validity
of check digits, and for names the script, the number of parts and the gender that title or given name tell (of others
none is kept).  Where all surrogates of a format are
taken, formats give way: from attempt WIDER on hosts, addresses and names come from larger spaces, from WIDEST on numbers
lose their country code and then grow by digits, and at attempt LAST, which only a format without any free member (all
addresses of a version, say) comes to, a surrogate is a name of its kind made of a keyed hash.  So every entity gets one.

Not detected: names in capitals only, names without title, announcement or listed given name, addresses of the form
::ffff:1.2.3.4 and dates of birth.

Defined cases: null text is empty; equal rows give equal results; a null id is scanned as any other; an empty table
gives no rows; other columns are ignored; spans never overlap (the earlier kind in KINDS wins); ties (two entities that draw
one surrogate) go to the lesser entity; texts of any length are scanned whole, in slices of the batch, and their entities
are rows of their own until they meet again at their text.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.repeats import mark_of
from sievework.llm.shared import split_by, staged, text_slices

KINDS = ["email", "iban", "card", "ssn", "phone", "ip", "ipv6", "name"]
#: Titles that tell the gender, and those that don't.
MALE, FEMALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir"), ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Lady")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor")
#: Common given names that are no common words.
GIVEN_MALE = """Aaron Adam Ahmed Alan Albert Alejandro Alexander Ali Andreas Andrew Anthony Antonio Arthur Benjamin Brian Bruno
Carlos Charles Christian Christopher Daniel David Dennis Diego Dmitri Douglas Edward Emil Eric Ethan Felix Fernando Francesco
François Fritz George Giovanni Gregory Hans Harold Hassan Heinrich Henry Hiroshi Hugo Ian Ibrahim Ivan Jacob James Jason Javier
Jeffrey Jeremy Johann John Jonathan José Joseph Joshua Juan Jürgen Karl Keith Kenneth Kevin Klaus Larry Lars Leonardo Liam Louis
Luca Luis Marco Mario Matthew Michael Miguel Mohammed Nicholas Noah Oliver Omar Oscar Pablo Patrick Paul Pedro Peter Philip Pierre
Rajesh Raymond Richard Robert Roger Ronald Samuel Scott Sebastian Stefan Stephen Steven Thomas Timothy Walter Wilhelm William""".split()
GIVEN_FEMALE = """Aisha Alice Alicia Amanda Amelia Amy Ana Andrea Angela Anna Anne Barbara Beatrice Brenda Camille Carla Carmen
Carol Caroline Catherine Charlotte Chiara Christina Claire Claudia Cynthia Deborah Diana Donna Dorothy Elena Elizabeth Emily Emma
Eva Fatima Fiona Francesca Gabriela Greta Hannah Heather Heidi Helen Ingrid Irina Isabel Jane Janet Jennifer Jessica Julia Karen
Katherine Laura Leila Linda Lisa Lucia Margaret Maria Marie Martha Mary Megan Melissa Michelle Monica Nancy Natalia Natasha
Nicole Olga Olivia Pamela Patricia Paula Priya Rachel Rebecca Ruth Samantha Sandra Sarah Sharon Sofia Sophie Susan Svetlana
Teresa Ursula Valentina Vanessa Veronica Victoria Virginia Wendy Yuki""".split()
GIVEN = dict.fromkeys(GIVEN_MALE, "m") | dict.fromkeys(GIVEN_FEMALE, "f")
#: Words that after a given name make a place or a body of it, not a person.
PLACES = set("Academy Airport Avenue Award Bay Boulevard Bridge Building Cathedral Church City College County Court Day Drive Foundation Hall Hospital House Inc Island Institute Lake Lane Library Ltd Museum Park Prize Road School Square Street Theorem Tower University Valley".split())
#: Lengths of account numbers by country.
IBAN = """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22
GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18
NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20"""
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in IBAN.split()}
WORD = r"\p{Lu}\p{Ll}*+(?:['’-]?\p{Lu}\p{Ll}++)*+(?<=\p{L}{2})(?!\w)"
TITLED = r"(?<!\w)(" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.? (" + WORD + r"(?: \p{Lu}\.)?(?: " + WORD + r"){0,2})"
ANNOUNCED = r"(?<!\w)(?:[Mm]y name is|[Ss]igned by|[Cc]ontact person:|[Ff]ull name:) (" + WORD + r"(?: \p{Lu}\.)?(?: " + WORD + r"){1,2})"
CAPITALS = r"(?<!\w)" + WORD + r"(?:(?: \p{Lu}\.)?+ " + WORD + r")+"
HEX = r"[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_.+-]*[A-Za-z0-9_]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?=(?: ?[A-Z0-9]){11})",
    "card": r"(?<![\w.+-])\d{4}(?:([ -]?)\d{4}\1\d{4}\1\d{4}|[ -]?\d{6}[ -]?\d{5})(?![\w-])",
    "ssn": r"(?<![\w.+-])(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ipv6": rf"(?<![\w:.])(?:(?:{HEX}:){{7}}{HEX}|{HEX}(?::{HEX}){{0,6}}::(?:{HEX}(?::{HEX}){{0,6}})?)(?![\w:])",
}
#: The country codes of two digits; 1 and 7 have one digit, all others three.
COUNTRY_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
TITLES = re.compile("|".join(t + r"\.? " for t in MALE + FEMALE + NEUTRAL))
#: What a text must have for any of these patterns but names to match, and for some of them.
QUICK = re.compile(r"@|\d{4}|\d[. )-]+\d|::|:[0-9A-Fa-f]+:")
NEEDS = {"email": "@", "ipv6": ":", "ssn": "-"}
#: From this attempt on, surrogates come from a larger space than that which shows best that they are invented.
WIDER = 4
#: The attempts at which formats give way further; those between WIDER + 4 and WIDEST are left out.
WIDEST, LAST = 20, 60


def _compiled() -> dict[str, object]:
    import regex

    return {k: regex.compile(p) for k, p in {**PATTERNS, "titled": TITLED, "announced": ANNOUNCED, "capitals": CAPITALS, "word": r"(?<!\w)" + WORD, "small": r"(?<!\w)\p{Ll}++(?!\w)"}.items()}


class _Spans:
    """Spans that don't overlap: the first to be added wins."""

    def __init__(self) -> None:
        self.all: list[tuple[int, int, str, str]] = []

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.all, (end,))
        return k == 0 or self.all[k - 1][1] <= start

    def add(self, start: int, end: int, kind: str, entity: str) -> None:
        if self.free(start, end):
            insort(self.all, (start, end, kind, entity))


def _fitting(kind: str, text: str, start: int, end: int) -> int | None:
    """Where a candidate ends, if its check digits or form hold."""
    if kind == "iban":
        m = re.compile(r"[A-Z0-9](?: ?[A-Z0-9]){%d}(?!\w)" % max(0, IBAN_LENGTH.get(text[start : start + 2], 0) - 1)).match(text, start)
        return m.end() if m and m.end() > end and mod97(normal(kind, m[0])) == 1 else None
    if kind == "ipv6":
        value = text[start:end]
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return None
        return end if value.count(":") > 2 or len(value.split(":")[0]) == 4 and any(c.isdigit() for c in value) else None
    return end


def _names(text: str, patterns: dict[str, object], spans: _Spans) -> None:
    """Names and their parts.  One pass over capitalised words for each of: titles, announcements, given names, parts."""
    found: list[tuple[int, int, str]] = []
    for m in patterns["titled"].finditer(text) if TITLES.search(text) else ():
        found.append((*m.span(2), "m" if m[1] in MALE else "f" if m[1] in FEMALE else GIVEN.get(m[2].split(" ")[0], "n")))
    for m in patterns["announced"].finditer(text):
        found.append((*m.span(1), GIVEN.get(m[1].split(" ")[0], "n")))
    for m in patterns["capitals"].finditer(text):
        words = m[0].split(" ")
        first = next((k for k, w in enumerate(words[:-1]) if w in GIVEN), None)
        if first is not None:
            parts = words[first : first + (4 if words[first + 1].endswith(".") else 3)]
            if not PLACES & set(parts):
                start = m.start() + sum(len(w) + 1 for w in words[:first])
                found.append((start, start + len(" ".join(parts)), GIVEN[words[first]]))
    taken = _Spans()
    for start, end, sex in found:
        if spans.free(start, end):
            taken.add(start, end, sex, text[start:end].casefold())
    sexes = {name: sex for _, _, sex, name in reversed(taken.all) if sex != "n"}
    # full names by each of their outer parts, then by gender and by whether the part is the last: places and names in order
    full: dict[str, dict[tuple[str, bool], tuple[list[int], list[str]]]] = {}
    for start, _, sex, name in taken.all:
        parts = name.split(" ")
        if len(parts) > 1:
            for part in {parts[0], parts[-1]}:
                starts, names = full.setdefault(part, {}).setdefault((sexes.get(name, sex), parts[-1] == part), ([], []))
                starts.append(start)
                names.append(name)

    def whole(part: str, at: int, sex: str, family: bool) -> tuple[str, str] | None:
        """The name that a part at a place belongs to: of all that fit the nearest before, else the first after."""
        before, after = [], []
        for (other, last), (starts, names) in full.get(part, {}).items():
            if (sex in ("n", other) or other == "n") and (last or not family):
                k = bisect_left(starts, at)
                if k:
                    before.append((starts[k - 1], other, names[k - 1]))
                if k < len(starts):
                    after.append((starts[k], other, names[k]))
        best = max(before) if before else min(after, default=None)
        return best and best[1:]

    for start, end, sex, name in taken.all:
        sex, name = (" " not in name and whole(name, start, sex, True)) or (sexes.get(name, sex), name)
        spans.add(start, end, "name", f"{sex}:{name}")
    if full:
        common = {m[0] for m in patterns["small"].finditer(text)}
        for m in patterns["word"].finditer(text):
            part = m[0].casefold()
            place = text[m.end() + 1 : m.end() + 20].split(" ")[0].rstrip(".,;") in PLACES
            if part in full and part not in common and not place and (of := whole(part, m.start(), "n", False)):
                spans.add(*m.span(), "name", f"{of[0]}:{of[1]}")


def entities(text: str, patterns: dict[str, object]) -> list[tuple[int, int, str, str]]:
    """Spans (start, end, kind, entity) in code points, in order."""
    spans = _Spans()
    if QUICK.search(text):
        for kind in KINDS[:-1]:
            if kind in NEEDS and NEEDS[kind] not in text:
                continue
            for m in patterns[kind].finditer(text):
                end = _fitting(kind, text, *m.span())
                if end is not None:
                    spans.add(m.start(), end, kind, normal(kind, text[m.start() : end]))
    _names(text, patterns, spans)
    return spans.all


def detect(text: str, patterns: dict[str, object]) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, in order."""
    return [s[:3] for s in entities(text, patterns)]


def normal(kind: str, value: str) -> str:
    """What the ways of writing one entity have in common; names are made by `entities`, which knows their context."""
    if kind in ("card", "phone", "ssn"):
        return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "").upper()
    return str(ipaddress.IPv6Address(value)) if kind == "ipv6" else value.lower()


def mod97(account: str) -> int:
    """The remainder that an account number's check digits settle: 1 for a right one."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


class Draw:
    """Keyed numbers: a stream of bytes from the key, the entity and the attempt."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.key, self.seed, self.block, self.bytes = key, "\0".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 8:
            self.bytes += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x, self.bytes = int.from_bytes(self.bytes[:8], "big"), self.bytes[8:]
        return x % n


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _letters(draw: Draw, shape: str) -> str:
    """Letters for letters and digits for digits; the rest stays."""
    return "".join(chr(97 + draw.below(26)) if c.isalpha() else str(draw.below(10)) if c.isdigit() else c for c in shape)


def country(number: str) -> int:
    """How many characters of a number that starts with + are the country code and its sign."""
    return 2 if number[1:2] in ("1", "7") else 3 if number[1:3] in COUNTRY_2 else 4


def surrogate(kind: str, entity: str, key: bytes, attempt: int) -> str:
    """The normal form of an entity's surrogate."""
    draw = Draw(key, kind, entity, attempt)
    if attempt >= LAST:
        return kind + "-" + hmac.new(key, f"{kind}\0{entity}\0{attempt}".encode(), hashlib.sha256).hexdigest()[:32]
    if kind == "email":
        local, _, host = entity.rpartition("@")
        labels = host.split(".")
        local += "x" * max(0, attempt - WIDER)
        # hosts stay below the names that are reserved for examples
        return ".".join([_letters(draw, local) + "@" + _letters(draw, labels[0]), *(_letters(draw, x) for x in labels[1:-2]), "example", ("com", "net", "org")[draw.below(3)]])
    if kind == "ip":
        # private addresses, then reserved ones
        first = 10 if attempt < WIDER else 240 + draw.below(15)
        return f"{first}.{draw.below(256)}.{draw.below(256)}.{draw.below(254) + 1}"
    if kind == "ipv6":
        # addresses reserved for documents, then private ones
        high = 0x20010DB8 if attempt < WIDER else (0xFD << 24) + draw.below(1 << 24)
        return str(ipaddress.IPv6Address((high << 96) + (draw.below(1 << 32) << 64) + (draw.below(1 << 32) << 32) + draw.below(1 << 32)))
    if kind == "ssn":
        # areas that are never given out, then all
        area = 900 + draw.below(100) if attempt < WIDER else 100 + draw.below(566)
        return f"{area}{1 + draw.below(99):02}{1 + draw.below(9999):04}"
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in entity[4:])
        return entity[:2] + f"{98 - mod97(entity[:2] + '00' + body):02}" + body
    if kind == "card":
        body = entity[0] + "".join(str(draw.below(10)) for _ in entity[1:-1])
        fitting = [k for k in "0123456789" if luhn(body + k) == luhn(entity)]
        return body + fitting[draw.below(len(fitting))]
    if kind == "phone":
        kept = country(entity) if entity.startswith("+") and attempt < WIDEST else int(entity.startswith("+"))
        more = max(0, attempt - WIDEST) // 2
        return entity[:kept] + "".join(str(2 + draw.below(8)) if k == 0 else str(draw.below(10)) for k in range(len(entity) - kept + more))
    sex, _, name = entity.partition(":")
    more = max(0, attempt - WIDER + 1)
    return sex + ":" + " ".join(chr(97 + draw.below(26)) + "." if part.endswith(".") else "-".join(_name(draw, sex, x or "x", more) for x in part.split("-")) for part in name.split(" "))


def _name(draw: Draw, sex: str, like: str, more: int = 0) -> str:
    """An invented name of the script of `like`, perhaps with more syllables; it ends as names of that gender often do."""
    if "Ѐ" <= like[0] <= "ӿ":
        heads, vowels, ends = "бвгдзклмнрст", "аеио", {"m": ["н", "р", "й"], "f": ["а", "я"]}
    elif "Α" <= like[0] <= "ώ":
        heads, vowels, ends = "βγδκλμνπρστ", "αεηιο", {"m": ["ος", "ης"], "f": ["α", "η"]}
    else:
        heads, vowels, ends = "bdfgklmnprstv", "aeio", {"m": ["n", "r", "s", "k"], "f": ["a", "ia", "ina"]}
    middle = "".join(heads[draw.below(len(heads))] + vowels[draw.below(len(vowels))] for _ in range(max(2, min(4, len(like) // 2)) + more))
    ends = ends.get(sex, ends["m"] + ends["f"])
    end = ends[draw.below(len(ends))]
    return middle[:-1] + end if end[0] in vowels else middle + end


def render(kind: str, original: str, new: str, entity: str = "") -> str:
    """The surrogate in the way the original is written; digits that it has besides follow at the end.

    Of an entity's name, the parts that the original has.
    """
    if new.startswith(kind + "-"):
        return new
    if kind in ("card", "phone", "ssn"):
        digits = iter(new.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in original) + "".join(digits)
    if kind == "iban":
        letters = iter(new)
        return "".join(c if c == " " else next(letters) for c in original)
    if kind == "ipv6":
        groups = original.split(":")
        full = ipaddress.IPv6Address(new).exploded
        new = new if "" in groups else full if all(len(g) == 4 for g in groups) else ":".join(f"{int(g, 16):x}" for g in full.split(":"))
    if kind == "name":
        parts, old = new.partition(":")[2].split(" "), entity.partition(":")[2].split(" ")
        said = original.casefold()
        if " " not in said and len(old) > 1:
            parts = [parts[-1] if said == old[-1] else parts[0]]
        return " ".join("-".join(x.capitalize() for x in w.split("-")) for w in parts)
    return new.upper() if original.isupper() else new


def find_entities(docs: DataFrame) -> DataFrame:
    """A row for each entity in a text: doc_id, mark (of the text), start, end, kind, value, entity."""
    kinds = [("doc_id", pa.int64()), ("mark", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("entity", pa.string())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _compiled()
        for batch in text_slices(batches):
            rows = []
            for doc_id, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
                for start, end, kind, entity in entities(text or "", patterns):
                    rows.append((doc_id, mark, start, end, kind, text[start:end], entity))
            yield pa.RecordBatch.from_pylist([dict(zip((n for n, _ in kinds), r, strict=True)) for r in rows], schema=pa.schema(kinds))

    return docs.mapInArrow(task, "doc_id long, mark binary, start int, end int, kind string, value string, entity string")


def assign_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, surrogate: no two entities of a kind share one, and none is an entity of the corpus."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "attempt")), strict=True)
            yield b.append_column("surrogate", pa.array([surrogate(k, e, key, a) for k, e, a in rows], type=pa.string()))

    distinct = staged(found.select("kind", "entity").distinct(), "entities")
    taken = distinct.select("kind", F.col("entity").alias("surrogate"), F.lit("").alias("first"))
    new, done = distinct.withColumn("attempt", F.lit(0)), None
    while True:
        drawn = staged(new.mapInArrow(task, "kind string, entity string, attempt int, surrogate string"), "surrogates")
        owner = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("first")).unionByName(taken).groupBy("kind", "surrogate").agg(F.min("first").alias("first"))
        judged = staged(drawn.join(owner, ["kind", "surrogate"]).withColumn("won", F.col("first") == F.col("entity")), "judged")
        won = judged.filter("won").select("kind", "entity", "surrogate")
        done = won if done is None else done.unionByName(won)
        new = judged.filter("not won").select("kind", "entity", F.when(F.col("attempt") == WIDER + 4, WIDEST).otherwise(F.col("attempt") + 1).alias("attempt"))
        if new.isEmpty():
            return done
        taken = taken.unionByName(won.select("kind", "surrogate", F.lit("").alias("first")))


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its text after replacement and a count for each kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("mark", mark_of("doc_id", "text"))
    found = staged(find_entities(own), "found")
    given = found.distinct().join(assign_surrogates(found, key), ["kind", "entity"])
    edits = staged(given.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "value", "entity", "surrogate"))).alias("edits")), "edits")
    touched, untouched = split_by(own, edits, "mark")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for old, edits in zip(b.column("text").to_pylist(), b.column("edits").to_pylist(), strict=True):
                out, at = [], 0
                for e in edits or ():
                    out += [old[at : e["start"]], render(e["kind"], e["value"], e["surrogate"], e["entity"])]
                    at = e["end"]
                texts.append("".join(out) + old[at:])
                for k in KINDS:
                    counts[k].append(sum(e["kind"] == k for e in edits or ()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, type=pa.string()), *(pa.array(counts[k], type=pa.int64()) for k in KINDS)], names=["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    with_edits = touched.join(edits, "mark", "left").select("doc_id", "text", "edits").mapInArrow(apply, f"doc_id long, text string, {counts}")
    return with_edits.unionByName(untouched.select("doc_id", "text", *(F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"), key=b"surrogates of one release")
