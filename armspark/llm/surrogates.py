"""PII surrogates: detected entities get keyed replacements of the same type, script, gender and format.

Detected are e-mail addresses, IPv4 addresses, card and account numbers, telephone numbers, and personal names
after a title or made of a listed given name and a capitalised word. Names are mapped by their parts, so that "Mr. Smith" and "John Smith"
stay one family, and later bare mentions of a found family name in the same document follow.

One entity has one surrogate in the whole corpus (coreference), and two entities never share one (distinctness): surrogates
are drawn by a keyed hash, then checked against each other and against all real entities; those that collide are drawn
again until none does. The table of distinct entities and the spans are shuffled, texts only where a document holds an
entity; every other document passes through one map.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import row_key

KEY = "armspark"

# Titles by the gender they tell, and frequent given names.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Signor Don Г-н Господин",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Signora Doña Г-жа Госпожа",
    "x": "Dr Prof Professor",
}
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Hans Peter Klaus Jürgen Pierre Jean Michel Philippe "
    "José Carlos Miguel Antonio Иван Алексей Дмитрий Сергей",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Ursula Monika Sabine Renate Marie Nathalie Isabelle Sylvie "
    "María Carmen Ana Isabel Анна Мария Ольга Наталья",
}
_TITLE_GENDER = {t: g for g, names in TITLES.items() for t in names.split()}
_GIVEN_GENDER = {n: g for g, names in GIVEN.items() for n in names.split()}
# Syllables of surrogate names by script; endings by gender. Made up, so that no list of real people is needed.
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke la le lo ma me mi mo na ne no pa pe ra re ri ro sa se ta te to va ve za".split(),
    "cyrillic": "ба бе бо ва ве да де до за ка ке ко ла ле ло ма ме ми мо на не но па пе ра ре ри ро са се та те то ха".split(),
    "greek": "βα γα δα δε ζα θα κα κε λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα τε το φα χα".split(),
}
_ENDINGS = {
    "latin": {"m": ("nus", "rtan", "ldo"), "f": ("lina", "nelle", "ria"), "x": ("len", "rin", "mel"), "family": ("ssen", "rton", "lmer", "vic")},
    "cyrillic": {"m": ("слав", "мир"), "f": ("лина", "рия"), "x": ("лен", "рин"), "family": ("нов", "ренко", "лин")},
    "greek": {"m": ("νος", "ρης"), "f": ("λίνα", "ρία"), "x": ("λεν", "ριν"), "family": ("όπουλος", "ίδης")},
}

_EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@[^\W_](?:[\w-]*\w)?(?:\.[^\W_](?:[\w-]*\w)?)+")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)", re.A)
_CARD = re.compile(r"(?<![\w.+-])(?:\d{4}[ -]){3}\d{1,7}(?![\w-])|(?<![\w.+-])\d{13,19}(?!\w)", re.A)
_PHONE = re.compile(r"(?<![\w.+-])\+?(?:\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}){1,4}(?!\w|[.-]\d)|(?<![\w.+-])\+\d{9,15}(?!\w)", re.A)
_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яё][\w’'-]*"
_NAMED = re.compile(
    rf"(?<!\w)(?P<title>{'|'.join(sorted(map(re.escape, _TITLE_GENDER), key=len, reverse=True))})\.?[  ]+(?P<name>{_CAPITAL}(?:[  ]{_CAPITAL}){{0,2}})"
    rf"|(?<!\w)(?P<full>(?:{'|'.join(sorted(map(re.escape, _GIVEN_GENDER), key=len, reverse=True))})[  ]{_CAPITAL})"
)
_CUES = tuple(_TITLE_GENDER) + tuple(_GIVEN_GENDER)


# From this attempt on, numbers and IPv4 addresses take a wider form.
WIDER = 4


def luhn_ok(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def script_of(name: str) -> str:
    told = unicodedata.name(next((c for c in name if c.isalpha()), "a"), "LATIN")
    return next((s for s in ("cyrillic", "greek") if told.startswith(s.upper())), "latin")


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, norm) of every entity, without overlaps, in text order."""
    found: list[tuple[int, int, str, str]] = []  # sorted, so that a new span looks at its two neighbours alone

    def add(s, e, kind, norm):
        at = bisect_left(found, (s,))
        if (at == len(found) or e <= found[at][0]) and (at == 0 or found[at - 1][1] <= s):
            found.insert(at, (s, e, kind, norm))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email", m[0].lower())
    if any(d in text for d in "0123456789"):
        for m in _IP.finditer(text):
            add(m.start(), m.end(), "ip", m[0])
        for m in _CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 13 <= len(digits) <= 19:
                add(m.start(), m.end(), "card" if luhn_ok(digits) else "account", digits)
        for m in _PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 9 <= len(digits) <= 15 and ("+" in m[0] or "(" in m[0] or len(digits) >= 10):
                add(m.start(), m.end(), "phone", digits)
    if any(cue in text for cue in _CUES):
        families = set()
        for m in _NAMED.finditer(text):
            at = m.start("name") if m["name"] else m.start("full")
            parts = list(re.finditer(r"\S+", m["name"] or m["full"]))
            gender = _TITLE_GENDER.get(m["title"] or "", "x")
            for i, part in enumerate(parts):
                word = part[0].rstrip(".,;:!?'’-")
                if i == len(parts) - 1 and len(parts) + bool(m["title"]) > 1:
                    kind = f"family:{script_of(word)}"
                    families.add(word)
                else:
                    kind = f"given:{_GIVEN_GENDER.get(word, gender)}:{script_of(word)}"
                if word:
                    add(at + part.start(), at + part.start() + len(word), kind, word.lower())
        for word in families:
            for m in re.finditer(rf"(?<!\w){re.escape(word)}(?!\w)", text):
                add(m.start(), m.end(), f"family:{script_of(word)}", word.lower())
    return found


def _stream(key: str, *parts: object):
    """Endless whole numbers below 2**16 from a keyed hash of the parts."""
    n = 0
    while True:
        block = hmac.new(key.encode(), "\x1f".join(map(str, (*parts, n))).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        yield from (int.from_bytes(block[i : i + 2], "big") for i in range(0, 32, 2))
        n += 1


def surrogate(kind: str, norm: str, attempt: int, key: str) -> str:
    """A normalised replacement of the same kind; another one for each attempt.

    The space of values grows with the attempt, so that draws end whatever the number of entities: addresses and names get more letters, numbers
    more digits at their end, and IPv4 addresses become addresses of the IPv6 block reserved for documentation.
    """
    draw = _stream(key, kind, norm, attempt)

    def letter(c: str) -> str:
        if c.isdigit():
            return str(next(draw) % 10)
        if not c.isalpha():
            return c
        base, size = {"latin": ("a", 26), "cyrillic": ("а", 32), "greek": ("α", 17)}[script_of(c)]
        return chr(ord(base) + next(draw) % size)

    if kind == "email":
        local, _, domain = norm.rpartition("@")
        labels = domain.split(".")[:-1]
        # ".example" is reserved: no address under it can be real.
        return "".join(map(letter, local + "x" * (attempt // 2))) + "@" + ".".join("".join(map(letter, x)) for x in labels) + ".example"
    if kind == "ip":
        if attempt >= WIDER:
            return "2001:db8:" + ":".join(f"{next(draw):x}" for _ in range(6))
        # 240.0.0.0/4 is reserved: no host has such an address.
        return ".".join([str(240 + next(draw) % 15), *(str(next(draw) % 256) for _ in range(3))])
    if kind in ("card", "account", "phone"):
        keep = max(0, len(norm) - 10) if kind == "phone" else 0
        digits = norm[:keep] + str(1 + next(draw) % 9) + "".join(str(next(draw) % 10) for _ in norm[keep + 1 :] + "x" * (attempt // WIDER))
        if kind == "card":
            digits = next(d for d in (digits[:-1] + str(c) for c in range(10)) if luhn_ok(d))
        return digits
    role, *_, script = kind.split(":")
    gender = kind.split(":")[1] if role == "given" else "family"
    syllables, endings = _SYLLABLES[script], _ENDINGS[script][gender]
    size = 2 + next(draw) % 2 + attempt // 2
    return "".join(syllables[next(draw) % len(syllables)] for _ in range(size)) + endings[next(draw) % len(endings)]


def rendered(kind: str, original: str, replacement: str) -> str:
    """The replacement in the written form of the original: punctuation of numbers, case of names."""
    if kind in ("card", "account", "phone"):
        digits = iter(replacement)
        written = "".join(next(digits) if c.isascii() and c.isdigit() else c for c in original)
        return written + "".join(digits)
    if kind == "email":
        return replacement.upper() if original.isupper() else replacement
    if kind == "ip":
        return replacement
    return replacement.upper() if original.isupper() and len(original) > 1 else replacement.capitalize() if original[:1].isupper() else replacement


def assign(entities: DataFrame, key: str = KEY, first=surrogate) -> DataFrame:
    """(kind, norm, surrogate) for distinct ``entities`` (kind, norm): all different, none a real entity.

    Each round draws for the entities still open; of those that draw one value the smallest keeps it. ``first`` is the drawing function.
    """
    family = F.substring_index("kind", ":", 1)  # given names of either gender and script are one space of values

    def drawn(open_: DataFrame, attempt: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                values = [first(k, n, attempt, key) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(values, pa.string())], names=["kind", "norm", "surrogate"]
                )

        return open_.select("kind", "norm").mapInArrow(run, "kind string, norm string, surrogate string")

    real = entities.select(family.alias("space"), F.col("norm").alias("surrogate")).distinct()
    done, left, attempt = None, entities, 0
    while True:
        tried = materialize(drawn(left, attempt).withColumn("space", family), "pii-drawn")
        free = tried.join(real, ["space", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select(family.alias("space"), "surrogate"), ["space", "surrogate"], "left_anti")
        winners = free.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "norm")).alias("w"))
        winners = materialize(winners.select("w.kind", "w.norm", "surrogate"), "pii-assigned")
        left = materialize(tried.select("kind", "norm").join(winners, ["kind", "norm"], "left_anti"), "pii-open")
        done = winners if done is None else done.unionByName(winners)
        attempt += 1
        if left.isEmpty():
            return done


_SPANS = "array<struct<s:int,e:int,kind:string,norm:string>>"


def _detected(docs: DataFrame, at: int, with_entities: bool) -> DataFrame:
    """Rows with entities and their spans, or the rows without any as they are."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("norm", pa.string())]))

    def run(batches):
        for batch in batches:
            spans = [detect(text.as_py() or "") for text in batch.column(at)]
            keep = pa.array([bool(s) == with_entities for s in spans], pa.bool_())
            if with_entities:
                rows = [[dict(zip(("s", "e", "kind", "norm"), x)) for x in s] for s in spans]
                batch = pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "spans"]
                )
            yield batch.filter(keep)

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{columns}, spans {_SPANS}" if with_entities else docs.schema)


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities (long).

    Rows without entities come back as they were. NULL and empty texts hold none. NULL ids and repeated rows are rows of their own, and one
    entity is replaced alike in all of them. An empty table gives an empty result. Other columns pass through.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, at = docs.toDF(*names), docs.columns.index("text")
    text = names[at]
    found = materialize(row_key(_detected(plain, at, True), "row"), "pii-found")
    spans = found.select("row", F.inline("spans"))
    mapping = materialize(assign(materialize(spans.select("kind", "norm").distinct(), "pii-entities"), key), "pii-mapping")
    chosen = spans.join(mapping, ["kind", "norm"])
    per_row = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind", "surrogate"))).alias("puts"))
    joined = found.join(per_row, "row").select(*names, "puts")

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for old, puts in zip(batch.column(at), batch.column(len(names))):
                old, puts, parts, done = old.as_py(), puts.as_py(), [], 0
                for put in puts:
                    parts += [old[done : put["s"]], rendered(put["kind"], old[put["s"] : put["e"]], put["surrogate"])]
                    done = put["e"]
                texts.append("".join([*parts, old[done:]]))
                counts.append(len(puts))
            columns = [*batch.columns[: len(names)], pa.array(counts, pa.int64())]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", n long"
    replaced = joined.mapInArrow(run, schema)
    clean = _detected(plain, at, False).withColumn("n", F.lit(0).cast("long"))
    return clean.unionByName(replaced).toDF(*docs.columns, "n_entities")
