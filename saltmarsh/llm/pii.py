"""PII surrogates (operator 1): keyed replacements of the same type, script and format.

Entities are found in whole texts; each distinct entity gets one surrogate for the whole corpus, so what named
the same thing before does so after. A surrogate is a keyed permutation of the strings with the entity's
shape (letters by case and script, digits, hexadecimal digits; punctuation stays; a crowded shape gets letters), so two entities of a type
never share one by construction. Collisions are checked over all entities: a surrogate that is itself an
entity of the corpus, or that another entity got in an earlier attempt, is drawn again with another tweak.
Names are words after titles (also several, and with small words such as `von` between), after phrases such as
`my name is` or `regards`, or after given names; they are the same in any case, and surrogates are written as the name
is. Given names are permuted inside a list of their gender; card numbers keep whether their check digit holds;
addresses stay public or private.

Defined results: null stays null and empty stays empty, with 0 entities; repeated rows get equal results;
a text is replaced as a whole however long it is; of entities with the same surrogate the least one keeps it; other
columns are kept, and one named n_entities is, too, in place of the count; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm import common
from saltmarsh.llm.decontam import bits_of, passes

#: Given names by gender, titles before names.
GIVEN = {
    "given_f": "Alice Anna Barbara Carmen Charlotte Claire Elena Elizabeth Emily Emma Heike Ingrid Isabel Jane Jennifer Julia Karen Laura Linda Lucia Maria Marie Mary Nancy Olivia Patricia Petra Sabine Sarah Sophie Susan Ursula".split(),
    "given_m": "Adam Albert Andreas Antonio Carlos Charles Daniel David Diego Fernando Francisco Georg Hans Henri James Javier Jean John Jorge Joseph Jürgen Karl Klaus Louis Manuel Michael Miguel Paul Peter Pierre Robert Thomas".split(),
}
TITLES = "Mr Mrs Ms Miss Mister Sir Dr Prof Doctor Professor Herr Herrn Frau Doktor Professorin Monsieur Madame Mademoiselle Mme Mlle Docteur Señor Señora Señorita Sr Sra Don Doña Doctora Господин Госпожа Доктор".split()
PARTICLES = "von vom van den der de del della di da dos du la le ten ter zu zum bin ibn al el".split()
CUES = r"[Ss]igned|[Rr]egards|[Ss]incerely|[Mm]y name is|[Ii]ch hei(?:ß|ss)e|[Mm]ein Name ist|[Gg]r(?:ü|ue)(?:ß|ss)en|[Jj]e m['’]appelle|[Cc]ordialement|[Mm]e llamo|[Mm]i nombre es|[Aa]tentamente"
CUE_WORDS = "signed regards sincerely name heiße heisse Name grüßen gruessen grüssen appelle cordialement llamo nombre atentamente".split()
NAMES = ("surname", *GIVEN)
GENDER = {name: kind for kind, names in GIVEN.items() for name in names}

#: What may hold an entity at all: each match of FINDERS has one of these inside, or a title or given name as a word.
HINT = re.compile(r"@|::|gh[pousr]_|eyJ|xox[baprs]-|(?i:passw|pwd|secret|api.?key|token)|[0-9]{3}|(?:[0-9]+[.]){3}|[+][0-9]|[0-9a-fA-F]{32}|[A-Z]{2}[0-9]{2} ?[0-9A-Z]{4}|(?:[0-9a-fA-F]{1,4}:){7}|A[KS]IA[0-9A-Z]{16}").search
LETTERS, BEFORE_NAMES = re.compile(r"[^\W\d_]+").findall, frozenset([*TITLES, *GENDER, *CUE_WORDS, *(w[0].upper() + w[1:] for w in CUE_WORDS)])


def hinted(text: str) -> bool:
    return HINT(text) is not None or not BEFORE_NAMES.isdisjoint(LETTERS(text))


WORDS = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
#: A word that begins with no small letter; scripts without case have none.
NAMED = rf"(?=[^\W\d_a-zß-öø-ÿα-ωа-яё]){WORDS}"
#: A name's part, with what may stand before it in small letters.
FULL = rf"(?:(?:{'|'.join(PARTICLES)}) +){{0,3}}{NAMED}"
FINDERS = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[^\W_]+(?:[.-][^\W_]+)*\.[A-Za-z]{2,}(?![\w]))"
    r"|(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))"
    r"|(?P<ipv6>(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:]))"
    r"|(?P<short_ipv6>(?<![\w:])(?=[0-9a-fA-F:]*[0-9])(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?(?![\w:]))"
    r"|(?P<token>(?<![\w-])(?:gh[pousr]_[A-Za-z0-9]{20,255}|xox[baprs]-[A-Za-z0-9-]{10,250}|eyJ[\w-]{8,4000}\.[\w-]{8,8000}\.[\w-]{4,4000})(?![\w-]))"
    r"|(?P<password>(?i:passwor[dt]|passwd|pwd|secret|api[_ -]?key|token)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<value>(?=[^\s\"']*[0-9])[^\s\"',;]{8,128}))"
    r"|(?P<key>(?<![\w])A[KS]IA[0-9A-Z]{16}(?![\w]))"
    r"|(?P<secret>(?<![\w])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,128}(?![\w]))"
    r"|(?P<iban>(?<![\w])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![\w]))"
    r"|(?P<card>(?<![\w.])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\w]|\.[0-9]))"
    r"|(?P<phone>(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w])|(?<![\w.])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![\w])|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])|(?<![\w.-])0[0-9]{2,4}(?:[ /-][0-9]{5,8}| [0-9]{3,4} [0-9]{4})(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    rf"|(?P<name>\b(?:{'|'.join(TITLES)})\.?(?: +(?:{'|'.join(TITLES)})\b\.?)* +{FULL}(?: +{FULL}){{0,2}}|\b(?:{CUES})\b[,:]?\s{{1,4}}{FULL}(?: +{FULL}){{0,2}}|\b(?:{'|'.join(sorted(GENDER))}) +{FULL})"
)
HEXADECIMAL = re.compile(r"[0-9a-fA-F]{32,128}")
TITLE = re.compile(rf"(?:(?:{'|'.join(TITLES)})\b\.? +)+|(?:{CUES})\b[,:]?\s+(?:(?:{'|'.join(TITLES)})\b\.? +)*")
IBAN_LETTERS = {c: str(i + 10) for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def canonical(name: str) -> str:
    """A name's form for all its cases: small letters, with a capital at the start of each part."""
    return re.sub(r"[^\W\d_]+", lambda m: m[0][0].upper() + m[0][1:].lower() if len(m[0][0].upper()) == 1 else m[0], name)


def recased(made: str, was: str) -> str:
    """A name's surrogate as the name is written: in capitals, with a capital inside, or as it is."""
    letters = [c for c in was if c.isalpha()]
    if len(letters) > 1 and was == was.upper() and was != was.lower():
        return "".join(c.upper() if len(c.upper()) == 1 else c for c in made)
    if was != canonical(was) and len(was) <= len(made):
        return "".join(m.upper() if w.isupper() and len(m.upper()) == 1 else m for w, m in zip(was, made)) + made[len(was) :]
    return made


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, type and entity of what a text holds. A full name gives one entity for each part, whatever its case, and each bare repeat of a part in the same text is the same entity; a single letter isn't told from other uses and has no repeats."""
    out = []
    names: dict[str, tuple[str, str]] = {}
    for m in FINDERS.finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
            continue
        if kind == "short_ipv6":
            if not _is_ip(m[0]):
                continue
            kind = "ipv6"
        if kind == "password":
            start, end = m.span("value")
            # what has a form of its own is of that type
            inner = FINDERS.match(text, start)
            if inner and inner.end() == end and inner.lastgroup not in ("password", "name", "short_ipv6"):
                kind = inner.lastgroup
        if kind == "name":
            at = start + (t.end() if (t := TITLE.match(m[0])) else 0)
            for part in re.finditer(WORDS, text[at:end]):
                written = re.sub("['’]s$", "", part[0])
                if written in PARTICLES:
                    continue
                name = canonical(written)
                of = GENDER.get(name, "surname"), name
                names |= {x: of for x in (written, name, name.upper())}
                out.append((at + part.start(), at + part.start() + len(written), *of))
            continue
        value = text[start:end]
        value = value.lower() if kind in ("email", "secret", "ipv6") else value.replace(" ", "") if kind == "iban" else value
        out.append((start, end, kind, value))
    return out + _repeats(text, names, out) if names else out


def _is_ip(text: str) -> bool:
    import ipaddress

    try:
        return bool(ipaddress.ip_address(text))
    except ValueError:
        return False


def _repeats(text: str, names: dict[str, tuple[str, str]], found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Where names stand as whole words outside of what was found, as they were written, with a capital or in capitals; the longer of two names goes first."""
    out = []
    spans = sorted((a, b) for a, b, _, _ in found)
    for name in sorted(names, key=len, reverse=True):
        at = text.find(name) if len(name) > 1 else -1
        while at >= 0:
            end = at + len(name)
            whole = not re.match(r"\w", text[at - 1 : at]) and not re.match(r"\w", text[end : end + 1])
            if whole:
                i = bisect.bisect_left(spans, (at, end))
                if (i == 0 or spans[i - 1][1] <= at) and (i == len(spans) or spans[i][0] >= end):
                    spans.insert(i, (at, end))
                    out.append((at, end, *names[name]))
            at = text.find(name, end)
    return out


FIXED = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñýþßð", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ")
RANGES = ((0x3B1, 0x3C9), (0x391, 0x3A9), (0x430, 0x44F), (0x410, 0x42F), (0x5D0, 0x5EA), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF))


def _script(c: str) -> tuple[str, str]:
    """Of letters and digits of any script: the first word of the character's name, and its category."""
    return unicodedata.name(c, "").split(" ")[0], unicodedata.category(c)


def _listed(c: str) -> bool:
    return any(c in a for a in FIXED) or any(low <= ord(c) <= high for low, high in RANGES)


@cache
def _alphabet(c: str, hexadecimal: bool) -> str:
    """The characters that may stand for one: of the same case, script and kind."""
    if hexadecimal:
        return "0123456789abcdef"
    for a in FIXED:
        if c in a:
            return a
    if not c.isalpha() and not c.isdecimal():
        return c
    for low, high in RANGES:
        if low <= ord(c) <= high:
            return "".join(x for x in map(chr, range(low, high + 1)) if x.isalpha())
    # 4096 places at a time: most scripts are in one such part, all of Hangul's syllables in three
    script, part = _script(c), ord(c) & ~0xFFF
    return "".join(x for x in map(chr, range(part, part + 0x1000)) if (x.isalpha() or x.isdecimal()) and _script(x) == script and not _listed(x))


def permute(n: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): Feistel rounds on the bits, repeated while the number is outside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = n >> half, n & mask
        for r in range(6):
            mark = hashlib.blake2b(right.to_bytes((half + 7) // 8, "big") + bytes([r]) + tweak.encode(), key=key, digest_size=min(64, (half + 7) // 8)).digest()
            left, right = right, left ^ (int.from_bytes(mark, "big") & mask)
        n = left << half | right
        if n < size:
            return n


def permute_shape(text: str, key: bytes, tweak: str, hexadecimal: bool = False, good: Callable[[str], bool] = lambda x: True) -> str:
    """A keyed permutation of the strings with a text's shape, or of the good ones among them if the text is good."""
    alphabets = [_alphabet(c, hexadecimal) for c in text]
    shape = "".join(a[0] for a in alphabets)
    size = 1
    for a in alphabets:
        size *= len(a)
    n = 0
    for c, a in zip(text, alphabets):
        n = n * len(a) + a.index(c)
    while True:
        n = permute(n, size, key, f"{tweak}/{shape}")
        rest, out = n, []
        for a in reversed(alphabets):
            rest, i = divmod(rest, len(a))
            out.append(a[i])
        if good(made := "".join(reversed(out))):
            return made


def _public(ip: str) -> str:
    import ipaddress

    a = ipaddress.ip_address(".".join(str(int(x)) for x in ip.split(".")))
    return "private" if a.is_private else "multicast" if a.is_multicast else "reserved" if a.is_reserved else "public"


#: After so many attempts a shape gets one more letter.
WIDEN_AFTER = 4


def _wider(text: str, more: int) -> str:
    """A text with more letters of its last letter's script at its end."""
    last = next((c for c in reversed(text) if c.isalpha()), "x")
    low = last.lower() if len(last.lower()) == 1 else last
    return text + (low if len(_alphabet(low, False)) > 1 else "x") * more


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity. For the same type, key and attempt, different entities have different ones. Names and addresses get longer in late attempts, as their shapes may have too few strings."""
    tweak, more = f"{kind}/{attempt}", attempt // WIDEN_AFTER
    if kind in GIVEN and entity in GIVEN[kind]:
        names = sorted(GIVEN[kind], key=lambda x: hmac.digest(key, f"{kind}/{x}".encode(), "sha256"))  # a circle: no name stands for itself
        return names[(names.index(entity) + 1 + attempt % (len(names) - 1)) % len(names)]
    if kind == "email":
        user, _, domain = entity.partition("@")
        labels, _, top = domain.rpartition(".")
        return f"{permute_shape(_wider(user, more), key, tweak + '@' + domain)}@{permute_shape(labels, key, 'domain/' + str(attempt))}.{top}"
    if kind == "ip":
        octets = entity.split(".")
        if any(str(int(x)) != x for x in octets):
            return permute_shape(entity, key, tweak, good=lambda x: all(int(o) < 256 for o in x.split(".")))
        n, same = int.from_bytes(bytes(map(int, octets)), "big"), _public(entity)
        while True:
            n = permute(n, 1 << 32, key, tweak)
            if _public(made := ".".join(map(str, n.to_bytes(4, "big")))) == same:
                return made
    if kind == "card":
        digits = re.sub(r"\D", "", entity)
        holds = luhn(digits)
        made = iter(permute_shape(digits, key, tweak, good=lambda x: luhn(x) == holds))
        return "".join(next(made) if c.isdigit() else c for c in entity)
    if kind == "ipv6":
        digits = iter(permute_shape(entity.replace(":", ""), key, tweak + "/".join(str(len(x)) for x in entity.split(":")), hexadecimal=True))
        return "".join(c if c == ":" else next(digits) for c in entity)
    if kind == "token":
        cut = re.match(r"gh._|xox.-|eyJ", entity).end()
        return entity[:cut] + permute_shape(entity[cut:], key, tweak + entity[:cut])
    if kind == "key":
        return entity[:4] + permute_shape(entity[4:], key, tweak + entity[:4])
    if kind == "iban":
        body = permute_shape(entity[4:], key, tweak + entity[:2])
        check = 98 - int("".join(IBAN_LETTERS.get(c, c) for c in body + entity[:2] + "00")) % 97
        return f"{entity[:2]}{check:02d}{body}"
    if kind == "phone":
        cut = m.end() if (m := re.match(r"\+[0-9]{1,3}(?![0-9])", entity)) else 0
        return entity[:cut] + permute_shape(entity[cut:], key, tweak + entity[:cut])
    return permute_shape(_wider(entity, more) if kind == "surname" else entity, key, tweak, hexadecimal=kind == "secret")


def _spans(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column("row_key"), batch.column("text")):
                text = text.as_py() or ""
                if hinted(text) and (spans := find(text)):
                    keys += [key.as_py()] * len(spans)
                    found += spans
            cols = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string())))], names=["row_key", "start", "stop", "kind", "entity"])
        common.give_back()

    return docs.select("row_key", "text").mapInArrow(run, "row_key string, start int, stop int, kind string, entity string")


def assign(entities: DataFrame, key: bytes, attempts: int = 40) -> DataFrame:
    """kind, entity, surrogate for distinct (kind, entity); checks that no surrogate is an entity of the corpus or given twice. The shapes of names and addresses are widened until there is room."""
    left, done = entities, None
    for k in range(attempts):

        def run(batches: Iterator[pd.DataFrame], k: int = k) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf["surrogate"] = [surrogate(a, b, key, k) for a, b in zip(pdf["kind"], pdf["entity"])]
                yield pdf

        tried = common.stash(left.mapInPandas(run, "kind string, entity string, surrogate string"), "tried")
        taken = entities.filter(~F.col("kind").isin(*GIVEN)).select("kind", F.col("entity").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        free = tried.join(taken, ["kind", "surrogate"], "left_anti")
        free = common.stash(free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate"), "free")
        done = free if done is None else done.unionByName(free)
        left = common.stash(left.join(free.select("kind", "entity"), ["kind", "entity"], "left_anti"), "left")
        if left.isEmpty():
            return done
    raise ValueError("an entity's shape has no free surrogate")


def replace(text: str, spans: list) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        was = text[s["start"] : s["stop"]]
        made = s["surrogate"]
        if s["kind"] in NAMES:
            made = recased(made, was)
        elif " " in was and " " not in made and len(was.replace(" ", "")) == len(made):  # an account number keeps its groups
            digits = iter(made)
            made = "".join(c if c == " " else next(digits) for c in was)
        elif made == made.lower() and HEXADECIMAL.fullmatch(was):  # so does a secret
            made = made.upper() if was == was.upper() else "".join(m.upper() if w.isupper() else m for w, m in zip(was, made))
        elif was != was.lower() and made == made.lower() and "@" in was:  # an address keeps its capitals
            made = "".join(m.upper() if w.isupper() and len(m.upper()) == 1 else m for w, m in zip(was, made))
        out += [text[at : s["start"]], made]
        at = s["stop"]
    return "".join([*out, text[at:]])


#: Columns of its own; a table may have any others.
KEY, SPANS, MAYBE = "__saltmarsh_key", "__saltmarsh_spans", "__saltmarsh_maybe"


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with surrogates in their texts, and n_entities, unless they have a column of that name. Only texts with entities are shuffled, and few others: a filter of fixed size tells them apart."""
    common.batch_rows(docs.sparkSession)
    columns = docs.columns
    count = [] if "n_entities" in columns else [T.StructField("n_entities", T.LongType())]
    keyed = docs.withColumn(KEY, F.md5(F.col("text").cast("binary")))
    spans = common.stash(_spans(keyed.select(F.col(KEY).alias("row_key"), "text")).distinct(), "spans")
    entities = common.stash(spans.select("kind", "entity").distinct(), "entities")
    given = assign(entities, key)
    # a frequent entity is in very many spans: Spark's skew join splits them
    changes = common.stash(spans.join(given, ["kind", "entity"]).groupBy(F.col("row_key").alias(KEY)).agg(F.collect_list(F.struct("start", "stop", "kind", "surrogate")).alias(SPANS)), "changes")
    common.drop(spans, entities)
    wanted = docs.sparkSession.sparkContext.broadcast(bits_of(changes.select(F.xxhash64(KEY).alias("h"))))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(passes(wanted.value, h.to_numpy("int64").view("uint64")))

    schema = T.StructType([*docs.schema, *count])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [s or [] for s in batch.column(SPANS).to_pylist()]
            texts = [replace(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), spans)]
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array([len(s) for s in spans], pa.int64())] * len(count)], names=[*columns, *(f.name for f in count)])

    split = keyed.withColumn(MAYBE, F.coalesce(maybe(F.xxhash64(KEY)), F.lit(False)))
    changed = split.filter(MAYBE).drop(MAYBE).join(changes, KEY, "left").mapInArrow(run, schema)
    return changed.unionByName(split.filter(~F.col(MAYBE)).select(*columns, *(F.lit(0).cast("long").alias(f.name) for f in count)))


#: The key of the queries; a user gives another one that stays secret.
QUERY_KEY = hmac.new(b"saltmarsh", b"op1 query", hashlib.sha256).digest()


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, QUERY_KEY)
