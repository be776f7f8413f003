"""What the surrogates' finders find, and what may keep a text from being searched."""

import re
import unicodedata

import pytest
from saltmarsh.llm import pii

HEX = "9233a8ec" * 4
SCHEMA = "doc_id long, text string"


def test_secrets_of_either_case(spark):
    texts = [f'TOKEN = "{HEX.upper()}"', f"token {HEX}", f"mixed {HEX[:16]}{HEX[16:].upper()} "]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), SCHEMA), pii.QUERY_KEY).collect()}
    made = [re.search("[0-9a-fA-F]{32}", got[i].text)[0] for i in range(3)]
    assert made[0] == made[0].upper() and made[1] == made[1].lower()
    assert made[0].lower() == made[1] == made[2].lower() != HEX


@pytest.mark.parametrize("text", ["call +33 12 34 56 78 now", "key a1b2c3d4e5f6" + "ab" * 12, "a1" * 20, "GB12ABCDEFGHIJKLMNO", "Mr. X", "Jürgen Y", "1.2.3.4", "x@y.org", "GB12 ABCD EFGH IJ", "a:b:c:d:e:f:a:b", "AKIA" + "Q" * 16, "(Dr. Ada Smith)", "Господин Иванов", "555-123-4567", "2001:db8::1", "::1", "0171 2345678", "020 7946 0958", "ghp_" + "a1B2" * 9, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", "password=hunter2hunter2", "api_key: 'Zx81-Zx81'", "Signed,\nWilhelmina Vanderbilt", "Ich heiße Otto Weber", "je m'appelle Zoé"])
def test_all_that_is_found_has_a_hint(text):
    assert pii.find(text) and pii.hinted(text)


def test_names_without_lists(spark):
    text = "Joseph Kowalski and Dr. Ada Smith. Smith wrote to Kowalski; Ada did not. Господин Иванов came, Иванов left."
    docs = spark.createDataFrame([(1, text, "mine"), (2, None, None), (3, "", ""), (4, "IBAN GB12 ABCD EFGH IJ and GB12ABCDEFGHIJK, 555-123-4567, 1:2:3:4:5:6:7:abcd", "x")], SCHEMA + ", n_entities string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, pii.QUERY_KEY).collect()}
    words = re.findall(r"\w+", got[1].text)
    assert got[1].n_entities == "mine" and got[2].text is None and got[3].text == ""
    assert words[0] in pii.GIVEN["given_m"] and not {"Joseph", "Kowalski", "Ada", "Smith", "Иванов"} & set(words)
    assert words[5] == words[6] and words[1] == words[9] and words[4] == words[10] and words[14] == words[16]
    assert re.fullmatch(r"IBAN GB\d\d [A-Z]{4} [A-Z]{4} [A-Z]{2} and GB\d\d[A-Z]{11}, \d{3}-\d{3}-\d{4}, [0-9a-f:]{18}", got[4].text) and "555-123" not in got[4].text


def test_given_names_are_permuted_without_fixed_points():
    for kind, names in pii.GIVEN.items():
        made = [pii.surrogate(kind, n, pii.QUERY_KEY) for n in names]
        assert sorted(made) == sorted(names) and all(a != b for a, b in zip(made, names))


def test_bare_repeats_of_names():
    text = "Dr Miller's plan: Miller said so, but Millers and Miller@x.org differ. Alice Miller-Smith met Miller; Alice left."
    found = [(kind, entity) for _, _, kind, entity in sorted(pii.find(text))]
    assert found == [("surname", "Miller"), ("surname", "Miller"), ("email", "miller@x.org"), ("given_f", "Alice"), ("surname", "Miller-Smith"), ("surname", "Miller"), ("given_f", "Alice")]
    assert all(text[a:b].lower() == e.lower() for a, b, _, e in pii.find(text))


def test_crowded_shapes_and_other_scripts(spark):
    names = ["A", "E", "I", "O", "U", "김", "محمد", "राम", "สม", "Ł", "Ա"]
    entities = spark.createDataFrame([("surname", n) for n in names], "kind string, entity string")
    got = {r.entity: r.surrogate for r in pii.assign(entities, pii.QUERY_KEY).collect()}
    assert sorted(got) == sorted(names) and len(set(got.values())) == len(names) and not set(got.values()) & set(names)
    assert 0xAC00 <= ord(got["김"][0]) <= 0xD7A3 and all(unicodedata.name(c).startswith("ARABIC") for c in got["محمد"])
    assert len(got["김"]) == 1 and len(got["A"]) > 1


def test_alphabets_are_classes():
    for c in map(chr, [*range(0x41, 0x600), *range(0x620, 0x700), 0x915, 0xAC00, 0xB300, 0xD7A3, 0x1E00, 0x4E00]):
        assert c in pii._alphabet(c, False)
        assert all(pii._alphabet(x, False) == pii._alphabet(c, False) for x in pii._alphabet(c, False)[:40])


def found_in(text):
    return sorted({(kind, entity) for _, _, kind, entity in pii.find(text)})


def test_names_after_titles_particles_and_phrases():
    assert found_in("Frau Doktor Müller und Herr von Berg") == [("surname", "Berg"), ("surname", "Müller")]
    assert found_in("Signed, Wilhelmina Vanderbilt") == [("surname", "Vanderbilt"), ("surname", "Wilhelmina")]
    assert found_in("Kind regards,\nTom O'Neil") == [("surname", "O'Neil"), ("surname", "Tom")]
    assert found_in("Dr. Anna de la Cruz met Prof. Dr. Lee") == [("given_f", "Anna"), ("surname", "Cruz"), ("surname", "Lee")]
    assert found_in("My name is what it is. The doctor and the professor left, signed and sealed.") == []


def test_names_in_any_case_are_one(spark):
    text = "Mr SMITH wrote. Smith left; SMITH and McDonald's friend, Mrs McDonald, too. The smith stayed, MCDONALD went."
    assert found_in(text) == [("surname", "Mcdonald"), ("surname", "Smith")]
    docs = spark.createDataFrame([(1, text), (2, "Dr Smith and Mrs ALICE Jones. Alice!")], SCHEMA)
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs, pii.QUERY_KEY).collect()}
    words = re.findall(r"\w+", got[1])
    assert words[1] == words[5] == words[3].upper() != "SMITH" and "smith" in words
    assert words[7][0].isupper() and words[7][2].isupper() and words[7].upper() == words[-2] and words[7] == words[11] != "McDonald"
    other = re.findall(r"\w+", got[2])
    assert other[1] == words[3] and other[4] == other[6].upper() and other[6] in pii.GIVEN["given_f"]


def test_short_addresses_local_numbers_and_tokens(spark):
    texts = ["host 2001:db8::1 up, std::vector and a::b stay", "ring 0171 2345678 or 020 7946 0958", "use ghp_" + "a1B2" * 9, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", f'token = "{HEX.upper()}" password=hunter2hunter2; the password is long', "12:30::45 or 1::2::3"]
    found = [found_in(t) for t in texts]
    assert [[k for k, _ in f] for f in found] == [["ipv6"], ["phone", "phone"], ["token"], ["token"], ["password", "secret"], ["ipv6"]]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), SCHEMA), pii.QUERY_KEY).collect()}
    for i, f in enumerate(found):
        assert not any(e in got[i] for _, e in f) and len(got[i]) == len(texts[i])
    assert got[0].endswith("std::vector and a::b stay") and got[2].startswith("use ghp_") and got[3].startswith("eyJ") and got[4].endswith("the password is long")


def test_replaced_texts_are_the_finders_spans_replaced(spark):
    """Brute force: each entity's surrogate is one for the corpus, and texts are equal outside of the spans."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs, pii.QUERY_KEY).collect()}
    given, found = {}, 0
    for r in docs.collect():
        at, out, made = 0, [], got[r.doc_id]
        for start, end, kind, entity in sorted(pii.find(r.text) if pii.hinted(r.text) else []):
            assert made[len("".join(out)) :].startswith(r.text[at:start])
            out.append(r.text[at:start])
            rest = made[len("".join(out)) :]
            new = rest[: len(rest) - len(rest.lstrip())] or re.match(r"\S+", rest)[0]
            if (kind, entity) in given and kind in ("phone", "card", "ip"):
                assert rest.startswith(given[kind, entity])
            if kind in ("phone", "card", "ip"):
                new = given.setdefault((kind, entity), rest[: end - start] if kind != "ip" else re.match(r"[0-9.]+[0-9]", rest)[0])
            else:
                new = re.match(r"[\w@.+-]*\w" if kind == "email" else r"[\w:'’-]+(?: [0-9A-Z]{1,4})*" if kind == "iban" else r"\w[\w:'’-]*" if kind not in pii.NAMES else r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", rest)[0]
            assert new != r.text[start:end]
            out.append(new)
            at, found = end, found + 1
    assert found > 20 and len(set(given.values())) == len(given)
