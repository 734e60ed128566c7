import re

import pytest

from carelens.llm import surrogates as S
from carelens.llm.surrogates import build_registry, mentions, permuted, rendered, replace_entities, same_format, surrogate, with_surrogates

from .util import documents, some_texts

KEY = b"test key"


def luhn_ok(digits):
    return S._luhn(digits[:-1]) == int(digits[-1])


def test_permutations_keep_formats_apart():
    for size in (2, 10, 97, 1000):
        assert sorted(permuted(x, size, KEY, "t") for x in range(size)) == list(range(size))
    out = {same_format(f"a{n:03d}é-Ж", KEY, "t") for n in range(1000)}
    assert len(out) == 1000 and all(re.fullmatch(r"[a-z]\d{3}[à-ÿ]-[А-Я]", x) for x in out)
    cards = [f"4{n:014d}" for n in range(300)]
    cards = [c + str(S._luhn(c)) for c in cards]
    moved = [surrogate("card", c, KEY) for c in cards]
    assert len(set(moved)) == 300 and all(luhn_ok(c) and c[0] == "4" for c in moved)
    assert not luhn_ok(surrogate("card", "4111111111111112", KEY))
    for ip in ("10.1.2.3", "192.168.7.9", "172.20.1.1", "127.0.0.1"):
        assert surrogate("ipv4", ip, KEY).split(".")[0] == ip.split(".")[0]


TEXT = ("Mrs. Anna Berg wrote to ANNA@Mail7.Example.com from 97.51.17.173; Berg's phone is +1 (017) 555-7713 or +1 017 555 7713. "
        "Card 4532 0151 1283 0366, ssn 078-05-1120. Herr Karl Ünal and Mrs Berg met. Mr. BERG too. г-жа Ольга Петрова.\n"
        "On 2024-01-15, version 1.2.3, years 1999-2001, hex 00112233445566778899aabbccddeeff0011 stay.")


def test_mentions_and_rendering():
    got = {(TEXT[a:b], k) for a, b, k, _ in mentions(TEXT)}
    assert {("Anna", "given-f-latin"), ("Berg", "family-latin"), ("ANNA@Mail7.Example.com", "email"), ("97.51.17.173", "ipv4"),
            ("+1 (017) 555-7713", "phone"), ("+1 017 555 7713", "phone"), ("4532 0151 1283 0366", "card"), ("078-05-1120", "ssn"),
            ("Ünal", "family-latin"), ("BERG", "family-latin"), ("Ольга", "given-f-cyrillic"), ("Петрова", "family-cyrillic")} <= got
    assert not any("2024" in t or "1999" in t or t.startswith("0011") or t == "1.2.3" for t, _ in got)
    for a, b, kind, canon in mentions(TEXT):
        new = rendered(kind, TEXT[a:b], canon, surrogate(kind, canon, KEY))
        assert new != TEXT[a:b]
        if not kind.startswith(("given", "family", "ipv4")):
            assert re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", new))) == re.sub(
                r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", TEXT[a:b])))


def test_texts(spark):
    texts = [TEXT, "Reach 97.51.17.173 and anna@mail7.example.com", *some_texts(), "no entity", TEXT]
    docs = documents(spark, texts)
    rows = {r.row.doc_id: r for r in replace_entities(docs, KEY).collect()}
    assert len(rows) == len(texts)
    new = rows[0].text
    assert rows[len(texts) - 1].text == new
    for gone in ("Anna", "Berg", "BERG", "97.51.17.173", "555-7713", "4532 0151", "078-05", "Ünal", "Ольга", "Петрова", "Mail7"):
        assert gone not in new
    assert "On 2024-01-15, version 1.2.3, years 1999-2001, hex 00112233445566778899aabbccddeeff0011 stay." in new
    name = re.search(r"Mrs\. (\w+) (\w+) wrote", new)
    assert f"{name[2]}'s phone" in new and f"Mrs {name[2]} met" in new and f"Mr. {name[2].upper()} too" in new
    assert name[1].startswith(S.GIVEN["latin"]["f"])
    phones = re.findall(r"\+1 [(\d][^o.]*\d{4}", new)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and len(phones) == 2
    ip = next(e.replacement for e in rows[0].entities if e.kind == "ipv4")
    mail = next(e.replacement for e in rows[0].entities if e.kind == "email")
    assert rows[1].text == f"Reach {ip} and {mail}"
    for i, t in enumerate(texts[2:], 2):
        if not mentions(t):
            assert rows[i].text == t and rows[i].entities is None
        else:
            want = t
            for a, b, kind, canon in reversed(mentions(t)):
                want = want[:a] + rendered(kind, t[a:b], canon, {(e.kind, e.canon): e.replacement for e in rows[i].entities}[kind, canon]) + want[b:]
            assert rows[i].text == want
    same = with_surrogates(docs, KEY, length_col="n_chars")
    assert same.columns == docs.columns and same.dtypes == docs.dtypes
    assert all(r.n_chars == len(r.text) for r in same.collect() if r.text is not None)
    assert with_surrogates(documents(spark, []), KEY).collect() == []


def test_collisions_are_drawn_anew(spark):
    found = [("given-f-latin", f"name{i}") for i in range(60)] + [("family-latin", f"f{i}") for i in range(50)]
    found += [("given-f-latin", "alice"), ("given-f-latin", "emma")]
    reg = build_registry(spark.createDataFrame(found, "kind string, canon string"), KEY).collect()
    assert len(reg) == len(found)
    assert len({(r.kind, r.replacement) for r in reg}) == len(found)
    assert not {(r.kind, r.replacement) for r in reg} & {(r.kind, r.canon) for r in reg}
    assert max(r.attempt for r in reg) > 0


def registry_is_sound(found, reg):
    assert {(r.kind, r.canon) for r in reg} == set(found) and len(reg) == len(set(found))
    real = {(k.split("-")[0], c) for k, c in found}
    assert not {(r.kind.split("-")[0], r.replacement) for r in reg} & real
    assert len({(r.kind, r.replacement) for r in reg}) == len(reg)
    for r in reg:      # the registry is what the keyed draw of its attempt gives
        assert r.replacement == surrogate(r.kind, r.canon, KEY, r.attempt)


def test_used_up_formats_are_widened(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    found = [("email", f"{a}@{b}.com") for a in letters for b in letters]
    found += [("ipv4", f"192.168.{a}.{b}") for a in range(256) for b in range(256)]
    found += [("ssn", f"{i:03d}456789") for i in range(300)] + [("phone", f"{i:07d}") for i in range(200)]
    reg = build_registry(spark.createDataFrame(found, "kind string, canon string"), KEY).collect()
    registry_is_sound(found, reg)
    assert all(S.ip_address(r.replacement).is_private for r in reg if r.kind == "ipv4")
    assert all(re.fullmatch(r"[a-z]{2,4}@[a-z]\.com", r.replacement) for r in reg if r.kind == "email")


def test_wider_surrogates_are_written_whole():
    for kind, text in (("phone", "123 4567"), ("ssn", "123-45-6789")):
        new = surrogate(kind, re.sub(r"\D", "", text), KEY, S.WIDEN + 1)
        assert re.sub(r"\D", "", rendered(kind, text, "", new)) == new and len(new) == len(re.sub(r"\D", "", text)) + 2


def test_rounds_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "ROUNDS", 2)
    found = [("email", f"{a}@{b}.com") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    with pytest.raises(RuntimeError, match="2 rounds"):
        build_registry(spark.createDataFrame(found, "kind string, canon string"), KEY)


def test_valid_accounts_stay_valid():
    valid = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
    for account in ("DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"):
        for attempt in range(5):
            new = surrogate("iban", account, KEY, attempt)
            assert valid(account) and valid(new) and new != account
            assert re.sub(r"\d", "9", re.sub("[A-Z]", "A", new[4:])) == re.sub(r"\d", "9", re.sub("[A-Z]", "A", account[4:])) and new[:2] == account[:2]
    assert surrogate("iban", "DE00370400440532013000", KEY)[:2] == "DE"


def test_one_person_under_several_titles(spark):
    texts = ["Dr. Anna Schmidt came.", "Frau Anna Schmidt left, and Anna Schmidt slept.", "Prof. Kim Berg", "Mr. Kim Berg", "Mrs. Kim Berg", "Dr. Olga Roth"]
    rows = {r.row.doc_id: r.text for r in replace_entities(documents(spark, texts), KEY).collect()}
    given = [re.search(r"(?:Dr\.|Frau|Prof\.|Mrs?\.) (\w+) (\w+)", rows[i]).groups() for i in range(6)]
    assert given[0] == given[1] and given[0][0].startswith(S.GIVEN["latin"]["f"])
    assert rows[1].count(given[0][0]) == 2
    assert given[2][0] not in (given[3][0], given[4][0]) and given[3][0] != given[4][0]        # known as both: stays apart
    assert given[5][0].startswith(S.GIVEN["latin"]["u"])


@pytest.mark.parametrize("text", ["a@b", "@", "1.2.3.4.5", "999.1.1.1", "+", "Mr. ", "x@y.zz.", "..@a.b", "1234567 12", "Dr Prof Mr Ms",
                                  "::1 ab:cd", "DE89 3704 0044 0532 0130 00", "A" * 3000 + "@b.c"])
def test_odd_texts(text):
    for a, b, kind, canon in mentions(text):
        assert rendered(kind, text[a:b], canon, surrogate(kind, canon, KEY))
    java_digits = re.compile(S.CANDIDATE)
    assert not mentions(text) or java_digits.search(text)


PHONES = ("+49 170 1234567", "+44 20 79460958", "030 12345678", "5551234567", "+33 1 23 45 67 89", "+49 (0)30 1234567", "(030) 12345678", "030/1234567",
          "015112345678", "0049 170 1234567", "+86 10 1234 5678", "555 1234567", "+41 44 6681800", "+1 (017) 555-7713", "555-123-4567")
OTHERS = (("2001:db8::1", "ipv6"), ("fe80::1ff:fe23:4567:890a", "ipv6"), ("2001:DB8::FF00:42:8329", "ipv6"), ("2001:db8::", "ipv6"),
          ("2001:0db8:0000:0000:0000:0000:0000:0001", "ipv6"), ("3782 822463 10005", "card"), ("3782-822463-10005", "card"), ("378282246310005", "card"))


@pytest.mark.parametrize("entity,kind", [*((p, "phone") for p in PHONES), *OTHERS])
def test_numbers_and_addresses_of_other_forms(entity, kind):
    for text in (f"call {entity} now", f"{entity}, or:", f"({entity}).", f"x: {entity}"):
        got = mentions(text)
        assert [(text[a:b], k) for a, b, k, _ in got] == [(entity, kind)]
        assert re.search(S.CANDIDATE, text)
    canon = got[0][3]
    new = rendered(kind, entity, canon, surrogate(kind, canon, KEY))
    assert new != entity and mentions(f"x {new}")[0][2] == kind
    if kind != "ipv6":
        assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", entity)
    if kind == "card":
        assert luhn_ok(re.sub(r"\D", "", new))


def test_forms_that_are_none():
    for text in ("pi is 3.1415926535 or 1234567.890", "on 01/02/2024 or 01.02.2024", "1 200 000", "std::add a::b :: ::1 12:30:45", "12345678 rows", "123456 789012"):
        assert mentions(text) == [], text
    text = "2001:DB8::1 is 2001:0db8:0:0:0:0:0:1; +1 555 123 4567 555 123 4567"
    assert len({c for *_, k, c in mentions(text) if k == "ipv6"}) == 1
    assert [text[a:b] for a, b, k, _ in mentions(text) if k == "phone"] == ["+1 555 123 4567", "555 123 4567"]
    for text, phone in (("room 12 5551234567", "5551234567"), ("5551234567 12 rooms", "5551234567"), ("030 12345678 20 Uhr", "030 12345678"),
                        ("2024-01-15 030 12345678", "030 12345678"), ("+49 170 1234567 123456 x", "+49 170 1234567")):
        assert [text[a:b] for a, b, k, _ in mentions(text)] == [phone], text


@pytest.mark.parametrize("text,names", [
    ("Herr Dr. Müller kam", {"Müller": "family-latin"}), ("Prof. Dr. Anna Schmidt", {"Anna": "given-u-latin", "Schmidt": "family-latin"}),
    ("Frau Prof. Dr. Anna Schmidt", {"Anna": "given-f-latin", "Schmidt": "family-latin"}), ("Dr. Mrs. Anna Berg", {"Anna": "given-f-latin", "Berg": "family-latin"}),
    ("Mr. John F. Kennedy spoke", {"John": "given-m-latin", "Kennedy": "family-latin"}), ("Mr J.F. Kennedy", {"Kennedy": "family-latin"}),
    ("Mr J F Kennedy", {"Kennedy": "family-latin"}), ("Herr Karl-Heinz von der Berg", {"Karl-Heinz": "given-m-latin", "Berg": "family-latin"}),
    ("Mrs Anna Maria Lopez and", {"Anna": "given-f-latin", "Maria": "given-f-latin", "Lopez": "family-latin"}),
    ("Mr. Smith Mrs. Jones", {"Smith": "family-latin", "Jones": "family-latin"}), ("г-н Dr Иван Петров", {"Иван": "given-m-cyrillic", "Петров": "family-cyrillic"}),
    ("Mr. Drew and I met", {"Drew": "family-latin"}), ("Dr. Dr. and Prof.", {})])
def test_titles_initials_and_long_names(text, names):
    text += ". A Dr stays"
    assert {text[a:b]: k for a, b, k, _ in mentions(text)} == names
    assert not names or re.search(S.CANDIDATE, text)
