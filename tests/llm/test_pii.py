import re
from collections import defaultdict

import pytest

from lamella.llm import pii
from lamella.llm.pii import entity_table, replace_pii
from lamella.llm.queries import op9_pii

EMAIL, PHONE, IP, CARD = r"[\w.%+-]+@[\w.-]+\.[a-z]{2,}", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.]\d)", r"(?<![\w])\d{16}(?![\w])"
KEY, PASSWORD, TOKEN = r"\bAKIA[A-Z0-9]{16}\b", r"password=([0-9a-f]{18})\b", r'token = "([0-9a-f]{40})"'
ALL = re.compile("|".join((EMAIL, PHONE, IP, CARD, KEY, PASSWORD, TOKEN)))


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def one(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in replace_pii(df, "key").orderBy("doc_id").collect()]


def test_query_against_an_independent_search(spark):
    sf_dir = "/root/testdata/sf0.01"
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    after = {r.doc_id: r for r in op9_pii(spark, sf_dir).collect()}
    assert after.keys() == before.keys()
    given, places = {}, 0
    for doc, text in before.items():
        old = [m for m in ALL.finditer(text) if not re.fullmatch(CARD, m[0]) or luhn(m[0])]
        new = [m for m in ALL.finditer(after[doc].text) if not re.fullmatch(CARD, m[0]) or luhn(m[0])]
        assert ALL.sub("*", text) == ALL.sub("*", after[doc].text)  # nothing else changes
        assert len(old) == len(new) == after[doc].n_entities
        for a, b in zip(old, new, strict=True):
            assert a[0] != b[0] and given.setdefault(a[0], b[0]) == b[0]
            for kind in (EMAIL, PHONE, IP, CARD, KEY, PASSWORD, TOKEN):
                assert bool(re.fullmatch(kind, a[0])) == bool(re.fullmatch(kind, b[0]))
            places += 1
    assert places > 50 and len(set(given.values())) == len(given) and not set(given) & set(given.values())


def test_formats_and_coreference(spark):
    text, = one(spark, "Call +1 (988) 555-2485 or 988.555.2485; card 4041 8949 7460 8795, 4041894974608795; ssn 123-45-6789; BOB@x.com bob@X.com")
    phones = re.findall(r"[\d+(][\d() .-]{9,}\d", text)
    digits = [re.sub(r"\D", "", p) for p in phones]
    assert digits[0][1:] == digits[1] and phones[0].startswith("+1 (") and "." in phones[1]
    assert digits[2] == digits[3] and luhn(digits[2]) and digits[2][0] == "4" and phones[2].count(" ") == 3
    assert re.search(r"ssn 9\d\d-\d\d-\d{4};", text)
    emails = re.findall(EMAIL, text)
    assert emails[0] == emails[1] != "bob@x.com"


def composed(script, gender, place):
    """A pattern of the names that syllables make."""
    first, between = (x.replace(" ", "|") for x in pii.SYLLABLES[script])
    return f"(?:{first})(?:{between})+(?:{pii.LAST[script, gender][place].replace(' ', '|')})"


def test_names_keep_gender_and_script(spark):
    first, second = one(spark, "Mr. John Smith met Mrs. Jane Smith, Herr Smith and Mr Smith.", "господин Иванов и госпожа Иванова; κυρία Παπαδοπούλου")
    given, woman, family = composed("latin", "m", 0), composed("latin", "f", 0), composed("latin", "n", 1)
    found = re.fullmatch(rf"Mr\. ({given}) ({family}) met Mrs\. ({woman}) ({family}), Herr ({family}) and Mr ({family})\.", first)
    assert found and found[2] == found[4] == found[5] == found[6] and not set(found.groups()) & {"John", "Jane", "Smith"}
    assert re.fullmatch(rf"господин {composed('cyrillic', 'm', 1)} и госпожа {composed('cyrillic', 'f', 1)}; κυρία {composed('greek', 'f', 1)}", second)


def test_later_mentions_of_a_name(spark):
    text, other = one(spark, "Mr John Smith called. Smith said John was ill. Smithson's and Johnny's stay, Smith's not. Dr Jane Doe, Maria Garcia; Doe and Garcia agreed.", "Smith and Doe are unknown here.")
    assert other == "Smith and Doe are unknown here." and not re.search(r"\b(John|Smith|Jane|Doe|Maria|Garcia)\b", text)
    found = re.fullmatch(r"Mr (\w+) (\w+) called\. (\w+) said (\w+) was ill\. Smithson's and Johnny's stay, (\w+)'s not\. Dr (\w+) (\w+), (\w+) (\w+); (\w+) and (\w+) agreed\.", text)
    assert found[1] == found[4] and found[2] == found[3] == found[5] and found[7] == found[10] and found[9] == found[11]
    for k in (6, 8):
        assert re.fullmatch(composed("latin", "f", 0), found[k])


def test_accounts_tokens_keys_and_other_forms(spark):
    rest = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    token = "ghp_abcdEFGH0123456789abcdEFGH0123456789"
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIEabc+/9=\nxyz\n-----END RSA PRIVATE KEY-----"
    text, again = one(spark, f"020 7946 0958; (030) 123 4567; DE89370400440532013000; GB82 WEST 1234 5698 7654 32; 2001:db8::1; fe80:0:0:0:1:2:3:4; {token}", f"{key} DE89 3704 0044 0532 0130 00 at 12:30:45 std::vector DE00370400440532013000")
    phones, accounts = re.findall(r"0\d\d \d{4} \d{4}|\(0\d\d\) \d{3} \d{4}", text), re.findall(r"(?:DE|GB)[\dA-Z ]+\d", text)
    assert len(phones) == 2 and len(accounts) == 2 and all(rest(x.replace(" ", "")) == 1 for x in accounts) and re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", accounts[1])
    assert not any(x in text + again[:-24] for x in ("7946", "123 4567", "370400440532", "WEST", "2001:db8::1", "fe80", token, "MIIE"))
    assert re.search(r"; [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]; [0-9a-f]{4}(?::[0-9a-f]){7}; ghp_[a-zA-Z0-9]{36}$", text)
    assert re.match(r"-----BEGIN RSA PRIVATE KEY-----\n[A-Za-z]{7}\+/\d=\n[a-z]{3}\n-----END RSA PRIVATE KEY----- ", again)
    spaced = re.search(r"DE\d\d(?: \d{4}){4} \d\d", again)[0]
    assert spaced.replace(" ", "") == accounts[0] and again.endswith(" at 12:30:45 std::vector DE00370400440532013000")


def test_what_has_no_letters_to_change_is_replaced_too(spark):
    texts = ["password=========", "password: -------1", "sk-" + "-" * 20, "-----BEGIN PRIVATE KEY-----\n\n-----END PRIVATE KEY-----", "000 0000 0000"]
    got = one(spark, *texts)
    assert all(a != b for a, b in zip(texts, got, strict=True)) and got[0].startswith("password=") and got[3].startswith("-----BEGIN PRIVATE KEY-----")


def test_clean_texts_stay(spark):
    clean = ["", "On 2024-01-02 version 1.2.3 cost 1234.56", "a@b is no address", "4041894974608796 is no card", "the token was lost", "Mr. and Mrs.", "$1 \\1 [x] (y)"]
    assert one(spark, *clean) == clean


@pytest.mark.parametrize("literals", [1000, 2])
def test_collisions_are_resolved(spark, monkeypatch, literals):
    monkeypatch.setattr(pii, "EXCEPTIONS", literals)
    monkeypatch.setitem(pii.SYLLABLES, "latin", ("Ad Bo", "la le lo"))
    names = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(100, 220)]
    texts = [f"Mr {n.capitalize()}r wrote to Mr Adlaton." for n in names]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_entities int")
    table = entity_table(df, "key").collect()
    by_kind = defaultdict(list)
    for r in table:
        by_kind[r.type].append(r)
    for rows in by_kind.values():
        assert len({r.surrogate for r in rows}) == len(rows)
        assert not {r.surrogate.lower() for r in rows} & {r.norm.lower() for r in rows}
    assert max(r.attempt for r in table) > 0
    surrogate = {r.norm: r.surrogate for r in table}
    got = {r.doc_id: r.text for r in replace_pii(df, "key").collect()}
    assert got == {i: f"Mr {surrogate[n + 'r']} wrote to Mr {surrogate['adlaton']}." for i, n in enumerate(names)}


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.com"), (3, "a@b.com " * 3000), (4, "x"), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'match' as `match`", "1 as kind", "2 as found", "3 as `row`", "4 as key", "5 as `a.b`", "6 as __replaced")
    got = {(r.doc_id, r.n_entities) for r in replace_pii(df, "key").collect()}
    assert got == {(1, 0), (2, 0), (None, 1), (3, 3000), (4, 0)}
    row = replace_pii(df, "key").where("doc_id = 3").first()
    assert (row["match"], row["kind"], row["found"], row["row"], row["key"], row["a.b"], row["__replaced"]) == ("match", 1, 2, 3, 4, 5, 6)
    assert replace_pii(df, "key").count() == 6 and replace_pii(df.limit(0), "key").count() == 0
    assert replace_pii(df, "key").columns == ["doc_id", "text", "match", "kind", "found", "row", "key", "a.b", "__replaced", "n_entities"]
