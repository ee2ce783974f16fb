"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, telephone numbers, IP addresses, payment cards and bank accounts (by
their check digits), social security numbers, access keys, tokens, private keys, assigned secrets, and
names: after a form of address, or a known given name before a family name. Once a name is found, its parts
are found wherever else they stand in the text. Each entity is replaced by a surrogate that a keyed digest
of its type and normal form decides: the same entity has the same surrogate in every text (a telephone
number also in another notation, a name also in part), and without the key none leads back. Surrogates
keep type, script, gender and format: digits stay digits in place, check digits stay valid, names are
composed from syllables by script and gender.

Texts are searched once: the rows with what was found in them are written to the shared folder. Whether
two entities of a type got one surrogate, or an entity got another that occurs, is checked over all texts
on a table of the distinct entities. The losers, found by aggregation, take further attempts until none is
left. Attempts beyond the first are the exceptions; while they are few they are literals of the plan,
beyond EXCEPTIONS they are joined to the texts that need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.storage import materialize, release_table

EXCEPTIONS = 1000
ROUNDS = 40

#: Forms of address by script and gender (n: either).
ADDRESS = {
    ("latin", "m"): "Mr|Mister|Herr|Herrn|Monsieur|Señor|Signor",
    ("latin", "f"): "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Signora",
    ("latin", "n"): "Dr|Doctor|Prof|Professor",
    ("cyrillic", "m"): "господин|Господин",
    ("cyrillic", "f"): "госпожа|Госпожа",
    ("greek", "m"): "κύριος|Κύριος",
    ("greek", "f"): "κυρία|Κυρία",
}
#: Given names by gender that make a name of the word after them.
KNOWN_GIVEN = {
    "m": "Adam Alexander Andreas Andrew Anthony Antonio Benjamin Carlos Charles Christian Christopher Daniel David Edward Frank George Giovanni Hans Henry James Jean Johann John Jonathan Jorge Joseph Juan Klaus Lars Luis Marco Matthew Michael Miguel Nicholas Patrick Paul Pedro Peter Pierre Richard Robert Samuel Stefan Steven Thomas Timothy Walter William Wolfgang",
    "f": "Alice Amanda Andrea Angela Anna Barbara Carmen Caroline Catherine Charlotte Christina Claudia Elena Elizabeth Emily Emma Francesca Hannah Heather Helen Ingrid Isabella Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lucia Margaret Maria Martha Mary Michelle Monika Nicole Olivia Patricia Rachel Rebecca Sabine Sandra Sarah Sofia Sophie Susan Teresa Ursula",
}
#: Syllables that names are made of: the first, those between, and the last by gender of given and family names.
SYLLABLES = {
    "latin": ("Al Ber Cor Da El Fen Gal Har Is Jor Kel Lo Mar Nor Or Per Quin Ros Sel Tam Ul Ver Wil Yor Zan Bra Cle Dro Fri Gre Ste Tri", "a be ci do e fa ga hi i ka le mi no o pe ra si ta u ve"),
    "cyrillic": ("Бо Ве Гра Да Жа За Ива Ка Ла Ми Не Оле Па Ро Са Ти Фе Ха Че Ша", "ба ва го до жи ли ма ни ра ро се та ти хо че"),
    "greek": ("Αλ Βα Γε Δη Ελ Ζα Θε Κα Λε Μα Νι Ορ Πα Ρο Σε Τι Φα Χρ", "βα γο δι ζα θε κα λι μα νο πε ρα σι τα φο"),
}
LAST = {
    ("latin", "m"): ("n r s rd l x m k rt nd lf ck", "ner sen ton ford well man ley berg feld ström holt wick"),
    ("latin", "f"): ("na la ra nia ria lia da ma sa ne tte line", "ner sen ton ford well man ley berg feld ström holt wick"),
    ("latin", "n"): ("ni ley ry dy len ron sey kim vin lou", "ner sen ton ford well man ley berg feld ström holt wick"),
    ("cyrillic", "m"): ("мир слав дан рин тон мил лен вид", "нов лев рин сов тов ков мин вин"),
    ("cyrillic", "f"): ("мира слава дана рина тона мила лена вида", "нова лева рина сова това кова мина вина"),
    ("greek", "m"): ("νης δης λος ρης σος τος κης ριος", "άκης ίδης ούλης όπουλος άτος ίου έας ώτης"),
    ("greek", "f"): ("νη δα λα ρα σα τη κη ρία", "άκη ίδου ούλη οπούλου άτου ίου έα ώτη"),
}

#: Runs of letters are taken whole: a repeated group would need as deep a stack as the run is long.
_NAME = r"\p{Lu}[\p{Ll}\p{Lu}]*+(?:[’'-]\p{Lu}[\p{Ll}\p{Lu}]*+){0,4}(?<=\p{Ll})"
_ADDRESSES = "|".join(x for v in ADDRESS.values() for x in v.split("|"))
_GIVEN_NAMES = "|".join(x for v in KNOWN_GIVEN.values() for x in v.split())
_ADDRESSED, _GIVEN_FIRST = rf"(?:{_ADDRESSES})\.? {_NAME}(?: {_NAME})?", rf"(?={_NAME} \p{{Lu}})(?:{_GIVEN_NAMES}) {_NAME}"
#: How tokens of well-known services begin.
_TOKENS = r"(?:gh[pousr]_|github_pat_|glpat-|sk-|[spr]k_live_|xox[abprs]-|AIza|ya29\.|hf_|npm_|eyJ)"
_SECRET_NAMES = r"password|passwd|pwd|secret|token|api[_ \-]?key|access[_ \-]?key"
#: What may stand before the name of a secret: words that end in _, - or . or before a capital (DB_PASSWORD, clientSecret).
_SECRET_PREFIX = r"(?:(?![A-Za-z0-9_\-]{0,127}\.\d)[A-Za-z_][A-Za-z0-9_.\-]{0,127}(?:(?<=[_.\-])|(?<=[a-z0-9])(?=[A-Z])))?"
#: In this order; where two match at one place the first counts.
PATTERNS = {
    "secret": rf"(?<![A-Za-z0-9_]){_SECRET_PREFIX}(?i:{_SECRET_NAMES})[\"']?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?[A-Za-z0-9+/=_.\-]{{8,}}+",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "token": rf"{_TOKENS}[A-Za-z0-9_\-.]{{16,}}+",
    "private_key": r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]{0,32}PRIVATE KEY-----",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f]{3,4}:)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "ssn": r"(?<![\w.\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w.+(\-])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\w\-])|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d){8,12}(?![\w\-])|(?<![\w.+(\-/])(?:\(0\d{2,4}\)|0\d{2,4})[ /\-]\d{3,4}[ \-]?\d{3,4}(?![\w\-/])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w.\-])\d(?:(?:[ \-](?!\d{1,3}\.\d))?\d){12,18}(?![\w\-])",
    "name": rf"(?<!\p{{L}})(?:{_ADDRESSED}|{_GIVEN_FIRST})",
}
#: All of them in one. What all demand of a place, and the first letters of each, is looked at first.
_NAMES_BEGIN = "[" + "".join(sorted({x[0] for v in (_ADDRESSES, _GIVEN_NAMES) for x in v.split("|")})) + "]"
_FIRST = {"secret": "[A-Za-z_]", "email": "[A-Za-z0-9._%+\\-]", "token": "[A-Zaeghnprsxy]", "private_key": "-----BEGIN", "iban": "[A-Z][A-Z][0-9]", "ipv6": "[0-9A-Fa-f]{1,4}:", "key": "A", "ssn": "[0-9]", "phone": "[0-9(+]", "ip": "[0-9]", "card": "[0-9]", "name": _NAMES_BEGIN}
_PARTS = {kind: f"(?={_FIRST[kind]})(?:{p})" for kind, p in PATTERNS.items()}
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(_PARTS.values()) + ")"
#: ANY without cards, in two parts: what goes before them and what after. Cards are put between for each text that has RUN.
_BEFORE_CARDS = "(?<![A-Za-z0-9])(?:" + "|".join(p for kind, p in _PARTS.items() if kind not in ("card", "name"))
_AFTER_CARDS = f"|{_PARTS['name']})"
#: Groups of digits with single spaces or dashes between; a short group before a point is of another number.
_GROUP = r"(?!\d{1,3}\.\d)\d++(?![A-Za-z_])"
RUN = rf"(?<![\w.\-])(?=\d(?:[ \-]?\d){{12}}){_GROUP}(?:[ \-]{_GROUP})*(?![\w\-])"
#: The groupings in which cards are written, the longer first. A valid one counts wherever it is in a run.
GROUPINGS = (r"\d{13,19}", r"\d{4}(?:[ \-]\d{4}){3}[ \-]\d{3}", r"\d{4}(?:[ \-]\d{4}){3}", r"\d{4}[ \-]\d{6}[ \-]\d{5}", r"\d{4}[ \-]\d{6}[ \-]\d{4}")


def _digest(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    inner = F.sha2(F.concat(F.lit(key + "|"), kind, F.lit("|"), norm, F.lit("|"), attempt.cast("string")).cast("binary"), 256)
    return F.sha2(F.concat(F.lit(key + "|"), inner).cast("binary"), 256)


def _digits(digest: Column) -> Column:
    return F.translate(digest, "abcdef", "294750")


def _letters(digest: Column) -> Column:
    return F.translate(digest, "0123456789abcdef", "kqwertzpasdfghmn")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _join(parts: Column) -> Column:
    return F.array_join(parts, "")


def _number(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def _refill(text: Column, signs: Column, kept: str = "0-9") -> Column:
    """What of text is in the class `kept` replaced, the last by the last of signs and so on; the rest stays."""
    after = lambda i: F.length(F.regexp_replace(F.substring(text, i + 1, F.length(text)), f"[^{kept}]", ""))
    return _join(F.transform(_chars(text), lambda c, i: F.when(c.rlike(f"^[{kept}]$"), F.substring(signs, F.length(signs) - after(i) + 1, F.lit(1))).otherwise(c)))


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """Of a number without its check digit: what the check digit must complete to a multiple of ten."""
    one = lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.reverse(_chars(digits)), one), F.lit(0), lambda a, x: a + x)


def _check_digit(digits: Column) -> Column:
    return F.pmod(-_luhn_sum(digits), F.lit(10)).cast("string")


def _is_valid(number: Column) -> Column:
    digits = _only_digits(number)
    return F.substring(digits, F.length(digits), F.lit(1)) == _check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1))


def _account_rest(account: Column) -> Column:
    """The remainder by 97 of an account number whose country and check digits are moved to its end."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.aggregate(F.transform(_chars(moved), value), F.lit(0), lambda a, x: F.pmod(a * F.when(x > 9, 100).otherwise(10) + x, F.lit(97)))


def _account(text: Column) -> Column:
    return F.replace(text, F.lit(" "))


def _reshape(text: Column, digest: Column) -> Column:
    """Letters to letters of the same case, digits to digits, the rest in place."""
    letters, digits = _letters(digest), _digits(digest)
    at = lambda s, i: F.substring(s, F.pmod(i * 7, F.lit(64)) + 1, F.lit(1))
    return _join(F.transform(_chars(text), lambda c, i: F.when(c.rlike("^[a-z]$"), at(letters, i)).when(c.rlike("^[A-Z]$"), F.upper(at(letters, i))).when(c.rlike("^[0-9]$"), at(digits, i)).otherwise(c)))


def _reshape_all(text: Column, digest: Column) -> Column:
    """The same, but letters throughout where text has too few letters and digits to become another."""
    many = F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) >= 8
    letters = F.substring(F.repeat(_letters(digest), 1 + F.floor(F.length(text) / 64).cast("int")), F.lit(1), F.greatest(F.length(text), F.lit(16)))
    return F.when(many, _reshape(text, digest)).otherwise(letters)


def _pick(words: str, number: Column) -> Column:
    listed = words.split()
    return F.get(F.array(*map(F.lit, listed)), F.pmod(number, F.lit(len(listed))).cast("int"))


def _name_of(script: str, last: str, h: Column, attempt: Column) -> Column:
    """A name of syllables that the digest picks; later attempts are longer, so that enough names exist."""
    first, between = SYLLABLES[script]
    inner = F.transform(F.sequence(F.lit(0), F.floor(attempt / 2).cast("int")), lambda i: _pick(between, _number(F.sha2(F.concat(h, i.cast("string")).cast("binary"), 256), 1, 8)))
    return F.concat(_pick(first, _number(h, 1, 8)), _join(inner), _pick(last, _number(h, 11, 8)))


def kind_of(match: Column) -> Column:
    """The type of a match; null for runs whose check digits are wrong. Parts of names alone have none here."""
    out = F.when(F.lit(False), "")
    for kind, pattern in PATTERNS.items():
        whole = match.rlike(f"^(?:{pattern})$")
        if kind == "card":
            out = out.when(whole, F.when(_is_valid(match), "card"))
        elif kind == "iban":
            out = out.when(whole, F.when(_account_rest(_account(match)) == 1, "iban"))
        elif kind == "name":
            for (script, gender), address in ADDRESS.items():
                if gender != "n":
                    out = out.when(match.rlike(rf"^(?:{address})\.? "), f"name_{script}_{gender}")
            address = ADDRESS["latin", "n"]
            for gender, given in KNOWN_GIVEN.items():
                out = out.when(match.rlike(rf"^(?:(?:{address})\.? )?(?:{'|'.join(given.split())}) \p{{Lu}}"), f"name_latin_{gender}")
            out = out.when(match.rlike(rf"^(?:{address})\.? "), "name_latin_n")
        else:
            out = out.when(whole, kind)
    return out


def _name_parts(match: Column) -> tuple[Column, Column]:
    """The form of address with the space after it, or nothing; and one or two names."""
    head = F.regexp_extract(match, rf"^((?:{_ADDRESSES})\.? )", 1)
    return head, F.split(F.substring(match, F.length(head) + 1, F.length(match)), " ")


def _name_types(kind: Column) -> tuple[Column, Column]:
    """Types of the given and the family name. A Latin family name is the same whatever the gender."""
    return F.concat(kind, F.lit("_given")), F.when(kind.startswith("name_latin"), "name_latin_n_family").otherwise(F.concat(kind, F.lit("_family")))


def _secret_parts(match: Column) -> tuple[Column, Column]:
    head = F.regexp_extract(match, r"^([^=:]*[=:][ \t]*[\"']?)", 1)
    return head, F.substring(match, F.length(head) + 1, F.length(match))


def entities_of(match: Column, kind: Column) -> Column:
    """Array of (type, norm): what of a match has surrogates of its own; names have a given and a family name."""
    entity = lambda t, n: F.struct(t.alias("type"), n.alias("norm"))
    names = _name_parts(match)[1]
    given_type, family_type = _name_types(kind)
    family = entity(family_type, F.lower(F.get(names, F.size(names) - 1)))
    given = entity(given_type, F.lower(F.get(names, F.lit(0))))
    digits = _only_digits(match)
    plain = F.regexp_replace(digits, "^0+", "")
    subscriber = F.when(plain == "", digits).otherwise(plain)
    norm = (
        F.when(kind == "secret", _secret_parts(match)[1])
        .when(kind == "email", F.lower(match))
        .when(kind == "phone", F.substring(subscriber, F.greatest(F.length(subscriber) - 9, F.lit(1)), F.lit(10)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", _account(match))
        .when(kind == "ipv6", F.lower(match))
        .otherwise(match)
    )
    return F.when(kind.isNull(), F.array().cast("array<struct<type:string,norm:string>>")).when(kind.startswith("name_"), F.when(F.size(names) > 1, F.array(given, family)).otherwise(F.array(family))).otherwise(F.array(entity(kind, norm)))


def surrogate_norm(key: str, kind: Column, norm: Column, attempt: Column, h: Column) -> Column:
    """The surrogate of a normal form, itself in normal form; h is the digest of all three."""
    digits = _digits(h)
    ten = F.concat((F.pmod(_number(h, 1, 6), F.lit(8)) + 2).cast("string"), F.substring(digits, 8, 2), (F.pmod(_number(h, 20, 6), F.lit(8)) + 2).cast("string"), F.substring(digits, 30, 6))
    card = F.concat(F.substring(norm, 1, 1), F.substring(digits, F.lit(1), F.length(norm) - 2))
    local = F.substring_index(norm, "@", 1)
    longer = F.when(F.length(local) < 8, F.concat(local, F.substring(F.lit("aaaaaaaa"), F.lit(1), F.lit(8) - F.length(local)))).otherwise(local)
    domain = F.sha2(F.concat(F.lit(key + "|domain|"), F.substring_index(norm, "@", -1)).cast("binary"), 256)
    email = F.concat(_reshape(longer, h), F.lit("@"), F.substring(_letters(domain), 1, 8), F.lit(".example."), _pick("com net org", _number(domain, 20, 6)))
    octet = lambda i, n: (F.pmod(_number(h, i, 8), F.lit(n)) + 1).cast("string")
    country, rest = F.substring(norm, 1, 2), _reshape(F.substring(norm, F.lit(5), F.length(norm)), h)
    check = F.lpad((98 - _account_rest(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    # hexadecimal digits in place; the first group has no zero before
    hexes_of = lambda text: _join(F.transform(_chars(text), lambda c, i: F.when(c == ":", c).when(i == 0, F.lit("2")).otherwise(F.substring(h, i + 1, F.lit(1)))))
    mark = F.regexp_extract(norm, rf"^({_TOKENS}|-----BEGIN [A-Z ]*-----)", 1)
    end = F.regexp_extract(norm, r"(-----END [A-Z ]*-----)$", 1)
    body = F.substring(norm, F.length(mark) + 1, F.length(norm) - F.length(mark) - F.length(end))
    hexes = F.when(norm.rlike("^[0-9a-f]+$"), F.substring(F.repeat(h, 1 + F.floor(F.length(norm) / 64).cast("int")), F.lit(1), F.length(norm)))
    out = (
        F.when(kind == "secret", F.coalesce(hexes, _reshape_all(norm, h)))
        .when(kind == "email", email)
        .when(kind == "key", F.concat(F.substring(norm, 1, 4), F.upper(F.substring(h, 1, 16))))
        .when(kind.isin("token", "private_key"), F.concat(mark, _reshape_all(body, h), end))
        .when(kind == "iban", F.concat(country, check, rest))
        .when(kind == "ipv6", hexes_of(norm))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(digits, 1, 8)))
        .when(kind == "phone", F.substring(ten, F.lit(11) - F.length(norm), F.length(norm)))
        .when(kind == "ip", F.concat_ws(".", octet(1, 223), octet(11, 254), octet(21, 254), octet(31, 254)))
        .when(kind == "card", F.concat(card, _check_digit(card)))
    )
    for (script, gender), (given, family) in LAST.items():
        name = f"name_{script}_{gender}"
        out = out.when(kind == f"{name}_given", _name_of(script, given, h, attempt)).when(kind == f"{name}_family", _name_of(script, family, h, attempt))
    return out


def _surrogate(match: Column, kind: Column, norms: Column) -> Column:
    """The text that replaces a match of entities whose surrogates are norms."""
    first = F.get(norms, F.lit(0))
    digits = _only_digits(match)
    return (
        F.when(kind.isNull(), match)
        .when(kind == "secret", F.concat(_secret_parts(match)[0], first))
        .when(kind == "phone", _refill(match, F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(first)), first)))
        .when(kind.isin("card", "ssn"), _refill(match, first))
        .when(kind == "iban", _refill(match, first, "A-Z0-9"))
        .when(kind.startswith("name_"), F.concat(_name_parts(match)[0], F.array_join(norms, " ")))
        .otherwise(first)
    )


def _replaced(key: str, found: Column, attempt_of) -> Column:
    """Array of (kind, text) for what was found in a text. Each step stores what later ones use several times."""
    tried = lambda x: F.transform(x["found"], lambda e: F.struct(e["type"].alias("type"), e["norm"].alias("norm"), attempt_of(e).alias("attempt")))
    keyed = lambda x: F.transform(tried(x), lambda e: F.struct(e["type"].alias("type"), e["norm"].alias("norm"), e["attempt"].alias("attempt"), _digest(key, e["type"], e["norm"], e["attempt"]).alias("h")))
    norms = lambda x: F.transform(keyed(x), lambda e: surrogate_norm(key, e["type"], e["norm"], e["attempt"], e["h"]))
    named = F.transform(found, lambda x: F.struct(x["match"].alias("match"), x["kind"].alias("kind"), norms(x).alias("norms")))
    return F.transform(named, lambda x: F.struct(x["kind"].alias("kind"), _surrogate(x["match"], x["kind"], x["norms"]).alias("text")))


def _one_of(cards: Column) -> Column:
    """A pattern of these cards; null if there are none."""
    return F.when(F.size(cards) > 0, F.concat(F.lit(r"(?:(?<![\w.\-])|(?<=\d-))(?:"), F.array_join(cards, "|"), F.lit(r")(?!\w|-(?!\d))")))


def _cards(text: Column) -> Column:
    """The valid cards of a text that has a run of so many digits.

    Numbers beside a card are no part of it: valid cards in one of GROUPINGS come first. A run between them
    whose digits are grouped in another way is a card if it is valid as a whole. Runs that are no cards are
    not passed over, so what else is in them is found.
    """
    written = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda run: F.concat(*(F.regexp_extract_all(run, F.lit(rf"(?<!\d)(?=({g})(?!\d))"), F.lit(1)) for g in GROUPINGS))))
    grouped = F.array_distinct(F.filter(written, _is_valid))

    def with_others(cards: Column) -> Column:
        known = _one_of(cards)
        stop = F.coalesce(F.concat(F.lit("(?!"), known, F.lit(")")), F.lit(""))
        run = F.concat(F.lit(r"(?<![\w.\-])\d(?:(?:[ \-](?!\d{1,3}\.\d)"), stop, F.lit(r")?\d){12,18}(?![\w\-])"))
        found = F.regexp_extract_all(text, F.concat(F.lit(_BEFORE_CARDS), F.coalesce(F.concat(F.lit("|"), known), F.lit("")), F.lit("|"), run, F.lit(_AFTER_CARDS)), F.lit(0))
        return F.array_distinct(F.concat(cards, F.filter(found, lambda m: F.coalesce(kind_of(m) == "card", F.lit(False)))))

    # a lambda each, so that what is found once is not computed again where it is used
    return F.flatten(F.transform(F.array(grouped), with_others))


#: What a text is searched with, and what is found in it.
FOUND = "array<struct<match:string,kind:string,found:array<struct<type:string,norm:string>>>>"


def _names_in(found: Column) -> Column:
    """Array of (part, entity): the parts of the names found, each once."""
    names = F.filter(found, lambda x: F.coalesce(x["kind"].startswith("name_"), F.lit(False)))
    parts = F.flatten(F.transform(names, lambda x: F.transform(F.arrays_zip(_name_parts(x["match"])[1].alias("part"), x["found"].alias("entity")), lambda y: F.struct(y["part"].alias("part"), y["entity"].alias("entity")))))
    return F.array_distinct(parts)


def search(df: DataFrame, text_col: str = "text") -> DataFrame:
    """row (a struct of all columns of df), key (of the row), pattern (what found is found with: null stands
    for ANY) and found (match, kind, entities), in a table in the shared folder. Texts are read once; a text
    with runs of digits like cards, or with names, is searched again with a pattern of its own.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.struct(*columns).alias("row"), F.col(f"`{text_col}`").alias("text"))
    detail = lambda kind, m, entities: F.struct(m.alias("match"), kind.alias("kind"), entities.alias("found"))

    def found(matches: Column) -> Column:
        kinds = F.transform(matches, lambda m: F.struct(m.alias("match"), kind_of(m).alias("kind")))
        return F.transform(kinds, lambda x: detail(x["kind"], x["match"], entities_of(x["match"], x["kind"]))).cast(FOUND)

    cards = F.when(F.col("text").rlike(RUN), _cards(F.col("text")))
    between = F.when(F.col("cards").isNotNull(), F.coalesce(F.concat(F.lit("|"), _one_of(F.col("cards"))), F.lit(""))).otherwise("|" + _PARTS["card"])
    rows = rows.withColumn("cards", cards).withColumn("own", F.when(F.col("cards").isNotNull(), F.concat(F.lit(_BEFORE_CARDS), between, F.lit(_AFTER_CARDS))))
    matches = F.when(F.col("own").isNull(), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.regexp_extract_all("text", "own", F.lit(0)))
    rows = rows.withColumn("matches", matches).withColumn("first", F.when(F.size("matches") > 0, found(F.col("matches"))).otherwise(F.array().cast(FOUND)))
    rows = rows.withColumn("names", F.when(F.exists("first", lambda x: F.coalesce(x["kind"].startswith("name_"), F.lit(False))), _names_in(F.col("first"))))
    # longer parts first, so that none hides in another
    parts = F.array_join(F.transform(F.reverse(F.array_sort(F.transform("names", lambda x: F.struct(F.length(x["part"]).alias("n"), x["part"].alias("part"))))), lambda x: x["part"]), "|")
    mentions = F.concat(F.lit("|(?<![\\p{L}\\p{N}])(?:"), parts, F.lit(")(?![\\p{L}\\p{N}])"))
    pattern = F.when(F.col("names").isNotNull(), F.concat(F.lit(_BEFORE_CARDS), between, F.regexp_replace(F.lit(_AFTER_CARDS), r"\)$", ""), mentions, F.lit(")"))).otherwise(F.col("own"))
    rows = rows.withColumn("pattern", pattern)

    def with_mentions(x: Column) -> Column:
        part = F.get(F.filter("names", lambda n: n["part"] == x["match"]), F.lit(0))
        return F.when(x["kind"].isNull() & part.isNotNull(), detail(F.lit("name_part"), x["match"], F.array(part["entity"]))).otherwise(x)

    again = F.transform(found(F.regexp_extract_all("text", "pattern", F.lit(0))), with_mentions)
    rows = rows.withColumn("found", F.when(F.col("names").isNotNull(), again).otherwise(F.col("first")))
    # a number for each row, which stays since it is written
    return materialize(rows.select("row", F.monotonically_increasing_id().alias("key"), "pattern", "found"), "found")


def entity_table(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """type, norm, surrogate, attempt of each distinct entity of df: see entities_in()."""
    return entities_in(search(df, text_col), key)


def entities_in(searched: DataFrame, key: str) -> DataFrame:
    """type, norm, surrogate, attempt of each distinct entity; surrogates of a type are distinct and differ
    from all entities of the type. A table in the shared folder.
    """
    found = searched.select(F.explode(F.flatten(F.transform("found", lambda x: x["found"]))).alias("e"))
    distinct = found.select("e.*").distinct()
    columns = [F.col(c) for c in ("type", "norm", "attempt", "h")]
    chosen = lambda rows: rows.withColumn("h", _digest(key, *columns[:3])).withColumn("surrogate", surrogate_norm(key, *columns)).drop("h")
    named = materialize(chosen(distinct.withColumn("attempt", F.lit(0))), "entities")
    for _ in range(ROUNDS):
        # of entities with one surrogate the one with the least attempt keeps it: earlier choices stay
        shared = named.groupBy("type", "surrogate").agg(F.min(F.struct("attempt", "norm")).alias("keeps"), F.count("*").alias("n")).where("n > 1").select("type", "surrogate", F.col("keeps.norm").alias("keeper"))
        given = named.select("type", F.lower("norm").alias("surrogate"), F.lit("").alias("keeper"))
        real = named.select("type", "surrogate").join(given.select("type", F.col("surrogate").alias("low")), (F.lower("surrogate") == F.col("low")) & (named["type"] == given["type"]), "left_semi").distinct().withColumn("keeper", F.lit(None).cast("string"))
        taken = materialize(shared.unionByName(real).groupBy("type", "surrogate").agg(F.count_if(F.col("keeper").isNull()).alias("real"), F.max("keeper").alias("keeper")), "taken")
        if taken.isEmpty():
            return named
        lost = F.col("real").isNotNull() & ((F.col("real") > 0) | (F.col("norm") != F.col("keeper")))
        next_attempt = F.when(lost, F.col("attempt") + 1).otherwise(F.col("attempt"))
        named = materialize(chosen(named.join(taken, ["type", "surrogate"], "left").select("type", "norm", next_attempt.alias("attempt"))), "entities")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def replace_pii(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """df with surrogates in text_col, and n_entities (long): how many places were replaced.

    A null text stays null and has none; an empty text stays empty; repeated rows are kept and get equal
    surrogates; an empty table stays empty. Other columns, whatever their names, are kept; n_entities, if
    df has it, is replaced. Texts are rewritten where they are; only entities are shuffled.
    """
    df = df.drop("n_entities")
    searched = search(df, text_col)
    named = entities_in(searched, key)
    name = lambda e: F.concat(e["type"], F.lit("|"), e["norm"])
    exceptions = named.where("attempt > 0").select(name({"type": F.col("type"), "norm": F.col("norm")}).alias("name"), "attempt")
    few = exceptions.limit(EXCEPTIONS + 1).collect()
    rows = searched
    if not few:
        attempt_of = lambda e: F.lit(0)
    elif len(few) <= EXCEPTIONS:
        known = F.map_from_arrays(F.array(*(F.lit(r.name) for r in few)), F.array(*(F.lit(r.attempt) for r in few)))
        attempt_of = lambda e: F.coalesce(known[name(e)], F.lit(0))
    else:
        mentions = searched.select("key", F.explode(F.flatten(F.transform("found", lambda x: x["found"]))).alias("e")).select("key", name(F.col("e")).alias("name")).distinct()
        by_row = materialize(mentions.join(exceptions, "name").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("attempts")), "attempts")
        rows = searched.join(by_row, "key", "left")
        attempt_of = lambda e: F.coalesce(F.col("attempts")[name(e)], F.lit(0))
    if not few or len(few) <= EXCEPTIONS:
        release_table(named)
    rows = rows.withColumn("text", F.col(f"row.`{text_col}`")).withColumn("replaced", F.when(F.size("found") > 0, _replaced(key, F.col("found"), attempt_of)))
    between = F.when(F.col("pattern").isNull(), F.split("text", ANY)).otherwise(F.split("text", F.col("pattern")))
    whole = _join(F.transform(between, lambda g, i: F.concat(g, F.coalesce(F.get("replaced", i)["text"], F.lit("")))))
    counted = F.coalesce(F.size(F.filter("replaced", lambda x: x["kind"].isNotNull())), F.lit(0)).cast("long")
    text = F.when(F.col("replaced").isNull(), F.col("text")).otherwise(whole)
    return rows.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns), counted.alias("n_entities"))
