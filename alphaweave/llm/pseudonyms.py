"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their own validation, and e-mail addresses, are replaced by a keyed permutation within
their format: a balanced walk of Feistel rounds whose round function is SHA-256 of the key, the round and the other
half. The permutation depends on the value and the key alone, so equal values stay equal across documents, different
ones stay different, and the holder of the key can turn them back (`restore=True`).

| kind  | validated by                        | permuted domain                                   | kept |
|-------|-------------------------------------|---------------------------------------------------|------|
| email | its form                            | letters and digits, each within its class         | signs, last label |
| iban  | remainder mod 97                    | account part, each character within its class     | country, spaces; check digits are made anew |
| ip    | four numbers up to 255              | 2**32 addresses                                   | dots |
| ssn   | area, group and serial in use       | the numbers in use                                | hyphens |
| date  | a day of the calendar, 1800 to 2199 | the 146,097 days                                  | order, signs, leading zeros |
| phone | ten digits, plan rules if they hold | numbers by the plan's rules, else all digits      | country code, signs |
| card  | 13 to 19 digits with a right check digit | all but the last digit                       | spaces, hyphens; the check digit is made anew |

What fails its validation stays as it is. A date with slashes whose first number cannot be a month is written day first
again; its pseudonym may then read month first too, so that one is not restored for certain, nor is a card right beside other numbers, whose digits may pass together with them. All of it is column expressions on one row: no shuffle, no Python on executors.

Defined results: a null text stays null, an empty one empty; repeated rows come out alike; an empty table gives no rows. Texts,
addresses and numbers of labels of any length are taken whole. Other columns are untouched, but for one of the name `kinds_in`
(`pii` unless set), which is replaced; without that name none is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "set your own key"
#: Countries by the length of their account numbers: a word after a number is no part of it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_BY_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![\p{{L}}\p{{N}}])" for n, c in IBAN_LENGTHS.items())
#: Runs of letters beyond ASCII that are turned within themselves: first and last code point.
LETTERS = (
    (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F), (0x5D0, 0x5EA),
    (0x621, 0x63A), (0x641, 0x64A), (0x904, 0x939), (0xE01, 0xE30), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
#: Digits and single signs in which cards are looked for, once the other kinds are taken out.
RUN = r"(?<![\p{L}\p{N}])[0-9][0-9\x20-]{12,}(?![\p{L}\p{N}])"
#: Patterns in order of precedence. None can begin within a longer run of its own characters.
PATTERNS = {
    # Flat classes, which take any number of labels without recursion.
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[\p{L}\p{N}-])[\p{L}\p{N}.-]*(?<=\.\p{L}{2,63})(?![\p{L}\p{N}-])",
    "iban": r"(?<![\p{L}\p{N}])(?:" + _BY_COUNTRY + r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![\p{L}\p{N}]))",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/-][0-9])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![\p{L}\p{N}+])\+[0-9]{1,3}[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
    "card": r"(?<![\p{L}\p{N}])[0-9](?:[\x20-]?[0-9]){12,18}(?![\p{L}\p{N}])",
}
#: Two characters that frame a match; an own first one in a text is written as the pair with ESCAPED until the end.
MARK, OPEN, ESCAPED = "\x01", "\x02", "\x03"


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number(text: Column) -> Column:
    return text.cast("long")


def _noise(key: str, kind: str, i: Column, half: Column) -> Column:
    """A number below 2**60 from the key, the kind, the round and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i, half).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def permute(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str, restore: bool) -> Column:
    """struct<l, r>: a keyed permutation of the pairs below (a, b). The rounds change one half by the other in turn."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))
    rounds = list(range(ROUNDS, 0, -1)) if restore else list(range(1, ROUNDS + 1))
    sign = -1 if restore else 1

    def turn(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        by = F.when(odd, _noise(key, kind, i, acc["r"]) % a).otherwise(_noise(key, kind, i, acc["l"]) % b)
        new_l, new_r = F.pmod(acc["l"] + sign * by, a), F.pmod(acc["r"] + sign * by, b)
        return F.struct(F.when(odd, new_l).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(new_r).alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _shifted(text: Column, by: Column, sign: int) -> Column:
    """Each ASCII letter or digit, and each letter of `LETTERS`, of `text` turned within its class by an amount that `by` and its place give."""

    def one(c: Column, j: Column) -> Column:
        code, amount = F.ascii(c), F.pmod(F.xxhash64(by, j), F.lit(1 << 30)).cast("int") * sign
        turned = lambda first, size: F.char(F.pmod(code - first + amount, F.lit(size)) + first)
        beyond = F.when(code < 128, c)
        for first, last in LETTERS:
            moved = F.pmod(code - first + amount, F.lit(last - first + 1)) + first
            beyond = beyond.when(code.between(first, last), F.decode(F.unhex(F.lpad(F.hex(moved), 4, "0")), "UTF-16BE"))
        return F.when(c.rlike("^[0-9]$"), turned(48, 10)).when(c.rlike("^[a-z]$"), turned(97, 26)).when(c.rlike("^[A-Z]$"), turned(65, 26)).otherwise(beyond.otherwise(c))

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def permute_text(left: Column, right: Column, key: str, kind: str, restore: bool) -> Column:
    """struct<l, r>: both strings permuted, every character within its class."""
    rounds = list(range(ROUNDS, 0, -1)) if restore else list(range(1, ROUNDS + 1))
    digest = lambda i, half: F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i, half).cast("binary"), 256)
    sign = -1 if restore else 1

    def turn(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        l = let(digest(i, acc["r"]), lambda d: _shifted(acc["l"], d, sign))  # noqa: E741
        r = let(digest(i, acc["l"]), lambda d: _shifted(acc["r"], d, sign))
        return F.struct(F.when(odd, l).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(r).alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), F.struct(left.alias("l"), right.alias("r")), turn)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def into_form(form: Column, new: Column) -> Column:
    """`form` with its digits replaced one by one by those of `new`."""
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        out = F.concat(acc["out"], F.when(is_digit, F.substring(new, acc["at"], F.lit(1))).otherwise(c))
        return F.struct(out.alias("out"), (acc["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(form, ""), zero, put, lambda acc: acc["out"])


def padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n.cast("double")).cast("long")


def check_digit(payload: Column) -> Column:
    """The digit that makes payload + digit pass the mod-10 check."""
    doubled = F.transform(F.reverse(F.split(payload, "")), lambda c, i: F.when(i % 2 == 0, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda s, x: s + x), F.lit(10)).cast("string")


def all_digits(d: Column, key: str, kind: str, restore: bool) -> Column:
    """A permutation of the digit strings of d's length, 36 digits at most."""
    u = F.floor(F.length(d) / 2).cast("int")
    p = permute(number(F.substring(d, F.lit(1), u)), number(F.substr(d, u + 1)), power(u), power(F.length(d) - u), key, kind, restore)
    return let(p, lambda p: F.concat(padded(p["l"], u), padded(p["r"], F.length(d) - u)))


def email(m: Column, key: str, restore: bool) -> Column:
    last = F.regexp_extract(m, r"\.[^.]*$", 0)
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    p = permute_text(local, F.substr(domain, F.lit(1), F.length(domain) - F.length(last)), key, "email", restore)
    return let(p, lambda p: F.concat(p["l"], F.lit("@"), p["r"], last))


def _mod97(account: Column, head: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))
    text = F.array_join(F.transform(F.split(F.concat(account, head), ""), value), "")
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: (r * 10 + c.cast("int")) % 97)


def iban(m: Column, key: str, restore: bool) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
    u = F.floor(F.length(account) / 2).cast("int")
    p = permute_text(F.substring(account, F.lit(1), u), F.substr(account, u + 1), key, "iban", restore)
    new = let(p, lambda p: F.concat(p["l"], p["r"]))
    whole = let(new, lambda n: F.concat(country, padded(98 - _mod97(n, F.concat(country, F.lit("00"))), 2), n))
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    spaced = lambda w: F.aggregate(F.split(m, ""), zero, lambda acc, c: F.struct(F.concat(acc["out"], F.when(c == " ", c).otherwise(F.substring(w, acc["at"], F.lit(1)))).alias("out"), (acc["at"] + (c != " ").cast("int")).alias("at")), lambda acc: acc["out"])
    valid = _mod97(account, F.substring(plain, 1, 4)) == 1
    return F.when(valid, let(whole, spaced)).otherwise(m)


def ip(m: Column, key: str, restore: bool) -> Column:
    part = F.transform(F.split(m, r"\."), number)
    p = permute(part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536, key, "ip", restore)
    dotted = let(p, lambda p: F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))
    return F.when(F.forall(part, lambda x: x <= 255), dotted).otherwise(m)


def ssn(m: Column, key: str, restore: bool) -> Column:
    area, group, serial = (number(F.substring(m, at, n)) for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = area - 1 - (area > 666).cast("int")
    p = permute(index, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", restore)
    area_of = lambda i: i + 1 + (i >= 665).cast("int")
    written = let(p, lambda p: F.concat_ws("-", padded(area_of(p["l"]), 3), padded(F.floor(p["r"] / 9999) + 1, 2), padded(p["r"] % 9999 + 1, 4)))
    return F.when(valid, written).otherwise(m)


def date(m: Column, key: str, restore: bool) -> Column:
    """Year first with hyphens; day first with dots; with slashes month first where that is a day, else day first."""
    year = lambda at: F.substring(m, at, 4)
    two = lambda at: F.substring(m, at, 2)
    iso, dotted = m.rlike("^[0-9]{4}-"), m.rlike(r"\.")
    month_first = m.rlike("^(0[1-9]|1[0-2])/(0[1-9]|[12][0-9]|3[01])/")
    plain = F.when(iso, m).when(dotted, F.concat_ws("-", year(7), two(4), two(1))).when(month_first, F.concat_ws("-", year(7), two(1), two(4))).otherwise(F.concat_ws("-", year(7), two(4), two(1)))
    n = F.datediff(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1800-01-01").cast("date"))
    p = permute(F.floor(n / 773), n % 773, 189, 773, key, "date", restore)
    day = let(p, lambda p: F.date_add(F.lit("1800-01-01").cast("date"), (p["l"] * 773 + p["r"]).cast("int")))
    form = F.when(iso, F.date_format(day, "yyyy-MM-dd")).when(dotted, F.date_format(day, "dd.MM.yyyy")).when(month_first, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return F.when((n >= 0) & (n < 146097), form).otherwise(m)


def phone(m: Column, key: str, restore: bool) -> Column:
    d = digits(m)
    code, own = F.substr(d, F.lit(1), F.length(d) - 10), F.right(d, F.lit(10))
    planned = own.rlike("^[2-9][0-9]{2}[2-9]")
    p = permute(number(F.substring(own, 1, 3)) - 200, number(F.substr(own, F.lit(4))) - 2_000_000, 800, 8_000_000, key, "phone", restore)
    by_plan = let(p, lambda p: F.concat((p["l"] + 200).cast("string"), (p["r"] + 2_000_000).cast("string")))
    # Numbers outside the plan are permuted among all digit strings with a first or fourth digit below 2 left in place.
    left, right = F.substring(own, 1, 4), F.substring(own, 5, 6)
    rest = F.concat(left, all_digits(right, key, "phone", restore))
    return into_form(m, F.concat(code, F.when(planned, by_plan).otherwise(rest)))


def card(m: Column, key: str, restore: bool) -> Column:
    d = digits(m)
    payload = F.substr(d, F.lit(1), F.length(d) - 1)
    new = let(all_digits(payload, key, "card", restore), lambda n: F.concat(n, check_digit(n)))
    return F.when(F.right(d, F.lit(1)) == check_digit(payload), into_form(m, new)).otherwise(m)


def cards(run: Column, key: str, restore: bool) -> Column:
    """struct<new, n> of a run of digits and signs: from left to right, the longest card that begins at a group of digits."""
    whole = f"^{PATTERNS['card']}$"

    def search(groups: Column) -> Column:
        # Digits at even places, signs at odd ones.
        n = F.floor((F.size(groups) + 1) / 2).cast("int")
        part = lambda i, j: F.array_join(F.slice(groups, 2 * i + 1, 2 * (j - i) + 1), "")
        after = lambda j: F.coalesce(F.get(groups, 2 * j + 1), F.lit(""))
        right = lambda m: F.when(m.rlike(whole), let(digits(m), lambda d: F.right(d, F.lit(1)) == check_digit(F.substr(d, F.lit(1), F.length(d) - 1)))).otherwise(False)

        def step(acc: Column, i: Column) -> Column:
            ends = F.filter(F.sequence(i, F.least(n - 1, i + 18)), lambda j: right(part(i, j)))
            state = lambda at, out, k: F.struct(at.alias("at"), out.alias("out"), k.alias("n"))
            take = lambda j: F.when(j < 0, state(i + 1, F.concat(acc["out"], part(i, i), after(i)), acc["n"])).otherwise(state(j + 1, F.concat(acc["out"], card(part(i, j), key, restore), after(j)), acc["n"] + 1))
            return F.when(i < acc["at"], acc).otherwise(let(F.coalesce(F.array_max(ends), F.lit(-1)), take))

        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda acc: F.struct(acc["out"].alias("new"), acc["n"].alias("n")))

    return let(F.split(run, "(?<=[0-9])(?=[\\x20-])|(?<=[\\x20-])(?=[0-9])"), search)


KINDS = {"email": email, "iban": iban, "ip": ip, "ssn": ssn, "date": date, "phone": phone}


def pseudonym(m: Column, key: str = KEY, restore: bool = False) -> Column:
    """struct<kind, new> of one match of any pattern but that of cards."""
    kind = F.lit(None).cast("string")
    new = m
    for name in reversed(KINDS):
        hit = m.rlike(f"^(?:{PATTERNS[name]})$")
        kind, new = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, KINDS[name](m, key, restore)).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymize(docs: DataFrame, key: str = KEY, text: str = "text", restore: bool = False, kinds_in: str | None = "pii") -> DataFrame:
    """`docs` with personal data in `text` replaced, and in a column `kinds_in`, if named, the kinds replaced, in order of place."""
    any_of = "|".join(f"(?:{PATTERNS[name]})" for name in KINDS)
    safe = F.replace(F.col(text), F.lit(MARK), F.lit(MARK + ESCAPED))
    cut = lambda s, pattern: F.split(F.regexp_replace(s, F.lit(pattern), F.lit(f"{MARK}{OPEN}$0{MARK}{OPEN}")), MARK + OPEN, -1)
    none = F.array().cast("array<string>")
    part = lambda kinds, new: F.struct(kinds.alias("kinds"), new.alias("new"))
    one = lambda s: let(pseudonym(s, key, restore), lambda p: part(F.when(p["new"] != s, F.array(p["kind"])).otherwise(none), p["new"]))
    run = lambda s, i: F.when(i % 2 == 1, let(cards(s, key, restore), lambda c: part(F.array_repeat(F.lit("card"), c["n"]), c["new"]))).otherwise(part(none, s))
    joined = lambda parts: part(F.flatten(F.transform(parts, lambda p: p["kinds"])), F.array_join(F.transform(parts, lambda p: p["new"]), ""))
    rest = lambda s: F.when(s.rlike(RUN), let(F.transform(cut(s, RUN), run), joined)).otherwise(part(none, s))
    parts = F.when(F.col(text).rlike("[0-9]|@"), F.transform(cut(safe, any_of), lambda s, i: F.when(i % 2 == 1, one(s)).otherwise(rest(s))))
    found = docs.withColumn("__parts", parts)
    whole = F.replace(F.array_join(F.transform("__parts", lambda p: p["new"]), ""), F.lit(MARK + ESCAPED), F.lit(MARK))
    kinds = F.flatten(F.transform("__parts", lambda p: p["kinds"]))
    new = {text: F.coalesce(whole, F.col(text))} | ({kinds_in: F.coalesce(kinds, none)} if kinds_in else {})
    return found.withColumns(new).drop("__parts")
