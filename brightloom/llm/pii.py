"""Format-preserving pseudonyms for personal data, with DataFrame operations only.

Validated numbers, dates and mail names in a text are replaced by keyed permutations of themselves within their own
format, so equal values stay equal across all documents and every pseudonym passes the same validation:

  kind   found if                                          permuted
  email  a mail address                                    letters and digits of the name, each within its class
  iban   check digits right (mod 97)                       account part within its classes; check digits made anew
  card   13-19 digits, plain or in groups, Luhn holds      all digits but the first and the check digit, made anew
  ssn    ddd-dd-dddd in the issued ranges                  within the issued ranges
  date   a calendar day of 1900-2099, three formats        the day's number among those 73,049 days
  ipv4   four octets up to 255                             all 32 bits
  phone  ten digits of the North American plan             within the plan's ranges
  intl   + and 8-15 digits in groups                       all digits after the first two

The permutations are unbalanced Feistel networks over pairs (l, r) of Z_a x Z_b, or over the two halves of a string
with an addition for each character: no table, no state and nothing to gather, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import dealt, packed, unpacked

ROUNDS = 8
#: Callers pass a secret of their own.
KEY = "pseudonym-key-1"

EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
INTL = r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,5}){2,5}(?![0-9])"
KINDS = {"email": EMAIL, "iban": IBAN, "card": CARD.replace(r"([ -])", "(?<sep>[ -])").replace(r"\1", r"\k<sep>"), "ssn": SSN, "date": DATE, "ipv4": IPV4, "phone": PHONE, "intl": INTL}
#: Longest stretches from a place on, of which a value can be any part up to a border of its groups.
STRETCHES = {"iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "intl": r"(?<![0-9+])\+[1-9](?:[ .-]?[0-9]){7,14}(?![0-9])"}
#: What holds before and after a value of each kind.
BORDERS = {
    "iban": (r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"), "card": (r"(?<![0-9])", r"(?![0-9])"), "ssn": (r"(?<![0-9-])", r"(?![0-9-])"), "date": (r"(?<![0-9./-])", r"(?![0-9]|[./-][0-9])"),
    "ipv4": (r"(?<![0-9.])", r"(?![0-9]|\.[0-9])"), "phone": (r"(?<![0-9+])", r"(?![0-9])"), "intl": (r"(?<![0-9+])", r"(?![0-9])"),
}
DAYS = 73_049
FIRST_DAY = "1900-01-01"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def _noise(key: str, kind: str, turn: Column, value: Column) -> Column:
    """A number of 60 bits from the key, the kind, the round and the other half."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel_pair(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of Z_a x Z_b, as struct(l, r)."""

    def step(acc: Column, turn: Column) -> Column:
        first = turn % 2 == 1
        l = F.when(first, (acc["l"] + _noise(key, kind, turn, acc["r"]) % a) % a).otherwise(acc["l"])  # noqa: E741
        r = F.when(first, acc["r"]).otherwise((acc["r"] + _noise(key, kind, turn, acc["l"]) % b) % b)
        return F.struct(l.alias("l"), r.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _shifted(char: Column, by: Column) -> Column:
    """The character moved within its class (0-9, a-z, A-Z); any other stays."""
    code = F.ascii(char)
    move = lambda base, n: F.char((code - base + by) % n + base)
    return F.when(char.rlike("^[0-9]$"), move(48, 10)).when(char.rlike("^[a-z]$"), move(97, 26)).when(char.rlike("^[A-Z]$"), move(65, 26)).otherwise(char)


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of the same classes of characters, of up to 64 characters."""
    half = F.floor(F.length(text) / 2).cast("int")

    def step(acc: Column, turn: Column) -> Column:
        stream = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), turn.cast("string"), acc["r"]), 512)
        number = lambda s, i: F.conv(F.substr(s, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        chars = F.filter(F.split(acc["l"], ""), lambda c: c != "")
        added = F.array_join(_once(stream, lambda s: F.transform(chars, lambda c, i: _shifted(c, number(s, i)))), "")
        return F.struct(acc["r"].alias("l"), added.alias("r"))

    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Sum of the digits from the right; positions doubled_from, doubled_from + 2, ... count twice (digits added)."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    valued = F.transform(chars, lambda c, i: F.when(i % 2 == doubled_from % 2, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(valued, F.lit(0), lambda acc, x: acc + x)


def _mod97(text: Column) -> Column:
    """The number of an IBAN with its first four characters last, letters as 10-35, modulo 97."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda acc, c: F.when(c.rlike("^[0-9]$"), acc * 10 + value(c)).otherwise(acc * 100 + value(c)) % 97)


def _refilled(shape: Column, chars: Column, slot: str) -> Column:
    """``shape`` with its characters of the class ``slot`` replaced by those of ``chars``, in order."""
    pieces = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(made: Column, acc: Column, c: Column) -> Column:
        takes = c.rlike(slot)
        return F.struct(
            F.concat(acc["out"], F.when(takes, F.substr(made, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + takes.cast("int")).alias("at"),
        )

    return _once(chars, lambda made: F.aggregate(pieces, start, lambda acc, c: step(made, acc, c), lambda acc: acc["out"]))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    name = F.substring_index(m, "@", 1)
    return F.lit(True), F.concat(feistel_text(name, key, "email"), F.substr(m, F.length(name) + 1))


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substr(plain, F.lit(1), F.lit(2))
    checked = lambda account: F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
    made = _once(feistel_text(F.substr(plain, F.lit(5)), key, "iban"), checked)
    return (F.length(plain).between(15, 34)) & (_mod97(plain) == 1), _refilled(m, made, "[A-Z0-9]")


def _card(m: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(m)
    n = F.length(digits)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), feistel_text(F.substr(digits, F.lit(2), n - 2), key, "card"))
    made = _once(body, lambda body: F.concat(body, ((10 - _luhn_sum(body, 0) % 10) % 10).cast("string")))
    return n.between(13, 19) & (_luhn_sum(digits, 1) % 10 == 0) & ~digits.rlike("^0+$"), _refilled(m, made, "[0-9]")


def _area(p: Column) -> Column:
    return F.floor(p["l"] / 99)


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 0..897
    p = feistel_pair(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
    return ok, _once(p, lambda p: F.format_string("%03d-%02d-%04d", F.when(_area(p) >= 665, _area(p) + 2).otherwise(_area(p) + 1), p["l"] % 99 + 1, p["r"] + 1))


def _date(m: Column, key: str) -> tuple[Column, Column]:
    pattern = F.when(m.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(m.rlike(r"\."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    year, month, day = (
        F.when(m.rlike("^[0-9]{4}-"), F.substring(m, *iso)).when(m.rlike(r"\."), F.substring(m, *dots)).otherwise(F.substring(m, *slash)).cast("int")
        for iso, dots, slash in (((1, 4), (7, 4), (7, 4)), ((6, 2), (4, 2), (1, 2)), ((9, 2), (1, 2), (4, 2)))
    )
    as_date = F.call_function("try_to_date", F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd"))
    number = F.datediff(as_date, F.lit(FIRST_DAY).cast("date"))
    p = feistel_pair(F.floor(number / 229), number % 229, 319, 229, key, "date")
    made = _once(p, lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * 229 + p["r"]).cast("int")), "yyyy-MM-dd"))

    def shown(made: Column) -> Column:
        y, mo, d = F.substring(made, 1, 4), F.substring(made, 6, 2), F.substring(made, 9, 2)
        return F.when(pattern == "yyyy-MM-dd", made).when(pattern == "dd.MM.yyyy", F.concat_ws(".", d, mo, y)).otherwise(F.concat_ws("/", mo, d, y))

    return F.coalesce(number.between(0, DAYS - 1), F.lit(False)), _once(made, shown)


def _ipv4(m: Column, key: str) -> tuple[Column, Column]:
    o = [F.split(m, r"\.")[i].cast("int") for i in range(4)]
    p = feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4")
    return F.greatest(*o) <= 255, _once(p, lambda p: F.concat_ws(".", *[x.cast("string") for h in (p["l"], p["r"]) for x in (F.floor(h / 256), h % 256)]))


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    digits = F.right(_digits(m), F.lit(10))
    area, exchange, line = F.substring(digits, 1, 3).cast("int"), F.substring(digits, 4, 3).cast("int"), F.substring(digits, 7, 4).cast("int")
    p = feistel_pair((area - 200) * 800 + exchange - 200, line, 640_000, 10_000, key, "phone")
    plan = _once(p, lambda p: F.format_string("%03d%03d%04d", F.floor(p["l"] / 800) + 200, p["l"] % 800 + 200, p["r"]))
    made = F.concat(F.when(F.length(_digits(m)) == 11, "1").otherwise(""), plan)
    return (area >= 200) & (exchange >= 200), _refilled(m, made, "[0-9]")


def _intl(m: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(m)
    made = F.concat(F.substring(digits, 1, 2), feistel_text(F.substr(digits, F.lit(3)), key, "intl"))
    return F.length(digits).between(8, 15), _refilled(m, made, "[0-9]")


_RULES: dict[str, Callable[[Column, str], tuple[Column, Column]]] = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "ipv4": _ipv4, "phone": _phone, "intl": _intl}


def pseudonym(match: Column, key: str = KEY) -> Column:
    """struct(kind, made): kind is null, and made the match itself, if no validation holds."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), match.alias("made"))
    for name in reversed(list(_RULES)):
        ok, value = _RULES[name](match, key)
        out = F.when(match.rlike(f"^(?:{KINDS[name]})$") & ok, F.struct(F.lit(name).alias("kind"), value.alias("made"))).otherwise(out)
    return out


#: Where a value of any kind can begin.
BEGINS = "|".join(f"(?:{STRETCHES.get(name, shape)})".replace("sep>", f"{name}>") for name, shape in KINDS.items())


def _longest(stretch: Column, name: str, key: str) -> Column:
    """The longest part of a stretch, up to a border of its groups, that validates; null if none does."""
    good = lambda m: m.rlike(f"^(?:{KINDS[name]})$") & _RULES[name](m, key)[0]
    if name not in STRETCHES:
        return F.when(good(stretch), stretch)
    ends = F.filter(F.sequence(F.length(stretch), F.lit(8), F.lit(-1)), lambda n: F.substr(stretch, n + 1, F.lit(1)).rlike("^[ .-]?$"))
    return F.get(F.filter(F.transform(ends, lambda n: F.substr(stretch, F.lit(1), n)), good), 0)


def _values(text: Column, key: str) -> Column:
    """For each place of a text where a value of some kind can begin, in order: the value that counts there, or null.

    One scan a kind; all scans stop at the same places, so that their results lie side by side.
    """
    at_place = lambda shape: F.regexp_extract_all(text, F.lit(f"(?=({shape})|)(?={BEGINS})"), F.lit(1))
    found = F.arrays_zip(*[at_place(STRETCHES.get(name, shape)).alias(name) for name, shape in KINDS.items()])
    valid = lambda m, name: F.when(m != "", m if name == "email" else _longest(m, name, key))
    return F.transform(found, lambda x: F.coalesce(*[valid(x[name], name) for name in KINDS]))


def _taken(pieces: Column, values: Column) -> Column:
    """For each piece, a stretch of text from one such place to the next: whether its value is taken, which is so unless
    an earlier taken one covers its place, and how many of the piece's characters are covered.

    A recurrence along the text. It goes by blocks of the square root of the number of pieces, since adding to an array
    copies it.
    """
    n = F.size(pieces)
    block = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")
    none = F.array().cast("array<struct<taken:boolean,covered:int>>")

    def step(acc: Column, i: Column) -> Column:
        size, own = F.length(F.get(pieces, i)), F.coalesce(F.length(F.get(values, i)), F.lit(0))
        taken = (acc["open"] == 0) & (own > 0)
        open_ = F.when(taken, own).otherwise(acc["open"])
        return F.struct(F.greatest(open_ - size, F.lit(0)).alias("open"), F.concat(acc["out"], F.array(F.struct(taken.alias("taken"), F.least(open_, size).alias("covered")))).alias("out"))

    def blocks(acc: Column, b: Column) -> Column:
        places = F.sequence(b * block, F.least((b + 1) * block, n) - 1)
        part = F.aggregate(places, F.struct(acc["open"].alias("open"), none.alias("out")), step)
        return F.transform(F.array(part), lambda p: F.struct(p["open"].alias("open"), F.concat(acc["out"], p["out"]).alias("out")))[0]

    start = F.struct(F.lit(0).alias("open"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), start, blocks, lambda acc: acc["out"])


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with replaced values in text; pii_kinds lists the kinds found, in the order of the text.

    Defined cases: a null text stays null and an empty one empty, with no kinds; texts are searched whole; rows that
    repeat a doc_id are handled each; of overlapping matches the leftmost counts, and at one place the first kind of
    the table above that fits, the longest that validates; what fails its validation stays and hides no value within
    or behind it. A mail name begins at a letter or digit that follows none. Extra columns are carried along, whatever
    their names; a column named pii_kinds is replaced. An empty table gives an empty table.
    """
    text = F.col("text")
    some = text.rlike("[0-9@]") & text.rlike(BEGINS)
    parts = packed(docs, text.cast("string").alias("text")).withColumn("pieces", F.when(some, F.split(text, f"(?={BEGINS})", -1)))
    parts = parts.withColumn("values", F.when(some, _values(text, key)))
    # a text that begins with a value has no piece before the first place
    ahead = F.when(F.size("pieces") > F.size("values"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    parts = parts.withColumn("values", F.concat(ahead, "values"))
    parts = parts.withColumn("taken", F.when(F.exists("values", lambda v: v.isNotNull()), _taken(F.col("pieces"), F.col("values"))))
    made = F.transform("values", lambda v, i: F.when(F.get("taken", i)["taken"], pseudonym(v, key)))
    parts = parts.withColumn("found", F.when(F.col("taken").isNotNull(), made))
    rest = lambda piece, i: F.substr(piece, F.get("taken", i)["covered"] + 1)
    glued = F.array_join(F.transform("pieces", lambda piece, i: F.concat(F.coalesce(F.get("found", i)["made"], F.lit("")), rest(piece, i))), "")
    kinds = F.filter(F.transform("found", lambda x: x["kind"]), lambda x: x.isNotNull())
    return unpacked(parts, docs, text=F.when(F.col("taken").isNotNull(), glued).otherwise(text), pii_kinds=F.coalesce(kinds, F.array().cast("array<string>")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its values replaced, and the kinds found; cases as in ``pseudonymised``."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return pseudonymised(docs).select("doc_id", F.size("pii_kinds").cast("long").alias("n_pii"), F.array_join("pii_kinds", ",").alias("pii_kinds"), "text")
