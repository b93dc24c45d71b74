"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A validated value is a list of digits, each with its radix: decimal digits, letters, octets, or the
parts of a day number. A keyed Feistel network over that list, whose halves are the even and the odd
places, permutes all values of one format: each round shifts one half by a keyed hash of the other.
Equal values therefore have equal pseudonyms in every document, different values different ones, and
each pseudonym is again a valid value of its format (check digits are computed anew; numbers and days that do not
exist are walked past). Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ROUNDS = 8
#: Days of a block of dates that is permuted in itself: 270 * 270, from 1900-01-01.
SIDE = 270
#: The first and the last date of four-digit years, as days from 1900-01-01.
FIRST_DAY, LAST_DAY = -693595, 2958463
#: The formats, tried in this order at each place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(f"(?:{x})" for x in FORMATS.values())


def feistel(parts: Column, key: str) -> Column:
    """Permute an array of (v, m), 0 <= v < m, among all arrays with the same m."""

    def one(a: Column, r: Column) -> Column:
        other = F.array_join(F.transform(F.filter(a, lambda x, i: i % 2 != r % 2), lambda x: x["v"].cast("string")), ",")
        mark = F.sha2(F.concat_ws("|", F.lit(key), r.cast("string"), F.size(a).cast("string"), other), 256)
        return F.transform(a, lambda x, i: F.struct(F.when(i % 2 == r % 2, F.pmod(x["v"] + F.pmod(F.xxhash64(mark, i), x["m"].cast("long")), x["m"].cast("long")).cast("int")).otherwise(x["v"]).alias("v"), x["m"].alias("m")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), parts, one)


def walked(parts: Column, key: str, valid, most: int) -> Column:
    """Permute among the valid arrays alone: the network is applied again until its result is valid (cycle walking).

    parts must be valid. `most` further rounds leave an invalid result with a chance of its share among all, to that power.
    """
    again = lambda a, _: F.when(valid(a), a).otherwise(feistel(a, key))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), feistel(parts, key), again)


def _part(v: Column, m) -> Column:
    return F.struct(v.cast("int").alias("v"), (F.lit(m) if isinstance(m, int) else m).cast("int").alias("m"))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def digits(text: Column) -> Column:
    return F.transform(chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: _part(c, 10))


def written(form: Column, new: Column) -> Column:
    """The digits of form replaced by those of new, in order; all else stays."""
    own = chars(form)
    place = lambda i: F.size(F.filter(F.slice(own, 1, i + 1), lambda c: c.rlike("[0-9]")))
    return F.array_join(F.transform(own, lambda c, i: F.when(c.rlike("[0-9]"), F.get(new, place(i) - 1)["v"].cast("string")).otherwise(c)), "")


def luhn(text: Column) -> Column:
    """The sum whose remainder by ten is zero for valid numbers; text: digits only."""
    back = chars(F.reverse(text))
    return F.aggregate(F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") / 5) + (c.cast("int") * 2) % 10).cast("int")), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """Remainder by 97 of an account number with its first four characters moved to the end, letters as 10 to 35."""
    order = F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4))
    return F.aggregate(chars(order), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def kind_of(m: Column) -> Column:
    """The kind of a match if it is valid, else null."""
    whole = lambda k: m.rlike("^(?:" + FORMATS[k] + ")$")
    only = F.regexp_replace(m, "[^0-9]", "")
    octets = F.forall(F.split(m, "\\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)) & ~x.rlike("^0[0-9]"))
    return (
        F.when(whole("email"), "email")
        .when(whole("iban"), F.when(mod97(m) == 1, "iban"))
        .when(whole("ip"), F.when(octets, "ip"))
        .when(whole("date"), F.when(day_of(m).isNotNull() & (day_of(m) >= F.to_date(F.lit("0001-01-01"))), "date"))
        .when(whole("ssn"), F.when(~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$"), "ssn"))
        .when(whole("phone"), "phone")
        .when(whole("card"), F.when((luhn(only) % 10 == 0) & ~only.rlike("^0+$"), "card"))
    )


def day_of(m: Column) -> Column:
    """The date a match writes (year first, or day and month before the year, or month and day if only that is one)."""
    make = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")
    a, b, c = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4)
    return F.when(m.rlike("^[0-9]{4}-"), F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(make(c, b, a), make(c, a, b)))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid match of a kind."""
    # all but the check digit are permuted, the check digit follows
    only = F.regexp_replace(m, "[^0-9]", "")
    join = lambda a: F.array_join(F.transform(a, lambda x: x["v"].cast("string")), "")
    body = walked(digits(F.substring(only, F.lit(1), F.length(only) - 1)), key + "/card", lambda a: F.exists(a, lambda x: x["v"] != 0), 3)
    check = F.pmod(-luhn(F.concat(join(body), F.lit("0"))), F.lit(10))
    card = written(m, F.concat(body, F.array(_part(check, 10))))
    octets = F.array_join(F.transform(feistel(F.transform(F.split(m, "\\."), lambda x: _part(x, 256)), key + "/ip"), lambda x: x["v"].cast("string")), ".")
    local = F.substring_index(m, "@", 1)
    letters = F.transform(chars(local), lambda c: F.when(c.rlike("[a-z]"), _part(F.ascii(c) - 97, 26)).when(c.rlike("[A-Z]"), _part(F.ascii(c) - 65, 26)).when(c.rlike("[0-9]"), _part(F.ascii(c) - 48, 10)).otherwise(_part(F.lit(0), 1)))
    mail = F.concat(F.array_join(F.zip_with(chars(local), feistel(letters, key + "/email"), lambda c, x: F.when(x["m"] == 1, c).otherwise(F.char(x["v"] + F.when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(48)))), ""), F.lit("@"), F.substring_index(m, "@", -1))
    rest = F.substring(m, 5, 40)
    account = F.transform(chars(rest), lambda c: F.when(c.rlike("[0-9]"), _part(F.ascii(c) - 48, 10)).otherwise(_part(F.ascii(c) - 65, 26)))
    fresh = F.array_join(F.zip_with(chars(rest), feistel(account, key + "/iban"), lambda c, x: F.char(x["v"] + F.when(c.rlike("[0-9]"), 48).otherwise(65))), "")
    iban = F.concat(F.substring(m, 1, 2), F.lpad((98 - mod97(F.concat(F.substring(m, 1, 2), F.lit("00"), fresh))).cast("string"), 2, "0"), fresh)
    at = lambda a, i: F.get(a, F.lit(i))["v"]
    area = lambda a: at(a, 0) * 100 + at(a, 1) * 10 + at(a, 2)
    lawful = lambda a: (area(a) > 0) & (area(a) < 900) & (area(a) != 666) & (at(a, 3) + at(a, 4) > 0) & (at(a, 5) + at(a, 6) + at(a, 7) + at(a, 8) > 0)
    ssn = written(m, walked(digits(m), key + "/ssn", lawful, 24))
    prefix = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    phone = F.concat(prefix, written(F.substring(m, F.length(prefix) + 1, F.lit(40)), feistel(digits(F.substring(m, F.length(prefix) + 1, F.lit(40))), key + "/phone")))
    day = F.datediff(day_of(m), F.to_date(F.lit("1900-01-01")))
    block = F.floor(day / (SIDE * SIDE)).cast("int")
    inside = day - block * SIDE * SIDE
    # a block that sticks out of the four-digit years is walked within them
    days = lambda a: block * SIDE * SIDE + F.get(a, F.lit(0))["v"] * SIDE + F.get(a, F.lit(1))["v"]
    moved = walked(F.array(_part(F.floor(inside / SIDE), SIDE), _part(inside % SIDE, SIDE)), key + "/date", lambda a: days(a).between(FIRST_DAY, LAST_DAY), 64)
    date = F.date_add(F.to_date(F.lit("1900-01-01")), days(moved))
    sep = F.substring(m, 3, 1)
    dates = F.when(m.rlike("^[0-9]{4}-"), F.date_format(date, "yyyy-MM-dd")).when(sep == "/", F.date_format(date, "dd/MM/yyyy")).otherwise(F.date_format(date, "dd.MM.yyyy"))
    return F.when(kind == "email", mail).when(kind == "iban", iban).when(kind == "ip", octets).when(kind == "date", dates).when(kind == "ssn", ssn).when(kind == "phone", phone).when(kind == "card", card)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs packed as _row, with new_text and found (array of kind, start, end, of valid values, in order).

    The key is the secret: who has it can undo the permutation. Null and empty texts stay; very long ones are split once; null text stays null; rows are treated one by one; an empty table gives an empty table. A match that does
    not validate (a bad check digit, no such day) stays as it is.
    """
    t = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    rows = C.packed(docs).withColumn("_t", t)
    some = F.col("_t").rlike("[0-9]|@")
    rows = rows.withColumn("_m", F.when(some, F.regexp_extract_all("_t", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    pieces = F.when(F.size("_m") > 0, F.split("_t", ANY, -1))
    rows = rows.withColumn("_p", pieces).withColumn("_k", F.transform("_m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))))
    rows = rows.withColumn("_n", F.transform("_k", lambda x: F.struct(x["k"].alias("k"), F.length(x["m"]).alias("len"), F.when(x["k"].isNull(), x["m"]).otherwise(pseudonym(x["m"], x["k"], key)).alias("new"))))
    text = F.when(F.size("_n") == 0, F.col("_row.text").cast("string")).otherwise(F.array_join(F.flatten(F.zip_with("_p", "_n", lambda p, n: F.array(p, F.coalesce(n["new"], F.lit(""))))), ""))
    return rows.select("_row", text.alias("new_text"), C.held(F.filter("_n", lambda n: n["k"].isNotNull())).alias("found"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(C.read(spark, sf_dir, "documents").select("doc_id", "text"), "quillmill")
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return done.select("_row.doc_id", *[count(k) for k in FORMATS], F.col("new_text").alias("text"))
