"""Personal data to format-preserving pseudonyms, DataFrame functions only.

Numbers and dates that pass their check are permuted within their own format by a keyed alternating Feistel network: equal
values get equal pseudonyms in every document, different values get different ones, and a pseudonym passes the same
check as the value it stands for. The halves of the network are residues (l mod a, r mod b) and the formats are

  card    13 to 19 digits with a right Luhn digit, whole or in groups (4-4-4-1..4, 4-4-4-4-1..3, 4-6-4..5, 4-4-5) set apart by
          one space, hyphen or dot: all but the last digit are permuted, the Luhn digit is set anew
  phone   + and 8 to 15 digits, or ten digits as ddd-ddd-dddd or (ddd) ddd-dddd with or without a 1 before them: the digits
          after the country code; a trunk zero written (0) stays
  ssn     ddd-dd-dddd with a possible area, group and serial
  ip      four octets without leading zeros
  date    year, month, day or day, month, year or month, day, year set apart by - / or ., a day that exists in 1801 to 2200
          (146,097 = 189 * 773 days); where year comes last and both orders exist, / puts the month first, - and . the day
  email   has no check and no fixed format: the local part becomes a keyed hash, the domain example.invalid

Signs between the digits stay as written, and equal values get equal digits in every spelling. Only for dates whose year comes
last may two different days look alike, one read day first and one month first.

Round functions take SHA-256 of key, kind, round and half. Matches that fail their check stay as they are.

Defined results: a null text stays null with no matches; an empty text stays empty; cards in groups are read first, then
overlapping candidates from the left, the longer kind first; four years in a row are no card; rows are independent of each other,
so repeated rows get equal results.
Ties between kinds are settled so in every run; an empty table gives an empty one; texts of any length are read whole; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DAYS_A, DAYS_B = 189, 773  # their product is the number of days in 400 years
FIRST_DAY, LAST_DAY = "1801-01-01", "2200-12-31"

EMAIL = r"(?<![\p{L}\p{M}0-9._%+-])[\p{L}\p{M}0-9._%+-]++@(?:[\p{L}\p{M}0-9-]+\.)+(?:[A-Za-z0-9-]+|[\p{L}\p{M}]+)"
LOCAL = r"(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
PHONE = (
    r"(?<![\w+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![\w+])\+[1-9](?:[ ./-]{0,3}(?:\(0\)[ ./-]{0,3})?(?:\([0-9]{1,4}\)|[0-9])){4,14}(?![0-9])"
    rf"|(?<![\w+]|[0-9][.-])(?:1[ .-]?(?=\()|1[ .-])?{LOCAL}(?![0-9]|[.-][0-9])"
)
SSN = r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
DATE = (
    r"(?<![\w.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=[Tt][0-9]|Z)|(?![\w-]))"
    r"|(?<![\w./-])(?:[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}"
    r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?:(?=[Tt][0-9])|(?![\w/-]|\.[0-9]))"
)
IP = r"(?<![\w.])(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}(?![\w]|\.[0-9])"
CARD = r"(?<![\w.-])[0-9]{13,19}(?![\w-])"
KINDS = {"email": EMAIL, "phone": PHONE, "ssn": SSN, "date": DATE, "ip": IP, "card": CARD}
ANY = "|".join(KINDS.values())
GROUPS = r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,4}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,3}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4} [0-9]{4} [0-9]{5}"
YEARS = r"(?:(?:19|20)[0-9]{2} ){3}(?:19|20)[0-9]{2}"
# digit groups with one separator throughout, in which cards are looked for
RUN = "|".join(rf"(?<!\w)[0-9]++(?:{s}[0-9]++){{2,}}(?![\w-]|\.[0-9])" for s in (" ", "-", r"\."))
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """struct(l, r): a keyed permutation of the pairs with l below a and r below b."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def f(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")

    def turn(x: Column, i: Column) -> Column:
        even = F.struct(F.pmod(x["l"] + f(i, x["r"]), a).alias("l"), x["r"].alias("r"))
        odd = F.struct(x["l"].alias("l"), F.pmod(x["r"] + f(i, x["l"]), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts twice (the payload, check digit left out)."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return s + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def luhn_digit(payload: Column) -> Column:
    return F.pmod(F.lit(10) - F.pmod(luhn_sum(payload), F.lit(10)), F.lit(10)).cast("string")


def digits_of(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def halves(d: Column, key: str, kind: str) -> Column:
    """A digit string permuted among those of its length."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    left, right = F.substring(d, F.lit(1), half), F.substring(d, half + 1, n - half)
    moved = feistel(left, right, F.pow(F.lit(10), half).cast("long"), F.pow(F.lit(10), n - half).cast("long"), key, kind)
    # numbers of different lengths have domains of their own, as the key is the same but the moduli differ
    return bound(moved, lambda x: F.concat(digits_of(x["l"], half), digits_of(x["r"], n - half)))


def fill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced one by one."""
    signs, each = F.split(template, ""), F.split(digits, "")

    def put(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["text"], F.when(digit, F.get(each, s["at"])).otherwise(c)).alias("text"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.filter(signs, lambda c: c != ""), F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), put, lambda s: s["text"])


def right_luhn(m: Column) -> Column:
    return luhn_digit(F.substring(m, F.lit(1), F.length(m) - 1)) == F.substring(m, F.length(m), F.lit(1))


def card(m: Column, key: str) -> Column:
    moved = halves(F.substring(m, F.lit(1), F.length(m) - 1), key, "card")
    return F.when(right_luhn(m), bound(moved, lambda t: F.concat(t, luhn_digit(t))))


def cards_in_run(m: Column, key: str) -> Column:
    """struct(text, n): a run of digit groups with the cards in it replaced, from the left, the longest first, and their number."""
    sep = F.regexp_extract(m, "([^0-9])", 1)

    def scan(g: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            tries = F.transform(F.array(*[F.lit(n) for n in (5, 4, 3)]), lambda n: F.slice(g, i + 1, n))
            fits = lambda w: F.array_join(w, " ").rlike(f"^(?:{GROUPS})$") & ~F.array_join(w, " ").rlike(f"^{YEARS}$") & right_luhn(F.array_join(w, ""))

            def add(w: Column) -> Column:
                new = F.when(w.isNull(), F.get(g, i)).otherwise(fill(F.replace(F.array_join(w, " "), F.lit(" "), sep), card(F.array_join(w, ""), key)))
                text = F.concat(s["text"], F.when(i > 0, sep).otherwise(F.lit("")), new)
                return F.struct(text.alias("text"), F.coalesce(F.size(w) - 1, F.lit(0)).alias("skip"), (s["n"] + w.isNotNull().cast("int")).alias("n"))

            found = bound(F.get(F.filter(tries, fits), F.lit(0)), add)
            return F.when(s["skip"] > 0, F.struct(s["text"].alias("text"), (s["skip"] - 1).alias("skip"), s["n"].alias("n"))).otherwise(found)

        zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("skip"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), zero, step, lambda s: F.struct(s["text"].alias("text"), s["n"].alias("n")))

    spaced = F.translate(m, ".-", "  ")
    return F.when(spaced.rlike(rf"(?<![0-9])(?:{GROUPS})(?![0-9])"), bound(F.split(spaced, " "), scan)).otherwise(F.struct(m.alias("text"), F.lit(0).alias("n")))


def phone(m: Column, key: str) -> Column:
    trunk = "\u0001"
    plain = F.regexp_replace(m, r"\(0\)", trunk)

    def text(d: Column) -> Column:
        country = F.when(m.startswith("+"), F.regexp_extract(d, COUNTRY, 1)).otherwise(F.substring(d, F.lit(1), F.length(d) - 10))
        new = bound(country, lambda c: F.concat(c, halves(F.substring(d, F.length(c) + 1, F.length(d)), key, "phone")))
        return F.when(F.length(d).between(8, 15), F.replace(fill(plain, new), F.lit(trunk), F.lit("(0)")))

    return bound(F.regexp_replace(plain, "[^0-9]", ""), text)


def ssn(m: Column, key: str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1
    moved = feistel(place, serial - 1, 898 * 99, 9999, key, "ssn")

    def text(x: Column) -> Column:
        n = F.floor(x["l"] / 99)
        new_area = F.when(n >= 665, n + 2).otherwise(n + 1)
        return F.concat_ws("-", digits_of(new_area, F.lit(3)), digits_of(x["l"] % 99 + 1, F.lit(2)), digits_of(x["r"] + 1, F.lit(4)))

    return F.when(valid, bound(moved, text))


def ip(m: Column, key: str) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).cast("long") for i in range(1, 5)]
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    moved = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16, key, "ip")
    return F.when(valid, bound(moved, lambda x: F.concat_ws(".", *[F.floor(x[s] / 256).cast("string") if high else (x[s] % 256).cast("string") for s in ("l", "r") for high in (True, False)])))


def date(m: Column, key: str) -> Column:
    first = F.to_date(F.lit(FIRST_DAY))

    def text(x: Column) -> Column:
        p = [F.get(x, F.lit(i)) for i in range(3)]
        year_first = F.length(p[0]) == 4
        read = lambda y, month, d: F.try_to_date(F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        day_first, month_first = read(p[2], p[1], p[0]), read(p[2], p[0], p[1])
        by_month = F.when(m.contains("/"), month_first.isNotNull()).otherwise(day_first.isNull())
        day = F.when(year_first, read(p[0], p[1], p[2])).when(by_month, month_first).otherwise(day_first)

        def move(d: Column) -> Column:
            n = F.datediff(d, first)
            moved = feistel(F.floor(n / DAYS_B), F.pmod(n, F.lit(DAYS_B)), DAYS_A, DAYS_B, key, "date")
            return F.when(d.isNotNull() & (d >= first) & (d <= F.to_date(F.lit(LAST_DAY))), bound(moved, lambda v: F.date_add(first, (v["l"] * DAYS_B + v["r"]).cast("int"))))

        def write(d: Column) -> Column:
            sep = F.regexp_extract(m, "([^0-9])", 1)
            # a month or day of one digit is written without a zero again
            two = lambda n, old: F.when(F.length(old) == 1, n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))
            y = F.lpad(F.year(d).cast("string"), 4, "0")
            last = F.when(by_month, F.concat_ws(sep_mark, two(F.month(d), p[0]), two(F.day(d), p[1]), y)).otherwise(F.concat_ws(sep_mark, two(F.day(d), p[0]), two(F.month(d), p[1]), y))
            out = F.when(year_first, F.concat_ws(sep_mark, y, two(F.month(d), p[1]), two(F.day(d), p[2]))).otherwise(last)
            return F.when(d.isNotNull(), F.replace(out, F.lit(sep_mark), sep))

        sep_mark = "\u0001"
        return bound(bound(day, move), write)

    return bound(F.split(m, "[^0-9]"), text)


def email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value): value is null where the check fails."""
    made = {"email": email, "date": date, "ssn": ssn, "ip": ip, "card": card}
    shape = {
        "email": m.contains("@"),
        "date": m.rlike("^(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})$"),
        "ssn": m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        "ip": m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"),
        "card": m.rlike("^[0-9]+$"),
    }
    each = None
    for kind, test in shape.items():
        value = F.struct(F.lit(kind).alias("kind"), made[kind](m, key).alias("value"))
        each = F.when(test, value) if each is None else each.when(test, value)
    return each.otherwise(F.struct(F.lit("phone").alias("kind"), phone(m, key).alias("value")))


def group_cards(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with the cards in groups replaced, cards: their number."""
    runs = F.when(F.col("text").rlike(RUN), F.regexp_extract_all("text", F.lit(f"({RUN})"), F.lit(0)))
    rows = docs.select("doc_id", "text", F.transform(runs, lambda m: cards_in_run(m, key)).alias("runs"))
    n = F.aggregate("runs", F.lit(0), lambda s, r: s + r["n"])
    parts = F.zip_with(F.split("text", f"(?:{RUN})", -1), "runs", lambda p, r: F.concat(p, F.coalesce(r["text"], F.lit(""))))
    rows = rows.withColumn("cards", F.coalesce(n, F.lit(0)))
    return rows.select("doc_id", F.when(F.col("cards") > 0, F.array_join(parts, "")).otherwise(F.col("text")).alias("text"), "cards")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of docs: doc_id, n_replaced, kinds (sorted, comma-joined), text with pseudonyms, text_sha256.

    Whoever has the key can turn the numbers back. It becomes a part of the plan, so event logs hold it too.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    any_of = F.lit(f"({ANY})")
    rows = group_cards(docs, key)
    rows = rows.select("doc_id", "text", "cards", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", any_of, F.lit(0))).alias("found"))
    rows = rows.withColumn("found", F.when(F.size("found") > 0, F.col("found")))
    rows = rows.withColumn("made", F.transform("found", lambda m: pseudonym(m, key)))
    pieces = F.split("text", f"(?:{ANY})", -1)
    parts = F.zip_with(pieces, F.zip_with("found", "made", lambda m, x: F.coalesce(x["value"], m)), lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    none = F.array().cast("array<string>")
    replaced = F.filter("made", lambda x: x["value"].isNotNull())
    text = F.when(F.col("found").isNull() | F.col("made").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    out = rows.select(
        "doc_id",
        (F.greatest(F.coalesce(F.size(replaced), F.lit(0)), F.lit(0)) + F.col("cards")).cast("long").alias("n_replaced"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(F.transform(replaced, lambda x: x["kind"]), none), F.when(F.col("cards") > 0, F.array(F.lit("card"))).otherwise(none)))), ","), F.lit("")).alias("kinds"),
        text.alias("text"),
    )
    return out.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
